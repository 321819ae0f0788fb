"""Language predictions against brute force, and the stage that rejects by them."""

import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from citeflow.llm import common, langid

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def documents(spark):
    return common.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def model(documents):
    return langid.fit(documents)


def brute(model, text):
    """Each word's segmentations summed by recursion, words added up, one temperature and softmax."""
    @lru_cache(None)
    def word(w, k):
        if not w:
            return 1.0
        return sum((model.p[model.pieces[w[:j]], k] if w[:j] in model.pieces else langid.UNKNOWN if j == 1 else 0.0) * word(w[j:], k) for j in range(1, len(w) + 1))

    words = [langid.START + x for t in text.lower().split() for x in re.findall(r"[^\W_]+", t) if x.isalpha()]
    totals = [sum(np.log(max(word(w[: langid.LONG + 1], k), 1e-300)) for w in words) for k in range(len(model.langs))]
    none = sum(model.other.get(c, np.log(langid.UNKNOWN)) for w in words for c in w)
    odds = np.exp((np.array([*totals, none]) - max(*totals, none)) / model.heat)
    odds /= odds.sum()
    own = (1 - model.noise) * odds[:-1] + model.noise * (1 - odds[-1]) / len(model.langs)
    return model.langs[int(np.argmax(totals))], own.max(), odds[-1]


def test_predictions_match_brute_force(documents, model):
    texts = [r.text for r in documents.orderBy("doc_id").collect() if r.text and len(r.text) < 1500][:30] + ["q", "zq x9y ß", "Ünïcode 123 naïve"]
    for text, found in zip(texts, model.predict(texts)):
        lang, score, none = brute(model, text)
        assert found[0] == lang and found[1:] == pytest.approx((score, none), abs=1e-6)


def test_no_word_or_piece_is_left_out(documents, model):
    from sentencepiece import SentencePieceProcessor
    import public_tokenizers

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {library.id_to_piece(i) for i in range(library.get_piece_size())}
    assert all(p in model.pieces for p in pieces if p.strip("▁").isalpha() and p == p.lower() and "▁" not in p[1:])
    # a rare piece that only one language's rare words have
    counts = langid.expect(model.pieces, ["▁a", "▁zyx"], np.array([1000.0, 1.0]))
    assert counts[model.pieces["▁a"]] > 0.9 * counts.sum() - 0.5 and counts.sum() == pytest.approx(1)
    assert langid.split("x" * 100) == ["▁" + "x" * 40, "▁" + "x" * 40, "▁" + "x" * 20]


def test_stage_rejects_what_is_no_learnt_language(spark, documents):
    stages = pytest.importorskip("corpus_pipeline")
    rng = random.Random(6)
    bad = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(50)), "1234 !!", "", None]
    docs = documents.select("doc_id", "text", "lang").unionAll(spark.createDataFrame([(10_000 + k, t, None) for k, t in enumerate(bad)], DOCS))
    kept = {r.doc_id for r in stages.drop_unidentified(spark, docs, SF).collect()}
    want = {r.doc_id for r in documents.collect() if r.text and any(map(str.isalpha, r.text))}
    assert kept == want


def test_score_is_calibrated(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    found = [r for r in langid.identify(docs, langid.fit(docs)).collect() if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang_pred != "und"]
    right = np.mean([r.lang == r.lang_pred for r in found])
    assert abs(np.mean([r.score for r in found]) - right) < 0.02
