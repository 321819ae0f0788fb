"""The language model's scores are probabilities, whatever a chunk or a range of hashes holds."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeflow.llm import common, lm

DOCS = "doc_id long, text string"


def test_probabilities_add_up_to_one_at_most(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join(rng.choice(words, rng.integers(1, 40), p=np.r_[0.6, np.full(11, 0.4 / 11)]))) for k in range(300)]
    asked = [(), *((w,) for w in [*words, "unseen"]), *product([*words, "unseen"], repeat=2)]
    rows += [(1000 + k, " ".join(x)) for k, x in enumerate(asked)]
    found = {r.doc_id: 10.0**r.score for r in lm.score(spark.createDataFrame(rows, DOCS), F.col("doc_id") < 1000).collect()}
    by_length = [sum(found[1000 + k] for k, x in enumerate(asked) if len(x) == n) for n in range(3)]
    assert sum(by_length) <= 1 + 1e-9 and all(p > 0 for p in by_length)


@pytest.mark.parametrize("strength", [s for s in lm.STRENGTHS if s < 1e9])
def test_conditional_chances(strength):
    rng = np.random.default_rng(int(strength))
    for _ in range(50):
        pairs = rng.zipf(1.3, 60).clip(0, 10**6) * rng.integers(0, 2, 60)  # all that follows one word
        alone = rng.dirichlet(np.ones(60))
        level = lambda x: np.searchsorted(lm.LEVELS, x, side="right")
        assert lm.chances(level(pairs), np.full(60, level(pairs.sum())), alone, strength).sum() <= 1 + 1e-9


def test_chunks_and_ranges_do_not_matter(spark, monkeypatch):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    scores = lambda: {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs, F.col("doc_id") % 5 != 1).collect()}
    whole = scores()
    monkeypatch.setattr(lm, "RANGE", 1 << 10)
    assert scores() == whole


def test_words_are_told_what_the_filter_holds():
    import pandas as pd

    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 1 << 62, 5000, dtype=np.int64).astype(np.uint64))
    counts = [rng.zipf(1.4, len(keys)).clip(0, 10**5) * rng.integers(0, 2, len(keys)) for _ in range(2)]
    rows = pd.DataFrame([(1, 3, c, len(keys), keys.tobytes(), lm.packed(counts[c].astype("<u4"))) for c in range(2)], columns=["kind", "part", "chunk", "n", "hashes", "counts"])
    out = lm.told(rows)
    for r in out[out.kind == 1].itertuples():
        assert (lm.unpacked(r.counts, "<i8", r.n) == counts[0] + counts[1]).all()
        assert (lm.unpacked(r.levels, "u1", r.n) == np.searchsorted(lm.LEVELS, counts[0] + counts[1], side="right")).all()
    assert out[out.kind == 0].iloc[0].total == (counts[0] + counts[1]).sum()


def test_ids_stay_exact(spark):
    ids = [None, 2**62 + 1, -(2**62) - 1, 3, 3]
    found = lm.score(spark.createDataFrame([(d, "some words") for d in ids], DOCS), F.lit(True)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(map(str, ids))
