"""All rows of the pipeline against its stages worked out one document at a time."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from citeflow.llm import common, langid, pii, simhash, toxicity
from test_near_copies import jaccard

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_rows(spark):
    from tokenizers import Tokenizer

    docs = common.table(spark, SF, "documents")
    grammar = toxicity.fit(docs, common.table(spark, SF, "labels"))
    rows = [r for r in docs.orderBy("doc_id").collect() if grammar.score(r.text) < 0.5]
    model = langid.fit(docs.where(docs.doc_id.isin([r.doc_id for r in rows])))
    rows = [r for r, (lang, _, none) in zip(rows, model.predict([r.text for r in rows])) if lang != "und" and none <= corpus_pipeline.MOST_UNKNOWN]
    fps, label = [simhash.fingerprint(r.text) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 or jaccard(rows[i].text, rows[j].text) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    kept = {rows[k].doc_id for k in set(label)}
    # the pseudonyms have brute-force tests of their own; here they are taken document by document
    texts = {r.doc_id: r.text for r in pii.pseudonymise(docs, pii.TEST_KEY).collect() if r.doc_id in kept}
    tokenizer, expect = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for doc, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expect[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    found = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expect
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        assert sum(n for _, n in held) <= 2048 and sorted(held)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(held), sorted(held)[1:]))
