"""The near-dedup stage against brute force, with planted near copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeflow.llm import common, nearcopies, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string"


def jaccard(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in (a, b))
    return len(a & b) / len(a | b) if a and b else 0.0


def brute(texts):
    fps, label = [simhash.fingerprint(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 or jaccard(texts[i], texts[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def planted():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    out = []
    for _ in range(40):
        words = [word() for _ in range(rng.randrange(60, 300))]
        out.append(" ".join(words))
        for share in (0.01, 0.02, 0.2):  # the last is no near copy
            out.append(" ".join(word() if rng.random() < share else w for w in words))
    return out


@pytest.mark.parametrize("block", [2048, 8])
def test_planted_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    texts = planted() + [" ".join(["lorem ipsum dolor sit amet"] * 8 + [f"w{k // 3 * 3 + j}" for j in range(30)]) for k in range(20)]
    label, fps = brute(texts), [simhash.fingerprint(t) for t in texts]
    far = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8 and (fps[i] ^ fps[j]).bit_count() > 4]
    assert len(far) >= 20
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == set(label)


def test_small_tables(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id")
    rows = docs.collect()
    label = brute([r.text or "" for r in rows])
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {rows[k].doc_id for k in set(label)}


def test_null_and_repeated_ids(spark):
    long = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [(None, long("a")), (None, long("a")), (None, long("b")), (3, long("c")), (3, long("d")), (3, long("d")), (1, long("c")), (5, long("b"))]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(None, long("a")), (5, long("b")), (1, long("c")), (3, long("d"))], key=str)
