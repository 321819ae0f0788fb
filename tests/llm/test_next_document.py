"""The next document by descending id, however the ids lie."""

import random

import pytest

from citeflow.llm import common, winnowing

DOCS = "doc_id long, text string"


def check(spark, rows):
    found = winnowing.with_next(spark.createDataFrame(rows, DOCS), ["doc_id", "text"]).collect()
    assert len(found) == len(rows) and sorted(map(str, ((r.doc_id, r.text) for r in found))) == sorted(map(str, rows))
    # what follows is a permutation of the rows, keys go down but for one step
    assert sorted(map(str, ((r.next.doc_id, r.next.text) for r in found))) == sorted(map(str, rows))
    low = lambda k: float("-inf") if k is None else k
    ups = [r for r in found if low(r.next.doc_id) > low(r.doc_id)]
    assert len(ups) == (len({k for k, _ in rows}) > 1)
    keys = sorted({k for k, _ in rows}, key=low, reverse=True)
    after = dict(zip(keys, keys[1:] + keys[:1]))
    assert all(r.next.doc_id in (r.doc_id, after[r.doc_id]) for r in found)
    return found


@pytest.mark.parametrize("rows", [
    [(1, "a"), (10**18, "b")],
    [(2**63 - 1, "a"), (-(2**63), "b"), (0, "c"), (2**63 - 2, "d")],
    [(k, str(k)) for k in range(3000)] + [(2**62, "far")],
    [(None, str(k)) for k in range(2000)] + [(k, "x") for k in range(50)],
    [(7, str(k)) for k in range(2000)] + [(k, "x") for k in range(50)] + [(7, "same")] * 5,
    [(k // 3, str(k)) for k in range(600)],
    [(random.Random(k).randrange(-(2**63), 2**63), str(k)) for k in range(500)],
    [(5, "one")], [(None, None)], [(None, "n"), (None, "n")],
], ids=["far", "ends", "outlier", "nulls", "hot", "ties", "wide", "one", "null", "equal nulls"])
def test_next(spark, rows):
    check(spark, rows)


def test_hot_keys_are_split(spark):
    rows = spark.createDataFrame([(None if k % 3 else 7, str(k)) for k in range(9000)], DOCS)
    plan = winnowing.with_next(rows, ["doc_id", "text"])
    assert plan.count() == 9000
    assert winnowing.ranges(rows, "doc_id") == [7] * (winnowing.RANGES * 8 - 1)


def test_short_texts_stay_like_their_edits(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    found = winnowing.compare_edited(docs).where("n_chars >= 12").collect()
    assert all(r.near_edited > 0 for r in found)
    assert sum(r.near_edited for r in found) / len(found) > 0.4
