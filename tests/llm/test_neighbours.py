"""The neighbour search against brute force."""

import numpy as np
import pytest

from citeflow.llm import ann, common

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, every=20, k=20):
    out = []
    for q, (query, v) in enumerate(rows):
        if query % every == 0:
            near = sorted((-float(np.dot(v, w)), c) for j, (c, w) in enumerate(rows) if j != q and len(w) == len(v))[:k]
            out += [(query, r + 1, c, pytest.approx(-s)) for r, (s, c) in enumerate(near)]
    return out


def recall(found, rows):
    want = {}
    for query, _, c, _ in brute(rows):
        want.setdefault(query, set()).add(c)
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(len(want[q] & got.get(q, set())) for q in want) / sum(map(len, want.values()))


def test_every_row_is_a_candidate(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [5.0, 0.0]), (2, [3.0, 0.0]), (20, [1.0]), (21, [2.0]), (22, [4.0])]
    found = [tuple(r) for r in ann.search(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(found) == sorted(brute(rows)) and (0, 1, 1, 5.0) in found


def test_an_id_with_two_vectors_asks_twice(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (3, [2.0, 1.0])]
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [(0, 1, 3, 1.0), (0, 1, 3, 2.0), (0, 2, 0, 0.0), (0, 2, 0, 0.0)]


@pytest.mark.parametrize("shard,block", [(8192, 4096), (60, 16)])
def test_recall_with_small_blocks(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ann, "SHARD", shard)
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    x[100:500] = x[100] + 0.01 * rng.normal(size=(400, 24))  # a list far longer than a block
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    found = ann.search(spark.createDataFrame(rows, SCHEMA)).collect()
    assert recall(found, rows) >= 0.9 and len(found) == 75 * 20
    assert all(r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-12) for r in found)


def test_clusters_need_few_lists():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(64, 32)) * 4
    x = centres[rng.integers(0, 64, 8000)] + rng.normal(size=(8000, 32)) * 0.3
    made = ann.Index(x, 90)
    assert made.depth(x, 20) <= 20
    noise = rng.normal(size=(4000, 32))
    assert ann.Index(noise, 63).depth(noise, 20) > 20


def test_blocks_hold_all_lists():
    sizes, centres = {0: 10, 1: 500, 2: 30, 3: 90, 5: 100}, np.random.default_rng(1).normal(size=(6, 4))
    place, load = ann.blocks(sizes, centres, 100), {}
    for k, (first, many) in enumerate(place):
        for b in range(first, first + many):
            load[b] = load.get(b, 0) + sizes.get(k, 0) / many
    assert max(load.values()) <= 100 and place[1, 1] == 5


def test_recall_on_the_tables(spark):
    frame = common.table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    assert recall(ann.search(frame).collect(), rows) >= 0.9
