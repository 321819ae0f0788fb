"""Components against a plain union-find."""

import random

import pytest

from citeflow.operators import network


def brute(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("pairs", [
    [(k, k + 1) for k in range(200)],
    [(k + 1, k) for k in range(0, 200, 2)] + [(199, 3), (3, 3)],
    [(0, k) for k in range(1, 300)] + [(1000, k) for k in range(250, 600)],
    [(random.Random(k).randrange(400), random.Random(-k - 1).randrange(400)) for k in range(300)] * 2,
    [(5, 5)], [],
], ids=["path", "pairs", "stars", "random", "loop", "none"])
@pytest.mark.parametrize("hot", [256, 4])
def test_roots(spark, monkeypatch, pairs, hot):
    monkeypatch.setattr(network, "HOT", hot)
    found = network.roots(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == brute(pairs) and len(found) == len(brute(pairs))
