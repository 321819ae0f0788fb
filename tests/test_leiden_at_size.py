"""Communities of components that are too large for one task: nothing is refused or left out."""

import random

import pytest

from citeflow.operators import network


def blocks(seed=3):
    """Twelve groups of twenty, many edges within and few between, and a triangle apart."""
    rng = random.Random(seed)
    edges = {}
    for _ in range(2400):
        g = rng.randrange(12)
        a, b = (g * 20 + rng.randrange(20) for _ in range(2))
        if rng.random() < 0.08:
            b = rng.randrange(240)
        if a != b:
            edges[min(a, b), max(a, b)] = edges.get((min(a, b), max(a, b)), 0) + 1
    return [(a, b, w) for (a, b), w in edges.items()] + [(900, 901, 1), (901, 902, 1), (900, 902, 1)]


def connected(part, edges):
    label = {x: x for x in part}
    for _ in part:
        for a, b, _w in edges:
            if part[a] == part[b]:
                label[a] = label[b] = min(label[a], label[b])
    return all(label[x] == part[x] for x in part)


@pytest.mark.parametrize("objective, resolution, limits", [("modularity", 1.0, (2_000_000, 200)), ("cpm", 0.1, (200,))])
def test_large_component(spark, objective, resolution, limits):
    rows = blocks()
    edges = spark.createDataFrame(rows, "src long, dst long, w long")
    ids = sorted({x for a, b, _ in rows for x in (a, b)}) + [999]
    nodes = spark.createDataFrame([(x,) for x in ids], "id long")

    def quality(part):
        q = sum(w for a, b, w in rows if part[a] == part[b])
        total = sum(w for *_, w in rows)
        for c in set(part.values()):
            inside = [x for x in part if part[x] == c]
            size = sum(w * (part[a] == c) + w * (part[b] == c) for a, b, w in rows) if objective == "modularity" else len(inside)
            q -= (resolution / (2 * total) if objective == "modularity" else resolution) * size * size / 2
        return q

    found = {}
    for largest in limits:
        part = {r.id: r.community for r in network.communities(nodes, edges, resolution, objective, largest=largest).collect()}
        assert sorted(part) == ids and part[999] == 999 and part[900] == part[901] == part[902] == 900
        assert connected(part, rows)
        found[largest] = quality(part)
    planted = quality({x: x // 20 * 20 if x < 900 else 900 if x < 903 else x for x in ids})
    assert min(found.values()) > 0.95 * planted > 0
