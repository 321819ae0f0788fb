"""The co-order network over all order lines against brute force on a small table."""

import random
from collections import Counter
from datetime import datetime
from itertools import combinations

import pytest

from citeflow.plans import catalog


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng, folder = random.Random(5), tmp_path_factory.mktemp("whole")
    lines = [(o, rng.randrange(o % 7 * 20, o % 7 * 20 + 20), datetime(1995 + o % 7, 6, 1)) for o in range(60) for _ in range(rng.randrange(1, 4))]
    lines += [(1000, 1, datetime(1995, 1, 10)), (1000, 2, datetime(1995, 1, 10))]  # all that was shipped in the first six weeks
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(150)], "p_partkey long").write.parquet(f"{folder}/part.parquet")
    edges = Counter(p for o in {o for o, _, _ in lines} for p in combinations(sorted({k for x, k, _ in lines if x == o}), 2))
    return str(folder), edges


def brute(edges):
    label = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = label[a], label[b]
        label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    return label


def test_whole_network(spark, small):
    folder, edges = small
    label = brute(edges)
    get = lambda name: [tuple(r) for r in catalog.QUERIES[name](spark, folder).collect()]
    assert dict(get("components_whole")) == label and len(set(label.values())) > 5
    n = Counter(label.values())
    first = min(n, key=lambda c: (-n[c], c))
    assert {x for (x,) in get("largest_component_whole")} == {x for x, c in label.items() if c == first}
    assert {x for (x,) in get("isolates_whole")} == set(range(150)) - set(label)
    best = {x: sorted((e for e in edges if x in e), key=lambda e: (-edges[e], e))[:2] for x in label}
    assert sorted(get("thin_parts_whole")) == sorted((*e, edges[e]) for e in {e for v in best.values() for e in v})
    found = dict(get("leiden_whole"))
    assert set(found) == set(label) and all(label[x] == label[c] and found[c] == c for x, c in found.items())
