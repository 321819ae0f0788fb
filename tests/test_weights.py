"""Fractional weights: no result may depend on the weights' scale."""

import pytest
from pyspark.sql import functions as F

from citeflow.operators import network
from citeflow.operators.leiden import leiden

EDGES = [(1, 2, 0.4), (2, 1, 0.4), (3, 4, 0.4), (1, 3, 0.2), (4, 4, 0.7)]
PARTS = [(1, 1), (2, 1), (3, 2), (4, 2)]


@pytest.mark.parametrize("times", [1, 10, 0.01])
def test_scale(spark, times):
    edges = spark.createDataFrame([(a, b, w * times) for a, b, w in EDGES], "src long, dst long, w double")
    parts = spark.createDataFrame(PARTS, "id long, community long")
    found = {(r.ci, r.cj): r for r in network.mixing(edges, parts).collect()}
    assert {k: r.observed for k, r in found.items()} == pytest.approx({(1, 1): 0.8 * times, (1, 2): 0.2 * times, (2, 1): 0.0, (2, 2): 0.4 * times})
    assert found[1, 1].expected == pytest.approx(1.0 * 0.8 / 1.4 * times) and found[2, 1].weight == pytest.approx(-found[2, 1].expected)
    # 2.1 in all, degrees 1.8 and 2.4, inside 0.8 and 1.1
    assert network.modularity(edges, parts).first().modularity == pytest.approx(1.9 / 2.1 - (1.8**2 + 2.4**2) / 4.2**2)


def test_ego_and_adjacency(spark):
    edges = spark.createDataFrame(EDGES, "src long, dst long, w double")
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5)], "id long")
    assert sorted(tuple(r) for r in network.ego(edges, nodes.where("id IN (2, 4)")).collect()) == sorted(e for e in EDGES if {2, 4} & set(e[:2]))
    assert {r.src: r.row for r in network.adjacency(edges, nodes).collect()} == {a: [sum(w for x, y, w in EDGES if (x, y) == (a, b)) for b in range(1, 6)] for a in range(1, 6)}


def test_degree_files(spark):
    vectors = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, 1, 5.0)], "net_id long, id int, value double")
    found = network.degrees_of_files(vectors, spark.createDataFrame(PARTS, "id long, community long"))
    assert {(r.id, r.degree) for r in found.collect()} == {(1, 2.0), (2, 3.0), (3, 5.0), (4, None)}


def test_leiden_goes_on_until_nothing_moves():
    n = 4096  # pairs of pairs of pairs ...
    edges = [(a, a ^ (1 << k), 4.0 ** (12 - k)) for k in range(12) for a in range(n) if a < a ^ (1 << k)]
    part = leiden(n, edges, sum(w for *_, w in edges), resolution=0.0001)
    assert len(set(part)) < 64
