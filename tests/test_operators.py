"""Edge cases that the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from citeflow.functions import scalar
from citeflow.operators import eras, flow, network, text
from citeflow.operators.leiden import leiden
from citeflow.sources import pajek
from citeflow.streaming import flow as streaming


def one(spark, column, *values):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r[0] for r in frame.orderBy("k").select(column).collect()]


def test_scalars(spark):
    x = F.col("x")
    assert one(spark, scalar.last_index(x, "."), "a.b.c", "abc", "") == [4, -1, -1]
    assert one(spark, scalar.clean_theme(x), 'Here is: "A b."', "Theme: X\nmore", "", "Plain. Next") == ["A b", "X", "", "Plain"]
    assert one(spark, scalar.normalise_list(x), " a ; b;", "", "a") == ["a,b", "", "a"]
    assert one(spark, scalar.windows_path(x), "/a//b/c.net") == ["C:\\a\\b\\c.net"]
    assert one(spark, scalar.author_key(x), "O'Neil, J. P.") == ["oneiljp"]
    assert one(spark, scalar.request_timeout(F.length(x) * 1000), "", "abc", "x" * 100) == [180.0, 234.0, 1200.0]


def test_eras(spark):
    years = [1906, 1907, 1944, 1945, 1990, 2008, 2009, 2020, 2021, None]
    frame = spark.createDataFrame([(k, y) for k, y in enumerate(years)], "k int, year int")
    assert [r.era for r in frame.orderBy("k").select(eras.era_of(F.col("year")).alias("era")).collect()] == [None, 1, 1, 2, 7, 11, 12, 23, None, None]


def test_flow_first_sender_counts(spark):
    edges = spark.createDataFrame([(1, 9, 1, 0), (2, 9, 2, 1), (3, 9, 2, 2), (3, 8, 2, 3)], "sender int, target int, era int, at int")
    assert [tuple(r) for r in flow.shared_targets(edges, 1, 2, ["at"]).collect()] == [(9, 2)]


def test_mixing_has_empty_cells(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 1, 5), (2, 1, 2), (1, 4, 1)], "src int, dst int, w int")
    part = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2)], "id int, community int")
    found = {(r.ci, r.cj): r for r in network.mixing(edges, part).collect()}
    assert len(found) == 4 and found[2, 1].observed == 0 and found[1, 1].observed == 3
    assert found[2, 1].expected == 0 and found[2, 1].weight is None


def test_thinning_merges_equal_edges(spark):
    edges = spark.createDataFrame([(0, k, 1) for k in range(1, 6)] + [(0, 1, 1)], "src int, dst int, w int")
    assert network.thin(edges, 1).count() == 5
    assert network.thin(edges, 1, symmetric=True).count() == 5


def test_degree_counts_loops_twice(spark):
    edges = spark.createDataFrame([(1, 1), (1, 2)], "src int, dst int")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert {r.id: r.degree for r in network.total_degree(edges, nodes).collect()} == {1: 3, 2: 1, 3: 0}
    assert [r.id for r in network.isolates(nodes, edges).collect()] == [3]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 200)] + [(500, 501)], "src int, dst int")
    nodes = spark.createDataFrame([(k,) for k in [*range(1, 201), 500, 501, 999]], "id int")
    found = {r.id: r.component for r in network.components(nodes, edges).collect()}
    assert all(found[k] == 1 for k in range(1, 201)) and found[501] == 500 and found[999] == 999


def test_leiden_splits_two_cliques():
    clique = [(a, b, 1.0) for a in range(5) for b in range(a)]
    edges = clique + [(a + 5, b + 5, w) for a, b, w in clique] + [(0, 5, 1.0)]
    part = leiden(10, edges, float(len(edges)))
    assert len(set(part[:5])) == 1 and len(set(part[5:])) == 1 and part[0] != part[5]


def test_text_assembly(spark):
    rows = [(c, k, f"{c}{k}.") for c, n in (("a", 1), ("b", 5), ("c", 6)) for k in range(n)]
    found = text.core_and_rest(spark.createDataFrame(rows, "community string, place int, text string"))
    assert sorted((r.community, r.n_core, r.n_rest) for r in found.collect()) == [("a", 1, 0), ("b", 5, 0), ("c", 5, 1)]


@pytest.mark.parametrize("rest, expect", [("x" * 8 + "." + "y" * 9, "ab " + "x" * 8 + "."), ("x." + "y" * 20, "ab x." + "y" * 8), ("", "ab"), ("short", "ab short")])
def test_budget(spark, rest, expect):
    rows = spark.createDataFrame([("p", "z" * 12, ""), ("q", "ab", rest)], "community string, core_text string, rest_text string")
    assert {r.community: r.theme_text for r in text.within_budget(rows, 8).collect()}["q"] == expect


def test_chunks(spark):
    rows = spark.createDataFrame([(c,) for c, n in ((1, 3), (2, 3), (3, 2), (4, 9)) for _ in range(n)], "community int")
    assert [(r.community, r.chunk) for r in text.chunks(rows, 5).orderBy("community").collect()] == [(1, 1), (2, 2), (3, 2), (4, 3)]


def test_labels_retry_timeouts_only(spark):
    def client(prompt, timeout):
        if "late" in prompt and timeout < 900:
            raise text.TimedOut
        if "bad" in prompt:
            raise ValueError
        return "Theme: Fine. More"

    rows = spark.createDataFrame([(1, "late"), (2, "bad"), (3, "good")], "community int, prompt string")
    found = text.label(rows, client)
    assert {r.community_id: (r.theme, r.status) for r in found.collect()} == {1: ("Fine", "success"), 2: (None, "failed"), 3: ("Fine", "success")}
    replies = spark.createDataFrame([(1, "1,Cats, mostly\nnoise\n2,Dogs")], "chunk int, reply string")
    assert [tuple(r) for r in text.parse_reply(replies).collect()] == [(1, 1, "Cats, mostly"), (1, 2, "Dogs")]


NET = '*Vertices 3\r\n   1 "A * b n/c"   0.1084    0.2622    0.5000 ic Blue bc White\r\n   2 "28802"   0.1 0.2 0.5\r\n 3 "it\'s & co"    ic Blue\r\n*Arcs\r\n   1   2 0.25 c Gray\r\n 2 2\r\n*Arcslist\r\n1 2 3\r\n'


def test_network_files(spark, tmp_path):
    (tmp_path / "a.net").write_bytes(NET.encode())
    nodes = {r.id: r for r in pajek.read_vertices(spark, str(tmp_path / "a.net")).collect()}
    assert nodes[1].label == "A * b n/c" and nodes[1].x == 0.1084 and nodes[1].shape == "ic Blue bc White"
    assert nodes[2].label == "28802" and nodes[2].shape is None and nodes[3].x is None and nodes[3].shape == "ic Blue"
    ties = [(r.section, r.src, r.dst, r.weight) for r in pajek.read_ties(spark, str(tmp_path / "a.net")).collect()]
    assert sorted(ties) == [(2, 1, 2, 0.25), (2, 2, 2, 1.0), (3, 1, 2, 1.0), (3, 1, 3, 1.0)]


def test_network_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(k, f'n "{k}"') for k in range(1, 12)], "id int, label string")
    ties = spark.createDataFrame([(2, 1, 0.5), (1, 2, None), (2, 1, 0.75)], "src int, dst int, weight double")
    pajek.write_network(nodes, ties, str(tmp_path / "net"), tidy=True, node_colour="Blue")
    back = pajek.read_vertices(spark, str(tmp_path / "net/part-*"))
    assert sorted((r.id, r.label, r["shape"]) for r in back.collect()) == [(k, f"n '{k}'", "ic Blue") for k in range(1, 12)]
    assert sorted((r.src, r.dst, r.weight) for r in pajek.read_ties(spark, str(tmp_path / "net/part-*")).collect()) == [(1, 2, 1.0), (2, 1, 0.5)]


def test_partitions_and_vectors(spark, tmp_path):
    (tmp_path / "p.clu").write_text("*Vertices 2\n4\n7\n")
    (tmp_path / "q.clu").write_text("*Vertices 2\r\n1\r\n2\r\n")
    assert [tuple(r) for r in pajek.read_partition(spark, str(tmp_path / "p.clu")).orderBy("id").collect()] == [(1, 4), (2, 7)]
    assert [tuple(r) for r in pajek.read_partitions(spark, str(tmp_path / "*.clu"), 2).orderBy("id").collect()] == [(1, 4, 1), (2, 7, 2)]
    frame = spark.createDataFrame([(2, 0.5), (1, 1.25)], "id int, v double")
    (path,) = pajek.write_all_values(frame, str(tmp_path), "vec")
    assert [(r.id, r.value) for r in pajek.read_vectors(spark, f"{path}/part-*").orderBy("id").collect()] == [(1, 1.25), (2, 0.5)]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", 1, 2), ("2024-01-01 03:00:00", 1, 2)], "t string, sender_community int, target_community int")
    rows.withColumn("ts", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("t string, sender_community int, target_community int, ts timestamp").parquet(str(tmp_path / "in"))
    run = streaming.pair_counts(source).writeStream.format("memory").queryName("flow_counts").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert [r.n for r in spark.table("flow_counts").collect()] == [2]
