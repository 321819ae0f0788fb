"""Weighted directed networks: nodes (id) and edges (src, dst, w) as DataFrames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _shared(df: DataFrame) -> str:
    """The checkpoint folder of the session, set if it isn't yet."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="citeflow-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the session's checkpoint folder and go on from there."""
    _shared(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, but as a table: a checkpoint hands on what the optimiser knows of its columns, which grows over many rounds."""
    path = f"{_shared(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def endpoints(edges: DataFrame) -> DataFrame:
    """One row (id, w) for each end of an edge; a loop has two."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"), *(["w"] if "w" in edges.columns else []))


def total_degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, degree): edge ends at each node, loops counting twice; nodes without any have 0 if nodes are given."""
    degrees = endpoints(edges).groupBy("id").agg(F.count("*").alias("degree"))
    if nodes is None:
        return degrees
    return nodes.select("id").join(degrees, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def with_communities(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Edges with the communities ci and cj of their ends; edges with an end in none are dropped."""
    a = partition.select(F.col("id").alias("src"), F.col("community").alias("ci"))
    b = partition.select(F.col("id").alias("dst"), F.col("community").alias("cj"))
    return edges.join(a, "src").join(b, "dst")


def ingroup_edges(edges: DataFrame, partition: DataFrame) -> DataFrame:
    return with_communities(edges, partition).where("ci = cj").select(*edges.columns)


def ingroup_degree(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(id, community, degree) within each node's own community, for all communities at once."""
    inside = total_degree(ingroup_edges(edges, partition))
    return partition.select("id", "community").join(inside, "id", "left").select("id", "community", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_rank(degrees: DataFrame) -> DataFrame:
    """degrees with each node's place in its community, highest degree first, then id."""
    order = Window.partitionBy("community").orderBy(F.desc("degree"), "id")
    return degrees.withColumn("place", F.row_number().over(order).cast("long"))


def symmetrise(edges: DataFrame) -> DataFrame:
    """Undirected edges: smaller end first, weights summed."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w"))


def thin(edges: DataFrame, k: int, symmetric: bool = False, loops: bool = True) -> DataFrame:
    """Edges among the k heaviest at either end; equal weights go by src and dst, equal edges merge."""
    rows = edges if loops else edges.where("src <> dst")
    rows = symmetrise(rows) if symmetric else rows
    ends = rows.select("src", "dst", "w", F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    order = Window.partitionBy("id").orderBy(F.desc("w"), "src", "dst")
    return ends.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select("src", "dst", "w").distinct()


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at which no edge ends; a loop counts as one."""
    return nodes.join(endpoints(edges).select("id").distinct(), "id", "left_anti")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def shrink(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(ci, cj, w): edges between communities, loops kept, weights summed."""
    return with_communities(edges, partition).groupBy("ci", "cj").agg(F.sum("w").alias("w"))


def mixing(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(ci, cj, observed, expected, weight) for every ordered pair of communities.

    Loops are left out. Expected is row total times column total over the grand total; weight is
    the signed chi-square contribution, null where nothing is expected. The grid has one
    row for each pair of communities, a number the partition sets.
    """
    seen = shrink(edges.where("src <> dst"), partition)
    none = F.lit(0).cast(seen.schema["w"].dataType)  # counts stay whole numbers, fractional weights fractional
    groups = partition.select("community").distinct()
    grid = groups.select(F.col("community").alias("ci")).crossJoin(groups.select(F.col("community").alias("cj")))
    full = grid.join(seen, ["ci", "cj"], "left").select("ci", "cj", F.coalesce("w", none).alias("observed"))
    row, column = (F.sum("observed").over(Window.partitionBy(c)) for c in ("ci", "cj"))
    total = full.agg(F.sum("observed").alias("total"))
    out = full.select("ci", "cj", "observed", row.alias("r"), column.alias("c")).crossJoin(F.broadcast(total))
    out = out.select("ci", "cj", "observed", F.try_divide(F.col("r").cast("double") * F.col("c").cast("double"), F.col("total").cast("double")).alias("expected"))
    gap = F.col("observed").cast("double") - F.col("expected")
    return out.withColumn("weight", F.try_divide(F.signum(gap) * gap * gap, F.col("expected")))


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, row array<double>): one row of the matrix for each node, columns by id. For export of small networks.

    A node's edges become a map, which is read off in the order of all ids: the ids are one row.
    """
    ids = nodes.agg(F.array_sort(F.collect_list("id")).alias("ids"))
    cells = edges.groupBy("src", "dst").agg(F.sum("w").cast("double").alias("w")).groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "w"))).alias("of"))
    rows = nodes.select(F.col("id").alias("src")).join(cells, "src", "left").crossJoin(F.broadcast(ids))
    return rows.select("src", F.transform("ids", lambda d: F.coalesce(F.try_element_at("of", d), F.lit(0.0))).alias("row"))


def ego(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """Edges that begin or end at one of the centres (id), each once."""
    of = centres.select(F.col("id")).distinct()
    at = edges.join(of.withColumnRenamed("id", "src").withColumn("_a", F.lit(True)), "src", "left").join(of.withColumnRenamed("id", "dst").withColumn("_b", F.lit(True)), "dst", "left")
    return at.where("_a OR _b").select(*edges.columns)


def degrees_of_files(vectors: DataFrame, partition: DataFrame) -> DataFrame:
    """(id, community, degree): the values of the vector file that belongs to each community, place by place.

    ``vectors`` has net_id, id (the place) and value; the nodes of a community stand in their
    subnetwork in the order of their ids. Nodes without a value have null.
    """
    place = F.row_number().over(Window.partitionBy("community").orderBy("id"))
    nodes = partition.select("id", "community", place.alias("place"))
    values = vectors.select(F.col("net_id").alias("community"), F.col("id").alias("place"), F.col("value").alias("degree"))
    return nodes.join(values, ["community", "place"], "left").select("id", "community", "degree")


def from_adjacency(matrix: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of a matrix's cells that aren't 0; the matrix has src and row, nodes are its columns by id."""
    from citeflow.operators.eras import numbered

    places = numbered(nodes.select(F.col("id").alias("dst")), ["dst"], "pos").withColumn("pos", F.col("pos") - 1)
    return matrix.select("src", F.posexplode("row").alias("pos", "w")).where("w <> 0").join(places, "pos").select("src", "dst", "w")


#: Pairs of one node that a task gets at least; nodes of more are split, 10,000 of them at most.
HOT = 256


def _neighbours(pairs: DataFrame, hot: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with m, the least b of their a.

    In the order of b the first pair of an a tells; the pairs of an a in hot (a, m, parts) are dealt out over
    parts tasks, and its m is known.
    """
    rows = pairs.join(F.broadcast(hot), "a", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("parts"))))
    by = Window.partitionBy("a", "part").orderBy("b")
    again = F.lag("b").over(by)
    return rows.select("a", "b", F.coalesce("m", F.first("b").over(by)).alias("m"), (again.isNull() | (again != F.col("b"))).alias("once")).where("once").drop("once")


def roots(pairs: DataFrame) -> DataFrame:
    """(node, root) for every end of the pairs (a, b): root is the smallest node that can be reached.

    Alternating large-star and small-star steps, so the rounds grow with the logarithm of
    the longest path. A step deals the pairs out by one end; nodes with more than one in
    10,000 of the pairs, as the centre of a large star, are found first and split. Each round is cut to
    the checkpoint folder. Loops and repeated pairs count for nothing; no pairs give no rows.
    """
    def state(x: DataFrame):
        return tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    before = state(e)
    while before[0]:
        most = max(HOT, 2 * before[0] // 10_000)
        heavy = lambda x: x.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).where(F.col("n") > most).select("a", "m", F.ceil(F.col("n") / most).alias("parts"))
        both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")
        hot = heavy(both)
        large = _neighbours(both, hot).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        small = _neighbours(large, heavy(large.join(F.broadcast(hot.select("a")), "a", "left_semi")))
        e = cut(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")))
        if (now := state(e)) == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): weakly connected components, named after their smallest node (``roots``)."""
    found = roots(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("node").alias("id"), "root")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the component with most nodes, the smallest name among equals."""
    found = components(nodes, edges)
    first = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return found.join(F.broadcast(first.select("component")), "component", "left_semi").select("id")


def modularity(edges: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity): of an undirected reading of the weighted edges."""
    rows = with_communities(edges, partition)
    ends = rows.select(F.explode(F.array(F.struct(F.col("ci").alias("c"), F.col("w"), (F.col("ci") == F.col("cj")).alias("i")), F.struct(F.col("cj").alias("c"), F.col("w"), F.lit(False).alias("i")))).alias("e")).select("e.*")
    per = ends.groupBy("c").agg(F.sum("w").alias("d"), F.sum(F.when(F.col("i"), F.col("w")).otherwise(0)).alias("inside"))
    total = F.sum("d").cast("double") / 2.0
    squares = F.sum(F.col("d").cast("double") * F.col("d").cast("double"))
    return per.agg((F.sum("inside").cast("double") / total - F.lit(resolution) * squares / (F.lit(4.0) * total * total)).alias("modularity"))


def leaders(degrees: DataFrame, least: int = 1) -> DataFrame:
    """(community, id, degree, size): the node of highest degree in each community of at least so many nodes; the smallest id among equals."""
    best = F.min(F.struct((-F.col("degree")).alias("d"), "id"))
    found = degrees.groupBy("community").agg(best.alias("b"), F.count("*").alias("size")).where(F.col("size") >= least)
    return found.select("community", F.col("b.id").alias("id"), (-F.col("b.d")).alias("degree"), "size")


def weight_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.avg("w").alias("mean"), F.round(F.stddev_samp("w"), 6).alias("sd"), F.expr("percentile(w, 0.5)").alias("median"))


def _both(edges: DataFrame) -> DataFrame:
    """Undirected edges (src, dst, w) from either end, without loops: (v, u, w)."""
    ends = F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("u")), F.struct(F.col("dst").alias("v"), F.col("src").alias("u")))
    return edges.where("src <> dst").select(F.explode(ends).alias("e"), "w").select("e.v", "e.u", "w")


def _quality(edges: DataFrame, nodes: DataFrame, scale: float) -> float:
    """Weight inside the communities c of nodes (id, s, c) less what their sizes lead one to expect."""
    inside = with_communities(edges, nodes.select("id", F.col("c").alias("community"))).where("ci = cj").agg(F.sum("w").alias("w")).first().w or 0.0
    squares = nodes.groupBy("c").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("s")).first().s or 0.0
    return inside - scale * squares / 2


def _moved(edges: DataFrame, nodes: DataFrame, scale: float, part: int, parts: int, seed: int) -> DataFrame:
    """nodes (id, s, c, big) after every big one of a part of them went to the neighbouring community that gains most."""
    total = nodes.groupBy("c").agg(F.sum("s").alias("size"))
    own = nodes.join(total, "c").select(F.col("id").alias("v"), F.col("c").alias("c0"), "s", F.col("size").alias("size0"))
    turn = nodes.where("big").where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)) == part).select(F.col("id").alias("v"))
    to = _both(edges).join(turn, "v", "left_semi").join(nodes.select(F.col("id").alias("u"), "c"), "u").groupBy("v", "c").agg(F.sum("w").alias("w"))
    rows = to.join(own, "v").join(total, "c")
    there, other = F.col("c") == F.col("c0"), F.col("c") != F.col("c0")
    gain = F.col("w") - scale * F.col("s") * F.col("size")
    stay = F.coalesce(F.max(F.when(there, F.col("w"))), F.lit(0.0)) - scale * F.first("s") * (F.first("size0") - F.first("s"))
    best = rows.groupBy("v").agg(F.min(F.when(other, F.struct((-gain).alias("g"), "c"))).alias("b"), stay.alias("stay")).where(-F.col("b.g") > F.col("stay") + 1e-9)
    return nodes.join(best.select(F.col("v").alias("id"), F.col("b.c").alias("_to")), "id", "left").select("id", "s", F.coalesce("_to", "c").alias("c"), "big")


def _coarser(edges: DataFrame, nodes: DataFrame, scale: float, seed: int, least: float = 1e-3) -> DataFrame:
    """(id, to): nodes (id, s, big) merged into connected groups, each named after its smallest node.

    Nodes move in turns, a part of them at once; a turn by which the quality falls is taken back and
    the parts are made smaller. It ends when each part's turn in a row gains less than ``least`` of the edges' weight.
    """
    now = written(nodes.select("id", "s", F.col("id").alias("c"), "big"))
    weight = edges.agg(F.sum("w").alias("w")).first().w or 0.0
    quality, parts, turn, small = _quality(edges, now, scale), 2, 0, 0
    while small < parts and parts <= 16:
        then = written(_moved(edges, now, scale, turn % parts, parts, seed))
        q, turn = _quality(edges, then, scale), turn + 1
        if q < quality - 1e-9 * weight:
            parts, small = 2 * parts, 0
            continue
        small = small + 1 if q - quality < least * weight else 0
        now, quality = then, q
    ends = with_communities(edges, now.select("id", F.col("c").alias("community"))).where("ci = cj")
    found = roots(ends.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("to"))


#: Nodes whose state of a few numbers each is held by the driver and broadcast.
HELD = 4_000_000


def communities(nodes: DataFrame | None, edges: DataFrame, resolution: float = 1.0, objective: str = "modularity", seed: int = 7, largest: int = 2_000_000, held: int = HELD, merged: bool = False) -> DataFrame:
    """(id, community): Leiden communities of each weakly connected component, named after their smallest node.

    Components are independent, and each of at most ``largest`` edges is clustered by one task. The nodes of
    larger ones move by sweeps over blocks of edges, with the state of all nodes broadcast (``blocks``). A network
    of more than ``held`` nodes is too large for that: the nodes of its large components are first merged into
    connected groups by rounds of joins, until they are few enough or no move gains. Nothing is left out. Nodes
    without an edge are communities of their own; no nodes given: all that have edges. ``merged`` edges are stored
    and undirected already, none of them twice.
    """
    from citeflow.operators.blocks import clustered
    from citeflow.operators.leiden import leiden_frame

    weight = F.col("w").cast("double").alias("w")
    rows = edges.select("src", "dst", weight) if merged else written(symmetrise(edges).select("src", "dst", weight))
    total = rows.agg(F.sum("w").alias("m")).first().m or 1.0
    scale = resolution / (2.0 * total) if objective == "modularity" else resolution
    member = None  # (id, to): the group that a node is in, once there are groups
    ends = endpoints(rows)
    size = written(ends.groupBy("id").agg((F.sum("w") if objective == "modularity" else F.lit(1.0)).alias("s")))
    while True:
        if size.count() <= held:
            local = size.toArrow().sort_by("id")
            shared = _shared(rows)
            found = clustered(rows, local["id"].to_numpy(), local["s"].to_numpy(), scale, seed, largest, lambda: f"{shared}/table-{uuid.uuid4().hex}")
            break
        points = size.select("id")
        parts = written(components(points, rows))
        rows_in = rows.join(parts.select(F.col("id").alias("src"), "component"), "src")
        counts = written(rows_in.groupBy("component").agg(F.count("*").alias("n")))
        big = counts.where(F.col("n") > largest).select("component")
        step = None
        if not big.isEmpty():
            at = parts.join(big.withColumn("_big", F.lit(True)), "component", "left").select("id", F.coalesce("_big", F.lit(False)).alias("big"))
            step = written(_coarser(rows, size.join(at, "id"), scale, seed))
        if step is None or step.where("id <> to").isEmpty():
            rows_in = rows_in.join(big, "component", "left_anti")  # no move gains: the groups of large components are their communities
            sized = rows_in.join(size.select(F.col("id").alias("src"), F.col("s").alias("src_size")), "src").join(size.select(F.col("id").alias("dst"), F.col("s").alias("dst_size")), "dst")
            run = lambda pdf: leiden_frame(pdf, scale, seed)
            found = sized.groupBy("component").applyInPandas(run, "id long, community long")
            break
        member = step if member is None else written(member.join(step.select(F.col("id").alias("to"), F.col("to").alias("_to")), "to").select("id", F.col("_to").alias("to")))
        a, b = (step.select(F.col("id").alias(c), F.col("to").alias(f"_{c}")) for c in ("src", "dst"))
        rows = written(rows.join(a, "src").join(b, "dst").groupBy(F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst")).agg(F.sum("w").alias("w")))
        size = written(size.join(step, "id").groupBy(F.col("to").alias("id")).agg(F.sum("s").alias("s")))
    if member is not None:
        found = member.join(found.withColumnRenamed("id", "to"), "to", "left").select("id", F.coalesce("community", "to").alias("community"))
    points = endpoints(edges).select("id").distinct() if nodes is None else nodes.select("id")
    if nodes is None and size.count() <= held and member is None:
        return found  # has all nodes
    return points.join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))
