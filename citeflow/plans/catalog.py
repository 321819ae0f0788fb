"""Registered queries: the operators over the star-schema tables, each with DuckDB SQL for the same rows.

How the tables are read: an order line is a citation of a part by a customer in the year it was
shipped; a customer's community is its nation, a part's the number of its brand; nations are a network
of who buys from where, grouped in regions; documents are abstracts, grouped by source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeflow.functions import scalar
from citeflow.operators import eras, flow, network, text
from citeflow.sources import pajek

#: Eras of the tables' years.
ERAS = [(1995, 1996), (1997, 1998), (1999, 1999), (2000, 2000), (2001, 2001)]
ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def citations(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").select(*ORDER)
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("sender"))
    year = F.year("l_shipdate")
    return lines.join(orders, "l_orderkey").select("sender", F.col("l_partkey").alias("target"), year.alias("year"), eras.era_of(year, ERAS).alias("era"), *ORDER)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    c = citations(spark, sf)
    return c.select(F.concat(F.lit("C"), F.col("sender").cast("string")).alias("source_label"), F.concat(F.lit("P"), F.col("target").cast("string")).alias("target_label"), "year")


def senders(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("sender"), F.col("c_nationkey").alias("sender_community"))


def targets(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("target"), F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("target_community"))


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("community"))


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """The nation network: edges (src buyer, dst seller, w lines)."""
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    orders = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    buyers = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    sellers = read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    return lines.join(sellers, "s_suppkey").join(orders, "o_orderkey").join(buyers, "c_custkey").groupBy("src", "dst").agg(F.count("*").alias("w"))


def together(spark: SparkSession, sf: str) -> DataFrame:
    """Parts (src < dst) of one order, w the number of such orders."""
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    sets = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("p"))
    first = sets.select("l_orderkey", F.posexplode("p").alias("k", "src"), "p")
    return first.select("src", F.explode(F.slice("p", F.col("k") + 2, F.size("p"))).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("w"))


def abstracts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("source").alias("community"), F.col("doc_id").alias("place"), "text")


_YEAR_ERA = "CASE WHEN y BETWEEN 1995 AND 1996 THEN 1 WHEN y BETWEEN 1997 AND 1998 THEN 2 WHEN y = 1999 THEN 3 WHEN y = 2000 THEN 4 WHEN y = 2001 THEN 5 END"
_C = f"c AS (SELECT o_custkey AS sender, l_partkey AS target, l.*, year(l_shipdate) AS y FROM lineitem l JOIN orders ON l_orderkey = o_orderkey), e AS (SELECT *, {_YEAR_ERA} AS era FROM c)"
_SHARED = _C + """, n AS (SELECT target, sender FROM e WHERE era = 4 QUALIFY row_number() OVER (PARTITION BY target ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice, sender) = 1),
s AS (SELECT target, sender FROM n WHERE target IN (SELECT target FROM e WHERE era = 3))"""
_FLOW = _SHARED + """, g AS (SELECT c_nationkey AS sender_community, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS target_community, count(*) AS n
FROM s JOIN customer ON c_custkey = sender JOIN part ON p_partkey = target GROUP BY ALL),
f AS (SELECT *, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY sender_community) AS DOUBLE) AS proportion FROM g)"""
_NODES = _FLOW + """, v AS (SELECT row_number() OVER (ORDER BY role, community) AS node_id, role, community FROM
(SELECT DISTINCT 'sender' AS role, sender_community AS community FROM f UNION ALL SELECT DISTINCT 'target', target_community FROM f))"""
_N = "t AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), p AS (SELECT n_nationkey AS id, n_regionkey AS community FROM nation)"
_P = "l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), q AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS w FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL)"
_LABELS = _C + ", b AS (SELECT 'C' || sender AS source_label, 'P' || target AS target_label, y FROM c), v AS (SELECT row_number() OVER (ORDER BY r, node_label) AS node_id, node_label, CASE r WHEN 0 THEN 'sender' ELSE 'target' END AS role FROM (SELECT node_label, min(r) AS r FROM (SELECT source_label AS node_label, 0 AS r FROM b UNION ALL SELECT target_label, 1 FROM b) GROUP BY 1))"


def shared(spark: SparkSession, sf: str) -> DataFrame:
    return flow.shared_targets(citations(spark, sf), 3, 4, ORDER)


def community_flow(spark: SparkSession, sf: str) -> DataFrame:
    return flow.flow(shared(spark, sf), senders(spark, sf), targets(spark, sf))


@query(f"WITH {_SHARED} SELECT * FROM s")
def shared_targets(spark, sf):
    return shared(spark, sf)


@query(f"WITH {_FLOW} SELECT * FROM f")
def flow_share(spark, sf):
    return community_flow(spark, sf)


@query(f"WITH {_NODES} SELECT * FROM v")
def flow_network_nodes(spark, sf):
    return flow.network_nodes(community_flow(spark, sf))


@query(f"WITH {_NODES} SELECT a.node_id AS sender_id, b.node_id AS target_id, n, proportion FROM f JOIN v a ON a.role = 'sender' AND a.community = sender_community JOIN v b ON b.role = 'target' AND b.community = target_community")
def flow_network_edges(spark, sf):
    return flow.network_edges(network.cut(community_flow(spark, sf)))


@query(f"WITH {_NODES} SELECT node_id, role || '_' || community AS label, CASE role WHEN 'sender' THEN 1 ELSE 2 END AS role_id FROM v")
def flow_roles(spark, sf):
    nodes = flow.network_nodes(community_flow(spark, sf))
    return flow.roles(nodes.select("node_id", F.concat_ws("_", "role", F.col("community").cast("string")).alias("label")))


@query(f"WITH {_C} SELECT y AS year, count(*) AS n FROM c GROUP BY 1")
def year_counts(spark, sf):
    return eras.year_counts(read(spark, sf, "lineitem").select(F.year("l_shipdate").cast("long").alias("year")))


@query(f"WITH {_C} SELECT y AS year, era, count(*) AS n FROM e GROUP BY ALL")
def year_era(spark, sf):
    years = read(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year")).groupBy("year").agg(F.count("*").alias("n"))
    index = eras.era_index(spark, ERAS)
    return years.join(F.broadcast(index), F.col("year").between(F.col("start"), F.col("end")), "left").select(F.col("year").cast("long").alias("year"), "era", "n")


@query(f"WITH {_LABELS} SELECT * FROM v")
def node_list(spark, sf):
    return eras.node_list(labelled(spark, sf))


@query(f"WITH {_LABELS} SELECT a.node_id AS sender_id, source_label AS sender_label, z.node_id AS target_id, target_label FROM b JOIN v a ON a.node_label = source_label JOIN v z ON z.node_label = target_label")
def edge_list(spark, sf):
    rows = labelled(spark, sf)
    return eras.edge_list(rows, eras.node_list(rows))


@query(f"WITH {_C}, b AS (SELECT 'C' || sender AS node_label, y FROM c UNION ALL SELECT 'P' || target, y FROM c), m AS (SELECT node_label, min(y) AS y FROM b GROUP BY 1) SELECT node_label, y AS year, coalesce(CASE WHEN y = 1999 THEN 3 WHEN y = 2000 THEN 4 WHEN y = 2001 THEN 5 WHEN y BETWEEN 1997 AND 1998 THEN 2 END, 999) AS era FROM m")
def node_era_999(spark, sf):
    later = [(9999, 9999), *ERAS[1:]]  # the first era is left out, so that some nodes have none
    return eras.node_eras(labelled(spark, sf), later).withColumn("year", F.col("year").cast("long"))


@query("WITH n AS (SELECT c_name AS label FROM customer UNION ALL SELECT s_name FROM supplier), k AS (SELECT label, min(regexp_replace(regexp_replace(lower(label), '[[:punct:]]', '', 'g'), '\\s+', '', 'g')) AS key FROM n GROUP BY 1) SELECT label, dense_rank() OVER (ORDER BY key) AS author_id FROM k")
def author_partition(spark, sf):
    names = read(spark, sf, "customer").select(F.col("c_name").alias("label")).unionAll(read(spark, sf, "supplier").select("s_name"))
    return eras.author_partition(names, scalar.author_key(F.col("label")))


@query(f"WITH {_C} SELECT p_partkey AS target, p_name AS name, k.sender AS first_sender FROM part LEFT JOIN (SELECT target, min(sender) AS sender FROM e WHERE era = 5 GROUP BY 1) k ON target = p_partkey")
def id_map_left(spark, sf):
    last = citations(spark, sf).where("era = 5").groupBy("target").agg(F.min("sender").alias("first_sender"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("target"), F.col("p_name").alias("name")).join(last, "target", "left")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_filter(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_filter(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"WITH {_N} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM t UNION ALL SELECT dst FROM t) GROUP BY 1")
def total_degree(spark, sf):
    return network.total_degree(trade(spark, sf))


_IN = _N + ", i AS (SELECT t.* FROM t JOIN p a ON a.id = src JOIN p b ON b.id = dst WHERE a.community = b.community), d AS (SELECT p.id, community, count(x.id) AS degree FROM p LEFT JOIN (SELECT src AS id FROM i UNION ALL SELECT dst FROM i) x ON x.id = p.id GROUP BY ALL)"


@query(f"WITH {_IN} SELECT * FROM d")
def ingroup_degree(spark, sf):
    return network.ingroup_degree(trade(spark, sf), nations(spark, sf))


@query(f"WITH {_IN} SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS place FROM d")
def degree_rank(spark, sf):
    return network.degree_rank(network.ingroup_degree(trade(spark, sf), nations(spark, sf)))


@query(f"WITH {_IN} SELECT * FROM i")
def ingroup_network(spark, sf):
    return network.ingroup_edges(trade(spark, sf), nations(spark, sf))


def _thin(table_: str, k: int) -> str:
    return f"u AS (SELECT src AS id, * FROM {table_} UNION ALL SELECT dst, * FROM {table_} WHERE src <> dst), r AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, src, dst) <= {k}) SELECT DISTINCT src, dst, w FROM r"


@query(f"WITH {_N}, {_thin('t', 3)}")
def thin_topk(spark, sf):
    return network.thin(trade(spark, sf), 3)


@query(f"WITH {_N}, y AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(sum(w) AS BIGINT) AS w FROM t WHERE src <> dst GROUP BY 1, 2), {_thin('y', 3)}")
def thin_topk_sym(spark, sf):
    return network.thin(trade(spark, sf), 3, symmetric=True, loops=False)


@query(f"WITH {_P}, {_thin('q', 2)}")
def thin_parts(spark, sf):
    return network.thin(together(spark, sf), 2)


@query(f"WITH {_P} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT src FROM q UNION ALL SELECT dst FROM q)")
def isolates(spark, sf):
    return network.isolates(read(spark, sf, "part").select(F.col("p_partkey").alias("id")), together(spark, sf))


@query(f"WITH {_N} SELECT * FROM t WHERE src IN (SELECT id FROM p WHERE community < 2) AND dst IN (SELECT id FROM p WHERE community < 2)")
def induced_subgraph(spark, sf):
    return network.induced(trade(spark, sf), nations(spark, sf).where("community < 2"))


_SHRUNK = "SELECT a.community AS ci, b.community AS cj, CAST(sum(w) AS BIGINT) AS w FROM t JOIN p a ON a.id = src JOIN p b ON b.id = dst"


@query(f"WITH {_N} {_SHRUNK} GROUP BY ALL")
def shrink_graph(spark, sf):
    return network.shrink(trade(spark, sf), nations(spark, sf))


_MIX = _N + f""", s AS ({_SHRUNK} WHERE src <> dst GROUP BY ALL), k AS (SELECT DISTINCT community FROM p),
g AS (SELECT a.community AS ci, b.community AS cj, coalesce(s.w, 0) AS observed FROM k a CROSS JOIN k b LEFT JOIN s ON s.ci = a.community AND s.cj = b.community),
x AS (SELECT *, CAST(sum(observed) OVER (PARTITION BY ci) AS DOUBLE) * CAST(sum(observed) OVER (PARTITION BY cj) AS DOUBLE) / CAST(sum(observed) OVER () AS DOUBLE) AS expected FROM g)"""


@query(f"WITH {_MIX} SELECT ci, cj, CAST(observed AS BIGINT) AS observed FROM g")
def mixing_matrix(spark, sf):
    return network.mixing(trade(spark, sf), nations(spark, sf)).select("ci", "cj", "observed")


@query(f"WITH {_MIX} SELECT ci, cj, expected FROM x")
def mixing_expected(spark, sf):
    return network.mixing(trade(spark, sf), nations(spark, sf)).select("ci", "cj", "expected")


@query(f"WITH {_MIX} SELECT ci, cj, CAST(observed AS BIGINT) AS observed, expected, sign(observed - expected) * (observed - expected) * (observed - expected) / expected AS weight FROM x")
def mixing_chisq(spark, sf):
    return network.mixing(trade(spark, sf), nations(spark, sf))


@query(f"WITH {_N} SELECT avg(w) AS mean, round(stddev_samp(w), 6) AS sd, median(w) AS median FROM t")
def tie_weight_stats(spark, sf):
    return network.weight_stats(trade(spark, sf))


@query("SELECT c_nationkey AS community, count(*) AS size FROM customer GROUP BY 1")
def community_sizes(spark, sf):
    return read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("community")).agg(F.count("*").alias("size"))


@query(f"WITH {_IN} SELECT community, id, degree, count(*) OVER (PARTITION BY community) AS size FROM d QUALIFY row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) = 1")
def community_leaders(spark, sf):
    return network.leaders(network.ingroup_degree(trade(spark, sf), nations(spark, sf)))


@query("SELECT c_nationkey AS community, count(*) AS size FROM customer GROUP BY 1 HAVING count(*) >= 60")
def large_communities(spark, sf):
    return community_sizes(spark, sf).where("size >= 60")


@query(f"WITH {_N}, z AS (SELECT a.community AS ci, b.community AS cj, w FROM t JOIN p a ON a.id = src JOIN p b ON b.id = dst), d AS (SELECT c, sum(w) AS d, sum(i) AS inside FROM (SELECT ci AS c, w, CASE WHEN ci = cj THEN w ELSE 0 END AS i FROM z UNION ALL SELECT cj, w, 0 FROM z) GROUP BY 1) SELECT round(CAST(sum(inside) AS DOUBLE) / (CAST(sum(d) AS DOUBLE) / 2) - CAST(sum(d * d) AS DOUBLE) / (4.0 * (CAST(sum(d) AS DOUBLE) / 2) * (CAST(sum(d) AS DOUBLE) / 2)), 12) AS modularity FROM d")
def modularity(spark, sf):
    return network.modularity(trade(spark, sf), nations(spark, sf)).select(F.round("modularity", 12).alias("modularity"))


@query()
def components(spark, sf):
    edges = network.cut(together(spark, sf))
    return network.components(network.endpoints(edges).select("id").distinct(), edges)


@query()
def largest_component(spark, sf):
    edges = network.cut(together(spark, sf))
    return network.largest_component(network.endpoints(edges).select("id").distinct(), edges)


@query()
def leiden(spark, sf):
    return network.communities(None, network.written(together(spark, sf)), merged=True)


_FRACTION = _N.replace("count(*) AS w", "round(sum(CAST(l_discount AS DECIMAL(12,2))), 2)::DOUBLE AS w", 1)


def fractional(spark: SparkSession, sf: str) -> DataFrame:
    """The nation network with the sum of the lines' discounts as weight."""
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"), F.col("l_discount").cast("decimal(12,2)").alias("d"))
    orders = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    buyers = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    sellers = read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    return lines.join(sellers, "s_suppkey").join(orders, "o_orderkey").join(buyers, "c_custkey").groupBy("src", "dst").agg(F.sum("d").cast("double").alias("w"))


@query(f"WITH {_FRACTION}, s AS (SELECT a.community AS ci, b.community AS cj, sum(w) AS w FROM t JOIN p a ON a.id = src JOIN p b ON b.id = dst WHERE src <> dst GROUP BY ALL), k AS (SELECT DISTINCT community FROM p), g AS (SELECT a.community AS ci, b.community AS cj, coalesce(s.w, 0) AS observed FROM k a CROSS JOIN k b LEFT JOIN s ON s.ci = a.community AND s.cj = b.community), x AS (SELECT *, sum(observed) OVER (PARTITION BY ci) * sum(observed) OVER (PARTITION BY cj) / sum(observed) OVER () AS expected FROM g) SELECT ci, cj, round(observed, 6) AS observed, round(expected, 6) AS expected, round(sign(observed - expected) * (observed - expected) * (observed - expected) / expected, 6) AS weight FROM x")
def mixing_fractional(spark, sf):
    return network.mixing(fractional(spark, sf), nations(spark, sf)).select("ci", "cj", *(F.round(c, 6).alias(c) for c in ("observed", "expected", "weight")))


@query(f"WITH {_FRACTION}, z AS (SELECT a.community AS ci, b.community AS cj, w FROM t JOIN p a ON a.id = src JOIN p b ON b.id = dst), d AS (SELECT c, sum(w) AS d, sum(i) AS inside FROM (SELECT ci AS c, w, CASE WHEN ci = cj THEN w ELSE 0 END AS i FROM z UNION ALL SELECT cj, w, 0 FROM z) GROUP BY 1) SELECT round(sum(inside) / (sum(d) / 2) - sum(d * d) / (sum(d) * sum(d)), 9) AS modularity FROM d")
def modularity_fractional(spark, sf):
    return network.modularity(fractional(spark, sf), nations(spark, sf)).select(F.round("modularity", 9).alias("modularity"))


@query(f"WITH {_N} SELECT id, round(sqrt(count(*)), 9) AS size FROM (SELECT src AS id FROM t UNION ALL SELECT dst FROM t) GROUP BY 1")
def vertex_size(spark, sf):
    return network.total_degree(trade(spark, sf)).select("id", F.round(F.sqrt("degree"), 9).alias("size"))


@query(f"WITH {_N} SELECT * FROM t WHERE src IN (SELECT id FROM p WHERE community = 1) OR dst IN (SELECT id FROM p WHERE community = 1)")
def ego_network(spark, sf):
    return network.ego(trade(spark, sf), nations(spark, sf).where("community = 1"))


@query(f"WITH {_IN} SELECT id, community, CAST(degree AS DOUBLE) AS degree FROM d")
def degree_files(spark, sf):
    ranked = network.ingroup_degree(trade(spark, sf), nations(spark, sf))
    place = F.row_number().over(Window.partitionBy("community").orderBy("id"))
    vectors = ranked.select(F.col("community").alias("net_id"), place.alias("id"), F.col("degree").cast("double").alias("value"))
    return network.degrees_of_files(vectors, nations(spark, sf))


@query(f"WITH {_LABELS} SELECT p_partkey AS vertex_id, 'P' || p_partkey AS node_label, node_id, role, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS community FROM part LEFT JOIN v ON node_label = 'P' || p_partkey")
def id_map(spark, sf):
    vertices = read(spark, sf, "part").select(F.col("p_partkey").alias("vertex_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node_label"))
    partition = targets(spark, sf).select(F.col("target").alias("vertex_id"), F.col("target_community").alias("community"))
    return eras.id_map(vertices, eras.node_list(labelled(spark, sf)), partition)


@query(f"WITH {_NODES} SELECT node_id, role, community, CASE role WHEN 'sender' THEN n_name ELSE b END AS theme FROM v LEFT JOIN nation ON n_nationkey = community LEFT JOIN (SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS k, p_brand AS b FROM part) ON k = community")
def flow_themes(spark, sf):
    nodes = flow.network_nodes(community_flow(spark, sf))
    brands = read(spark, sf, "part").select(F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int").alias("community_id"), F.col("p_brand").alias("theme")).distinct()
    return flow.with_themes(nodes, read(spark, sf, "nation").select(F.col("n_nationkey").alias("community_id"), F.col("n_name").alias("theme")), brands)


@query("SELECT source AS file_id, doc_id AS article_id, concat_ws(' ', source, lang) AS title, concat_ws(',', lang, source) AS keywords, text AS abstract FROM documents")
def article_texts(spark, sf):
    corpus = read(spark, sf, "documents").select(F.col("source").alias("file_id"), F.col("doc_id").alias("article_id"), F.array(F.lit("TI"), "source", "lang").alias("TI"), F.array(F.lit("ID"), F.concat("lang", F.lit(" ; ")), "source").alias("ID"), F.array(F.lit("AB"), "text").alias("AB"))
    return text.article_texts(corpus)


@query(f"WITH {_LABELS} SELECT p_size AS file_id, p_partkey AS article_id, p_name AS title, doi, node_id, node_id % 10 AS community FROM part LEFT JOIN (SELECT DISTINCT target AS k, 'P' || target AS doi FROM c) ON k = p_partkey LEFT JOIN v ON node_label = doi")
def article_ids(spark, sf):
    articles = read(spark, sf, "part").select(F.col("p_size").alias("file_id"), F.col("p_partkey").alias("article_id"), F.col("p_name").alias("title"))
    cited = citations(spark, sf).select(F.col("target").alias("article_id"), F.concat(F.lit("P"), F.col("target").cast("string")).alias("doi")).join(articles.select("file_id", "article_id"), "article_id")
    nodes = network.cut(eras.node_list(labelled(spark, sf)))
    return text.identified(articles, cited, nodes, nodes.select(F.col("node_id").alias("id"), (F.col("node_id") % 10).alias("community")))


@query(f"WITH {_N} SELECT a.n_nationkey AS src, list(coalesce(CAST(t.w AS DOUBLE), 0) ORDER BY b.n_nationkey) AS row FROM nation a CROSS JOIN nation b LEFT JOIN t ON t.src = a.n_nationkey AND t.dst = b.n_nationkey GROUP BY 1")
def adjacency(spark, sf):
    return network.adjacency(trade(spark, sf), nations(spark, sf))


@query(f"WITH {_N} SELECT src, dst, CAST(w AS DOUBLE) AS w FROM t")
def adjacency_edges(spark, sf):
    return network.from_adjacency(adjacency(spark, sf), nations(spark, sf))


_CORE = "r AS (SELECT source AS community, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), c AS (SELECT community, coalesce(string_agg(text, ' ' ORDER BY k) FILTER (k <= 5), '') AS core_text, coalesce(string_agg(text, ' ' ORDER BY k) FILTER (k > 5), '') AS rest_text, count(*) FILTER (k <= 5) AS n_core, count(*) FILTER (k > 5) AS n_rest FROM r GROUP BY 1)"


@query(f"WITH {_CORE} SELECT community, core_text, n_core FROM c")
def core_text(spark, sf):
    return text.core_and_rest(abstracts(spark, sf)).select("community", "core_text", "n_core")


@query(f"WITH {_CORE} SELECT community, rest_text, n_rest FROM c")
def minor_text(spark, sf):
    return text.core_and_rest(abstracts(spark, sf)).select("community", "rest_text", "n_rest")


_THEME = _CORE + """, b AS (SELECT *, (SELECT max(length(core_text)) FROM c) - length(core_text) AS room FROM c), x AS (SELECT *, substring(rest_text, 1, room) AS part FROM b),
y AS (SELECT *, CASE WHEN strpos(part, '.') = 0 THEN -1 ELSE length(part) - strpos(reverse(part), '.') + 1 END AS stop, length(core_text) < 8000 AND length(rest_text) > 0 AS supplemented FROM x),
z AS (SELECT community, supplemented, CASE WHEN NOT supplemented THEN core_text ELSE core_text || ' ' || CASE WHEN length(rest_text) <= room THEN rest_text WHEN stop > room * 0.8 THEN substring(part, 1, stop) ELSE part END END AS theme_text FROM y)"""


@query(f"WITH {_THEME} SELECT community, theme_text, supplemented FROM z")
def theme_text(spark, sf):
    return text.within_budget(text.core_and_start(abstracts(spark, sf)))


@query(f"WITH {_THEME} SELECT community, concat('{text.INSTRUCTION}', ' ', '{text.ABOUT}', ' ', community, ' ', '{text.BEFORE}', ' ', theme_text, ' ', '{text.AFTER}', ' ', '{text.ASK}') AS prompt FROM z")
def prompt_text(spark, sf):
    return text.prompts(theme_text(spark, sf)).select("community", "prompt")


@query("SELECT doc_id, array_to_string(list_transform(CASE WHEN len(s) > 1 AND s[-1] = '' THEN s[:-2] ELSE s END, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), ',') AS keywords FROM (SELECT doc_id, string_split(text, '.') AS s FROM documents)")
def keyword_normalise(spark, sf):
    return read(spark, sf, "documents").select("doc_id", scalar.normalise_list(F.col("text"), r"\.").alias("keywords"))


@query("SELECT doc_id, least(round_even(180 + n_chars / 1000 * 18, 0), 1200.0) AS timeout FROM documents")
def label_timeout(spark, sf):
    return read(spark, sf, "documents").select("doc_id", scalar.request_timeout(F.col("n_chars")).alias("timeout"))


@query("WITH a AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents), b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace('Theme: \"' || t, '^(Here is|Here''s|The theme is|Theme:|A theme could be):?\\s*', '', 'i'), '^[\"'']|[\"'']$', '', 'g'), '\\n.*', '', 's'), '\\.$', '') AS t FROM a) SELECT doc_id, regexp_replace(string_split(t, '.')[1], '^\\s+|\\s+$', '', 'g') AS theme FROM b")
def theme_clean(spark, sf):
    reply = F.concat(F.lit('Theme: "'), scalar.strip(F.col("text")))
    return read(spark, sf, "documents").select("doc_id", scalar.clean_theme(reply).alias("theme"))


_CHUNKS = "WITH RECURSIVE n AS (SELECT conv_id AS community, count(*) AS n, row_number() OVER (ORDER BY conv_id) AS k FROM conversations GROUP BY 1), f AS (SELECT k, community, n, CAST(1 AS BIGINT) AS chunk, n AS held FROM n WHERE k = 1 UNION ALL SELECT n.k, n.community, n.n, CASE WHEN f.held + n.n > 20 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.held + n.n > 20 THEN n.n ELSE f.held + n.n END FROM f JOIN n ON n.k = f.k + 1) SELECT community, n, chunk FROM f"


@query(_CHUNKS)
def chunk_ids(spark, sf):
    return text.chunks(read(spark, sf, "conversations").select(F.col("conv_id").alias("community")), 20)


@query(f"WITH {_THEME} SELECT community AS community_id, regexp_replace(string_split(array_to_string(list_filter(regexp_split_to_array(theme_text, '\\s+'), lambda x: x <> '')[1:5], ' '), '.')[1], '^\\s+|\\s+$', '', 'g') AS theme, 'success' AS status FROM z")
def label_stub(spark, sf):
    return text.label(text.prompts(theme_text(spark, sf))).select("community_id", "theme", "status")


@query("SELECT n_nationkey AS place, n_name AS name, n_regionkey AS community, r_name AS theme FROM nation LEFT JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey = 2")
def theme_lookup(spark, sf):
    rows = read(spark, sf, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("community"))
    themes = read(spark, sf, "region").select(F.col("r_regionkey").alias("community_id"), F.col("r_name").alias("theme"))
    return text.lookup(rows, 2, themes)


@query("""WITH k AS (SELECT count(DISTINCT n_regionkey) AS k FROM nation), h AS (SELECT unnest(['NETBEGIN 1', 'CLUBEGIN 1', 'PERBEGIN 1', 'CLSBEGIN 1', 'HIEBEGIN 1', 'VECBEGIN 1', '% Reading Network   ---    C:\\n\\a.net', 'N 1 RDN C:\\n\\a.net',
'% Reading Partition   ---    C:\\n\\a.clu', 'C 1 RDC C:\\n\\a.clu', '% Extracting Subnetworks induced by each selected Cluster', 'N ' || (k + 1) || ' EXTNETALL 1 1 [1-*]']) AS line, unnest(range(1, 13)) AS ord FROM k),
g AS (SELECT i, unnest(['% All degree centrality of ' || (i + 1) || '. Subnetwork of N1 induced by C1 [' || i || ']', 'V ' || i || ' DEGV ' || (i + 1) || ' [2]', '% Saving vector to file   ---    C:\\out\\total_degree_community_' || i || '.vec', 'V ' || i || ' WV C:\\out\\total_degree_community_' || i || '.vec 0']) AS line, unnest(range(1, 5)) AS p FROM k, generate_series(1, k) AS s(i))
SELECT ord, line FROM h UNION ALL SELECT 12 + (i - 1) * 4 + p, line FROM g""")
def macro_lines(spark, sf):
    return pajek.macro(spark, nations(spark, sf), "/n/a.net", "/n/a.clu", "/out")


@query("SELECT page_id, 'C:\\' || array_to_string(list_filter(string_split(url, '/'), lambda x: x <> ''), '\\') AS path FROM pages")
def c_path(spark, sf):
    return read(spark, sf, "pages").select("page_id", scalar.windows_path(F.col("url")).alias("path"))


@query("SELECT c_nationkey AS id FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("id")).unionAll(read(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    return union_all(spark, sf).distinct()


@query(f"WITH {_C} SELECT target FROM e WHERE era = 3 INTERSECT SELECT target FROM e WHERE era = 4")
def intersect_targets(spark, sf):
    rows = citations(spark, sf)
    return rows.where("era = 3").select("target").intersect(rows.where("era = 4").select("target"))


@query(f"WITH {_C} SELECT target FROM e WHERE era = 3 EXCEPT SELECT target FROM e WHERE era = 4")
def except_targets(spark, sf):
    rows = citations(spark, sf)
    return rows.where("era = 3").select("target").subtract(rows.where("era = 4").select("target"))


@query(f"WITH {_N} SELECT * FROM t ORDER BY w DESC, src, dst LIMIT 10")
def top_edges(spark, sf):
    return trade(spark, sf).orderBy(F.desc("w"), "src", "dst").limit(10)


@query("SELECT page_id, coalesce(length(url) - nullif(strpos(reverse(url), '.'), 0) + 1, -1) AS last_dot, upper(url[1]) || url[2:] AS capital, url[3:8] AS middle, url[-1] AS last FROM pages")
def string_functions(spark, sf):
    url = F.col("url")
    return read(spark, sf, "pages").select("page_id", scalar.last_index(url, ".").cast("long").alias("last_dot"), scalar.capitalise(url).alias("capital"), scalar.between(url, 3, 8).alias("middle"), F.substring(url, -1, 1).alias("last"))


@query("SELECT count(*) FILTER (l_returnflag = 'R') AS returned, count(DISTINCT l_suppkey) AS suppliers, max(l_quantity) AS most, min(l_quantity) AS least, median(l_quantity) AS median FROM lineitem")
def global_aggregates(spark, sf):
    return read(spark, sf, "lineitem").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_distinct("l_suppkey").alias("suppliers"), F.max("l_quantity").alias("most"), F.min("l_quantity").alias("least"), F.expr("percentile(l_quantity, 0.5)").alias("median"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def keep_first(spark, sf):
    rows = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return eras.first_rows(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


#: Names that round 1 gave the queries over all order lines.
for _name in ("thin_parts", "isolates", "components", "largest_component", "leiden"):
    QUERIES[f"{_name}_whole"] = QUERIES[_name]
    if _name in ORACLES:
        ORACLES[f"{_name}_whole"] = ORACLES[_name]
