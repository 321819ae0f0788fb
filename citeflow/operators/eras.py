"""Years, eras, node lists and edge lists of a citation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeflow.operators.network import cut

#: Eras of a literature, (first year, last year); from 2009 on each year is one.
ERAS = [(1907, 1944), (1945, 1945), (1946, 1955), (1956, 1965), (1966, 1975), (1976, 1985), (1986, 1990), (1991, 1995), (1996, 2000), (2001, 2005), (2006, 2008), *((y, y) for y in range(2009, 2021))]
UNKNOWN = 999


def era_index(spark: SparkSession, eras: list[tuple[int, int]] = ERAS) -> DataFrame:
    """(era, start, end), eras numbered from 1."""
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(eras, 1)], "era int, start int, end int")


def era_of(year: Column, eras: list[tuple[int, int]] = ERAS) -> Column:
    """The era of a year, null outside all; a projection, as the index is a short constant."""
    out = F.lit(None).cast("int")
    for k, (a, b) in reversed(list(enumerate(eras, 1))):
        out = F.when(year.between(a, b), F.lit(k)).otherwise(out)
    return out


def year_counts(rows: DataFrame, year: str = "year") -> DataFrame:
    return rows.where(F.col(year).isNotNull()).groupBy(year).agg(F.count("*").alias("n"))


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that comes first by order, in one aggregation with partial sums (no window, so no hot key)."""
    rest = [c for c in rows.columns if c not in keys]
    ranked = F.min(F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(f"_{k}") for k, c in enumerate(order)], F.struct(*rest).alias("row")))
    return rows.groupBy(*keys).agg(ranked.alias("_first")).select(*keys, "_first.row.*").select(*rows.columns)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with numbers 1, 2, 3 ... in a unique order, without all rows in one task.

    Ranges of the order are numbered by themselves, and one row for each range is summed up
    in one place.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbers = placed.withColumn("_own", own).join(F.broadcast(before), "_part")
    return numbers.withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")


def node_list(citations: DataFrame) -> DataFrame:
    """(node_id, node_label, role): citing labels, then the cited ones that cite nothing.

    ``citations`` has source_label and target_label. Each label is there once, as sender if it
    ever cites. Nodes are numbered by role, then label.
    """
    both = citations.select(F.col("source_label").alias("node_label"), F.lit(0).alias("r")).unionAll(citations.select(F.col("target_label").alias("node_label"), F.lit(1).alias("r")))
    nodes = both.where("node_label IS NOT NULL").groupBy("node_label").agg(F.min("r").alias("r"))
    ranked = numbered(nodes, ["r", "node_label"], "node_id")
    return ranked.select("node_id", "node_label", F.when(F.col("r") == 0, "sender").otherwise("target").alias("role"))


def edge_list(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sender_id, sender_label, target_id, target_label), each citation once."""
    a = nodes.select(F.col("node_id").alias("sender_id"), F.col("node_label").alias("source_label"))
    b = nodes.select(F.col("node_id").alias("target_id"), F.col("node_label").alias("target_label"))
    rows = citations.select("source_label", "target_label").join(a, "source_label").join(b, "target_label")
    return rows.select("sender_id", F.col("source_label").alias("sender_label"), "target_id", "target_label")


def node_eras(citations: DataFrame, eras: list[tuple[int, int]] = ERAS) -> DataFrame:
    """(node_label, year, era): each label's earliest year, citing or cited; 999 where no era has it.

    A table's rows have no order of their own, so it is the earliest year and not the first row's.
    """
    both = citations.select(F.col("source_label").alias("node_label"), "year").unionAll(citations.select(F.col("target_label").alias("node_label"), "year"))
    first = both.groupBy("node_label").agg(F.min("year").alias("year"))
    return first.select("node_label", "year", F.coalesce(era_of(F.col("year"), eras), F.lit(UNKNOWN)).alias("era"))


def author_partition(names: DataFrame, key: Column) -> DataFrame:
    """(label, author_id): equal keys are one author, numbered by sorted key; null and empty keys have none."""
    rows = names.select("label", key.alias("key")).where("key <> ''").groupBy("label").agg(F.min("key").alias("key"))
    ids = numbered(rows.select("key").distinct(), ["key"], "author_id")
    return rows.join(ids, "key").select("label", "author_id")


def id_map(vertices: DataFrame, nodes: DataFrame, partition: DataFrame) -> DataFrame:
    """Vertices of a network file with their article and community, by label and by vertex number; misses stay with nulls."""
    return vertices.join(nodes, "node_label", "left").join(partition, "vertex_id", "left")
