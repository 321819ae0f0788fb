"""Network, partition and vector files of Pajek, and its macro files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeflow.functions.scalar import windows_path


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, line) of each file, pos from 0; CRLF and LF both end a line, empty lines at the end are left out."""
    text = F.regexp_replace("value", r"(\r?\n)+$", "")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(text, r"\r?\n", -1)).alias("pos", "line"))


def sections(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their section's number from 1, its kind and the line's number in it; only a line that begins with ``*`` is a heading."""
    rows = lines(spark, path)
    head = F.col("line").rlike(r"^\s*\*")
    order = Window.partitionBy("path").orderBy("pos")
    rows = rows.withColumn("section", F.count_if(head).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kind = F.last(F.when(head, F.lower(F.regexp_extract("line", r"^\s*\*(\w+)", 1))), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("kind", kind).where(~head & (F.trim("line") != ""))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("path", "section").orderBy("pos")))


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """(section, id, label, x, y, z, shape) of the vertex sections; what a file leaves out is null.

    Fields are told by their kind: the label is quoted or the second word, coordinates are up to
    three numbers after it, the rest is the shape.
    """
    rows = sections(spark, path).where("kind = 'vertices'")
    whole = r'^\s*(\d+)\s+(?:"([^"]*)"|(\S+))((?:\s+[-+]?[0-9.]+(?:[eE][-+]?\d+)?){0,3})(?:\s+(.*?))?\s*$'
    part = lambda k: F.regexp_extract("line", whole, k)
    number = lambda k: F.expr(f"try_cast(try_element_at(split(trim(regexp_extract(line, {_sql(whole)}, 4)), '\\\\s+'), {k}) AS DOUBLE)")
    shape = F.nullif(part(5), F.lit(""))
    return rows.select("section", part(1).cast("int").alias("id"), F.concat(part(2), part(3)).alias("label"), number(1).alias("x"), number(2).alias("y"), number(3).alias("z"), shape.alias("shape"))


def read_ties(spark: SparkSession, path: str) -> DataFrame:
    """(section, src, dst, weight double, tie_type) of arcs, edges and adjacency lists; weights keep their fractions and are 1 where missing."""
    rows = sections(spark, path).where("kind IN ('arcs', 'edges', 'arcslist', 'edgeslist')").withColumn("w", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "))
    tie = F.when(F.col("kind").startswith("arcs"), "arcs").otherwise("edges").alias("tie_type")
    src = F.expr("try_cast(w[0] AS INT)").alias("src")
    pairs = rows.where("kind IN ('arcs', 'edges') AND size(w) > 1").select("section", src, F.expr("try_cast(w[1] AS INT)").alias("dst"), F.expr("coalesce(try_cast(try_element_at(w, 3) AS DOUBLE), 1D)").alias("weight"), tie)
    leaves = rows.where("kind LIKE '%list' AND size(w) > 1").select("section", src, F.explode(F.slice("w", F.lit(2), F.size("w") - 1)).alias("leaf"), tie)
    return pairs.unionAll(leaves.select("section", "src", F.expr("try_cast(leaf AS INT)").alias("dst"), F.lit(1.0).alias("weight"), "tie_type"))


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _values(spark: SparkSession, path: str, kind: str) -> DataFrame:
    rows = lines(spark, path)
    headed = rows.where("pos = 0").select("path", F.expr("try_cast(regexp_extract(line, '^\\\\*\\\\w+\\\\s+([0-9]+)', 1) AS INT)").alias("size"))
    name = F.regexp_extract("path", r"([^/]+)\.\w+$", 1)
    return rows.where("pos > 0 AND trim(line) <> ''").join(headed, "path").select(name.alias("file"), "size", F.col("pos").cast("int").alias("id"), F.expr(f"try_cast(trim(line) AS {kind})").alias("value"))


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """(id, community) of a .clu file."""
    return _values(spark, path, "INT").select("id", F.col("value").alias("community"))


def read_partitions(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(id, one column for each file): the partitions of one declared size, side by side."""
    return _values(spark, path, "INT").where(F.col("size") == size).groupBy("id").pivot("file").agg(F.first("value"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(file, net_id, size, id, value double) of .vec files; net_id is the number at the end of the file's name."""
    rows = _values(spark, path, "DOUBLE")
    return rows.select("file", F.expr("try_cast(regexp_extract(file, '([0-9]+)$', 1) AS INT)").alias("net_id"), "size", "id", "value")


def _written(rows: DataFrame, path: str) -> None:
    """(section, ord, line) as one text file: the format is one file, so it is written by one task."""
    rows.orderBy("section", "ord", *[c for c in ("dst", "weight") if c in rows.columns]).coalesce(1).select("line").write.mode("overwrite").text(path)


def as_file(spark: SparkSession, folder: str, path: str) -> None:
    """Move the one part file of a folder that a writer here made to ``path``, for programs that open a file; the folder goes."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(folder), hadoop.Path(path)
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [x.getPath() for x in files.listStatus(source) if x.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise ValueError(f"{folder} has {len(parts)} part files; one is expected")
    if files.exists(target):
        files.delete(target, False)
    if not files.rename(parts[0], target):
        raise OSError(f"{parts[0]} could not be moved to {path}")
    files.delete(source, True)


def _head(spark: SparkSession, section: int, line: Column | str, rows: DataFrame | None = None) -> DataFrame:
    if rows is None:
        return spark.range(1).select(F.lit(section).alias("section"), F.lit(-1).cast("long").alias("ord"), F.lit(line).alias("line"))
    return rows.agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), F.lit(-1).cast("long").alias("ord"), F.concat(F.lit(line), F.col("n").cast("string")).alias("line"))


def write_network(nodes: DataFrame, ties: DataFrame, path: str, directed: bool = True, tidy: bool = False, node_colour: Column | str = "", border_colour: Column | str = "", tie_colour: Column | str = "") -> None:
    """A .net file of nodes (id, label[, x, y, z]) and ties (src, dst[, weight]).

    A colour is one name for all or a column of the nodes or ties; null and empty ones are left out.

    Blank weights are 1. ``tidy`` sorts ties by both ends and keeps the first of equal pairs, the one
    of least weight. Labels are quoted, and double quotes in them become single ones.
    """
    spark = nodes.sparkSession
    def shade(kind: str, colour: Column | str) -> Column:
        value = colour if isinstance(colour, Column) else F.lit(colour)
        return F.when(value != "", F.concat(F.lit(f" {kind} "), value)).otherwise("")

    look = F.concat(shade("ic", node_colour), shade("bc", border_colour))
    place = [F.col(c).cast("string") for c in ("x", "y", "z") if c in nodes.columns]
    label_ = F.concat(F.lit('"'), F.replace(F.coalesce("label", F.lit("")), F.lit('"'), F.lit("'")), F.lit('"'))
    vertices = nodes.select(F.lit(0).alias("section"), F.col("id").cast("long").alias("ord"), F.concat(F.concat_ws(" ", F.col("id").cast("string"), label_, *place), look).alias("line"))
    weight = F.coalesce(F.col("weight"), F.lit(1)) if "weight" in ties.columns else F.lit(1)
    rows = ties.select("src", "dst", weight.alias("weight"), shade("c", tie_colour).alias("shade"))
    if tidy:
        first = F.min(F.struct("weight", "shade"))
        rows = rows.groupBy("src", "dst").agg(first.alias("f")).select("src", "dst", "f.weight", "f.shade")
    number = F.regexp_replace(F.col("weight").cast("string"), r"\.0$", "")
    line = F.concat(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), number), F.col("shade"))
    tied = rows.select(F.lit(1).alias("section"), F.col("src").cast("long").alias("ord"), line.alias("line"), "dst", "weight")
    heads = _head(spark, 0, "*Vertices ", nodes).unionAll(vertices).unionAll(_head(spark, 1, "*Arcs" if directed else "*Edges"))
    _written(heads.unionByName(tied, allowMissingColumns=True), path)


def write_values(rows: DataFrame, column: str, path: str) -> None:
    """A .clu or .vec file of one column of rows with an id."""
    values = rows.select(F.lit(0).alias("section"), F.col("id").cast("long").alias("ord"), F.col(column).cast("string").alias("line"))
    _written(_head(rows.sparkSession, 0, "*Vertices ", rows).unionAll(values), path)


def write_all_values(rows: DataFrame, folder: str, ending: str) -> list[str]:
    """A file for each column but id."""
    names = [c for c in rows.columns if c != "id"]
    for c in names:
        write_values(rows, c, f"{folder}/{c}.{ending}")
    return [f"{folder}/{c}.{ending}" for c in names]


def macro(spark: SparkSession, n: int | DataFrame, network: str, partition: str, folder: str) -> DataFrame:
    """(ord, line) of a macro that computes degrees in the induced network of each of n communities.

    A frame in place of n is counted by its distinct communities.
    """
    if isinstance(n, DataFrame):
        n = n.agg(F.count_distinct("community").alias("n")).first().n
    net, clu, out = (spark.range(1).select(windows_path(F.lit(p)).alias("p")).first().p for p in (network, partition, folder))
    # fixed values: the commands of a macro file
    head = ["NETBEGIN 1", "CLUBEGIN 1", "PERBEGIN 1", "CLSBEGIN 1", "HIEBEGIN 1", "VECBEGIN 1", f"% Reading Network   ---    {net}", f"N 1 RDN {net}", f"% Reading Partition   ---    {clu}", f"C 1 RDC {clu}", "% Extracting Subnetworks induced by each selected Cluster", f"N {n + 1} EXTNETALL 1 1 [1-*]"]
    first = spark.createDataFrame(list(enumerate(head, 1)), "ord long, line string")
    k = F.col("id").cast("string")
    net_k = (F.col("id") + 1).cast("string")
    saved = F.concat(F.lit(f"{out}\\total_degree_community_"), k, F.lit(".vec"))
    four = F.array(
        F.concat(F.lit("% All degree centrality of "), net_k, F.lit(". Subnetwork of N1 induced by C1 ["), k, F.lit("]")),
        F.concat(F.lit("V "), k, F.lit(" DEGV "), net_k, F.lit(" [2]")),
        F.concat(F.lit("% Saving vector to file   ---    "), saved),
        F.concat(F.lit("V "), k, F.lit(" WV "), saved, F.lit(" 0")))
    rest = spark.range(1, n + 1).select("id", F.posexplode(four).alias("p", "line")).select((F.lit(12) + (F.col("id") - 1) * 4 + F.col("p") + 1).alias("ord"), "line")
    return first.unionAll(rest)


def write_macro(rows: DataFrame, path: str) -> None:
    _written(rows.select(F.lit(0).alias("section"), "ord", "line"), path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a heading, quoted fields that may hold quotes and line ends."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True)


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
