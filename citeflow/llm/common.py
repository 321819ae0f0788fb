"""What several operators share: tables, lineage cuts, words and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.operators.network import roots


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name with as many underscores before it as keep it apart from df's columns, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Write df where every executor can read it again, and go on from there.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session
    that names none gets a temporary folder; a cluster without one is an error.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, set up if need be."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="citeflow-checkpoint-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches, of at most so many rows, as what Python makes of a text may be much larger than the text."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def dealt(df: DataFrame) -> DataFrame:
    """df in as many partitions as the session has cores, if it is read in fewer, as a small file is."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


#: Rows of one key that a task gets at least; keys of more are split, 10,000 of them at most.
HOT = 256


def joined(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """rows.join(of, key), where ``of`` has one row of each key and n, the number of its rows.

    Rows of a key that has more than HOT of them, and more than one in 10,000 of all, are dealt
    out over several tasks and meet a copy of the key's row in each. So what is broadcast, the
    list of these keys, has 10,000 rows at most.
    """
    most = max(HOT, (of.agg(F.sum("n").alias("n")).first().n or 0) // 10_000)
    parts = F.ceil(F.col("n") / most).cast("int")
    hot = of.where(F.col("n") > most).select(key, parts.alias("_parts"))
    salt = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts")).cast("int"))
    dealt_out = of.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > most, parts - 1).otherwise(0)))).drop("n")
    return rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_parts").join(dealt_out, [key, "_salt"]).drop("_salt")


def crc_mod(column, n: int):
    """crc32 of an id as text, modulo n; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % n


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII spaces, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node; loops and repeated edges count for nothing."""
    return roots(edges.select(*(F.col(c).alias(k) for c, k in zip(edges.columns, ("a", "b")))))
