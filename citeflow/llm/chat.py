"""Chat formatting after collapsing cumulative snapshots, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeflow.llm.common import cut, table

#: The marks around a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def with_prefixes(turns: DataFrame) -> DataFrame:
    """Turns with place (from 1) and the rolling hash of the turns so far, as two longs p and q.

    The hash of a prefix is that of the prefix before, exclusive-or the hash of place, role and
    text; nulls differ from empty texts. Turns of one conversation are ordered by turn, then role
    and text, so repeated rows are turns of their own. Rows without a conv_id are dropped.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), F.asc_nulls_last("role"), F.asc_nulls_last("text"))
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "role", "text", F.row_number().over(order).alias("place"), F.col("turn"))
    own = [F.struct("place", F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull())]
    run = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.xxhash64(F.lit(1), *own).alias("_p"), F.xxhash64(F.lit(2), *own).alias("_q"))
    return rows.select("conv_id", "turn", "role", "text", "place", F.bit_xor("_p").over(run).alias("p"), F.bit_xor("_q").over(run).alias("q"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no prefix of a longer one; of equal ones the smallest conv_id.

    ``prefixes`` has conv_id, place, p and q. Equal conversations are grouped before the
    anti-join, so it has each (length, hash) once on either side.
    """
    whole = prefixes.groupBy("conv_id").agg(F.max(F.struct("place", "p", "q")).alias("w")).select("conv_id", "w.*")
    unique = whole.groupBy("place", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    lengths = F.count("*").over(Window.partitionBy("conv_id"))
    proper = prefixes.select("place", "p", "q", lengths.alias("n")).where("place < n").select("place", "p", "q").distinct()
    return unique.join(proper, ["place", "p", "q"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, chat): each maximal conversation as one text; null roles and texts render empty."""
    rows = with_prefixes(turns)
    kept = maximal(cut(rows.select("conv_id", "place", "p", "q")))
    part = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    placed = rows.select("conv_id", "place", part.alias("part")).join(kept.select("conv_id"), "conv_id", "left_semi")
    texts = placed.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), "").alias("chat"))
    return kept.join(texts, "conv_id").select("conv_id", "n_turns", "n_copies", "chat")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


OP7_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS place,
    coalesce(role, '') AS role, coalesce(text, '') AS text, (role IS NULL)::VARCHAR || (text IS NULL)::VARCHAR AS nulls FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, place, string_agg(length(role) || ':' || role || length(text) || ':' || text || nulls, '' ORDER BY place) OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM t),
n AS (SELECT conv_id, max(place) AS n_turns FROM t GROUP BY conv_id),
w AS (SELECT p.prefix, min(p.conv_id) AS conv_id, count(*) AS n_copies, any_value(n.n_turns) AS n_turns FROM p JOIN n ON p.conv_id = n.conv_id AND p.place = n.n_turns GROUP BY p.prefix),
s AS (SELECT DISTINCT p.prefix FROM p JOIN n ON p.conv_id = n.conv_id AND p.place < n.n_turns),
k AS (SELECT * FROM w WHERE prefix NOT IN (SELECT prefix FROM s))
SELECT k.conv_id, k.n_turns, k.n_copies, string_agg('{OPEN}' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' ORDER BY t.place) AS chat
FROM k JOIN t ON k.conv_id = t.conv_id GROUP BY ALL
"""
