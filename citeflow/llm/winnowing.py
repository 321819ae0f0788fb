"""Document fingerprints by winnowing, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeflow.llm.common import table

#: Tokens are runs of at most PIECE visible characters; a gram has GRAM of them, a window WINDOW grams.
PIECE, GRAM, WINDOW = 4, 4, 8
#: The same for texts of at most SHORT characters, which would have few grams of that size.
SHORT, SHORT_PIECE, SHORT_GRAM, SHORT_WINDOW = 60, 1, 2, 4
#: Ranges of keys for each shuffle partition, most ranges, and parts of a range that one key fills.
RANGES, MOST_RANGES, TIES = 4, 1 << 16, 64
#: The rolling hash works modulo a prime, with a base, so that products stay within 63 bits.
PRIME, BASE = 2147483647, 1000003
PLACES = 2147483648


def tokens(text: Column, piece: int = PIECE) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[^ \t-\r]{{1,{piece}}}"), F.lit(0))


def _windowed(values: Column, width: int, merge) -> Column:
    """merge over each run of width values, from runs of 1, 2, 4 ... values put side by side; fewer values make one run.

    merge(a, b, n) joins a run and the one of n values behind it.
    """
    def step(column: Column, done: int) -> Column:
        if done == width:
            return column
        by = min(done, width - done)
        return F.transform(F.array(column), lambda c: step(F.when(F.size(c) > by, F.zip_with(F.slice(c, 1, F.size(c) - by), F.slice(c, by + 1, F.size(c) - by), lambda a, b: merge(a, b, by))).otherwise(c), done + by))[0]

    return step(values, 1)


def gram_hashes(text: Column, gram: int = GRAM, piece: int = PIECE) -> Column:
    """The polynomial hash of every run of gram tokens, in text order; of the whole text if it has fewer tokens."""
    first = F.transform(tokens(F.coalesce(text, F.lit("")), piece), lambda t: F.pmod(F.xxhash64(t), F.lit(PRIME)))
    if gram & (gram - 1):
        raise ValueError("a gram has a power of two tokens")
    power = BASE % PRIME  # a run of n tokens has the hash sum of h[i] * BASE ** (n - 1 - i)

    def doubled(c: Column, n: int, power: int) -> Column:
        if n == gram:
            return c
        joined = F.zip_with(F.slice(c, 1, F.size(c) - n), F.slice(c, n + 1, F.size(c) - n), lambda a, b: (a * power + b) % PRIME)
        return F.transform(F.array(F.when(F.size(c) > n, joined).otherwise(c)), lambda x: doubled(x, 2 * n, power * power % PRIME))[0]

    return F.transform(F.array(first), lambda c: F.when(F.size(c) >= gram, doubled(c, 1, power)).when(F.size(c) > 0, F.array(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: (s * power + x) % PRIME))).otherwise(c))[0]


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW, piece: int = PIECE) -> Column:
    """The fingerprint of a text: longs that hold a hash and its place, in text order.

    Of each window of grams the least hash is taken, the rightmost one if it occurs
    more than once. So two texts that share gram + window - 1 tokens in a row share a
    hash. ``hash_of`` and ``place_of`` take the longs apart. A text of fewer grams than a
    window has one window; null, empty and blank texts have no fingerprint.
    """
    packed = F.transform(gram_hashes(text, gram, piece), lambda h, i: h * PLACES + (PLACES - 1 - i))
    return F.array_distinct(_windowed(packed, window, lambda a, b, n: F.least(a, b)))


def hash_of(value: Column) -> Column:
    return F.shiftright(value, 31)


def place_of(value: Column) -> Column:
    return F.lit(PLACES - 1) - value.bitwiseAND(F.lit(PLACES - 1))


def fingerprint(text: Column) -> Column:
    """The distinct hashes of a text's fingerprint; a short text's are of smaller grams, which no longer text has."""
    hashes = lambda x: F.array_distinct(F.transform(x, lambda v: hash_of(v).cast("int")))
    return F.when(F.char_length(text) <= SHORT, hashes(winnow(text, SHORT_GRAM, SHORT_WINDOW, SHORT_PIECE))).otherwise(hashes(winnow(text)))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def text_of(fingerprint_: Column) -> Column:
    """Eight hex digits for each hash."""
    return F.array_join(F.transform(fingerprint_, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def ranges(keys: DataFrame, key: str) -> list[int]:
    """Keys that part the rows into ranges of about equal numbers; one that fills ranges by itself comes repeatedly.

    Quantiles of all rows, from a sketch of bounded size; the longs are approximate beyond 53 bits, which borders may be.
    """
    n = min(MOST_RANGES, RANGES * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = keys.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 10 * n).alias("q")).first().q
    return sorted(found or [])


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", derived: dict[str, Column] | None = None) -> DataFrame:
    """Each row with struct ``next`` of the columns of the next row by descending key, a long; after the last comes the first.

    ``derived`` are columns worked out of the others, once for each row, that come along.

    Rows go to ranges of keys between quantiles, however far apart the keys are. A key that fills ranges by itself
    has one of its own, which is dealt out by the columns' hash; so have null keys, which come last. Within a
    range a window finds the next row; the first row of the next range is put behind the
    last one for that. Rows of equal keys are in the order of their columns' hash.
    """
    own = F.col(key).cast("long")
    bounds = ranges(docs.select(own.alias("_key")), "_key")
    several = sorted({b for b, c in zip(bounds, bounds[1:]) if b == c})
    distinct = sorted(set(bounds))
    step = max(1, math.isqrt(len(distinct)))
    groups = [distinct[k : k + step] for k in range(0, len(distinct), step)]
    listed = lambda x: F.lit(x) if x else F.array().cast("array<bigint>")
    below = lambda x, k: F.size(F.filter(x, lambda b: b < k))
    rows = docs.select(own.alias("_key"), F.struct(*columns).alias("_row"))
    rows = rows.withColumn("_hash", F.xxhash64("_row")).withColumn("_g", below(listed([g[0] for g in groups]).cast("array<bigint>"), F.col("_key")))
    in_group = F.get(listed(groups).cast("array<array<bigint>>"), F.greatest(F.col("_g") - 1, F.lit(0))) if groups else listed([])
    rows = rows.withColumn("_c", F.when(F.col("_g") > 0, (F.col("_g") - 1) * step + below(in_group, F.col("_key"))).otherwise(0))
    at_bound = F.coalesce(F.get(listed(distinct).cast("array<bigint>"), F.col("_c")) == F.col("_key"), F.lit(False))
    many = F.col("_key").isNull() | F.array_contains(listed(several).cast("array<bigint>"), F.coalesce("_key", F.lit(0)))
    part = F.floor((F.shiftright("_hash", 32) + 2**31) * TIES / 2**32).cast("int")
    rows = rows.select("_key", "_row", "_hash", F.when(F.col("_key").isNull(), -1).otherwise(2 * F.col("_c") + at_bound.cast("int")).cast("long").alias("_b"), F.when(many, part).otherwise(0).alias("_t"))
    first = F.min(F.struct(F.col("_key").isNull(), -F.col("_key").cast("decimal(20,0)"), "_hash", "_row")).alias("_first")
    heads = rows.groupBy("_b", "_t").agg(first).select(F.col("_b").alias("_hb"), F.col("_t").alias("_ht"), F.col("_first._row").alias("_row"))
    # a row for each range, a number that has a bound; their rows' texts stay out of this window
    order = Window.orderBy(F.desc("_b"), "_t")
    there = rows.select("_b", "_t").distinct().select("*", F.lead("_b").over(order).alias("_b2"), F.lead("_t").over(order).alias("_t2"), F.first("_b").over(order).alias("_b0"), F.first("_t").over(order).alias("_t0"))
    after = there.select("_b", "_t", F.coalesce("_b2", "_b0").alias("_hb"), F.coalesce("_t2", "_t0").alias("_ht"))
    border = after.join(heads, ["_hb", "_ht"]).select(F.lit(None).cast("long").alias("_key"), "_row", F.lit(None).cast("long").alias("_hash"), "_b", "_t", F.lit(True).alias("_behind"))

    both = rows.withColumn("_behind", F.lit(False)).unionByName(border).repartition("_b", "_t").select("*", "_row.*")
    # after the rows have been dealt out by range, so that few large files are no matter
    more = [c.alias(name) for name, c in (derived or {}).items()]
    both = both.select("_key", "_hash", "_b", "_t", "_behind", F.struct(*columns, *more).alias("_row"))
    inside = Window.partitionBy("_b", "_t").orderBy("_behind", F.desc_nulls_last("_key"), "_hash")
    return both.select("_behind", "_row", F.lead("_row").over(inside).alias("next")).where("NOT _behind").select("_row.*", "next")


def compare_edited(docs: DataFrame) -> DataFrame:
    """The contract of op1 over rows (doc_id, text); a null text counts as empty.

    Texts of any length are read whole, each is fingerprinted once before rows meet; repeated rows
    follow each other; further columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    pairs = with_next(rows, ["doc_id", "text"], derived={"f": fingerprint(F.col("text"))})
    n = F.char_length("text")
    change = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - change), F.substring(F.col("next.text"), F.lit(1), change))
    out = pairs.select("doc_id", n.cast("long").alias("n_chars"), "f", F.col("next.f").alias("g"), edited.alias("edited"))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "f", "g", F.transform(F.array("edited"), fingerprint)[0].alias("e"))
    out = out.select("doc_id", "n_chars", "edited_sha256", F.transform(F.array(F.struct("f", "g", "e")), lambda x: F.struct(text_of(x["f"]).alias("fingerprint"), text_of(x["e"]).alias("edited_fingerprint"), likeness(x["f"], x["e"]).alias("near_edited"), likeness(x["f"], x["g"]).alias("near_next")))[0].alias("x"))
    return out.select("doc_id", "n_chars", "edited_sha256", "x.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
