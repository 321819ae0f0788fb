"""Groups of near copies: SimHash groups joined with pairs of an exact Jaccard similarity of word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.llm import simhash
from citeflow.llm.common import components, cut, dealt, fresh, joined, small, words_of

#: Words in a shingle, and the similarity from which two texts are near copies.
SHINGLE, LEAST = 5, 0.8
#: MinHash bands and the minima in each: of the pairs at LEAST one in 300,000 shares no band, of others fewer.
BANDS, MINIMA = 24, 4
#: Share of equal minima from which candidates' shingles are compared: five deviations under LEAST, so of the pairs at LEAST one in a million is under it.
LIKELY = 0.6
#: Keys, 8 bytes each, that are broadcast at most to pick out texts; more meet the texts in a join.
SENT = 1_000_000
#: Texts of one group of candidates that are compared in one task; larger groups are dealt out over pairs of blocks.
BLOCK = 2048

_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.int64).astype(np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of SHINGLE words; a shorter text is one run."""
    words = words_of(text)
    if not words:
        return np.array([], np.uint64)
    line, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    k = min(SHINGLE, len(words))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a : b - 1], 43) for a, b in zip([0, *ends], ends[k - 1 :])), np.uint64, len(words) - k + 1))


def minima(hashes: np.ndarray) -> bytes:
    """32 bits of each permutation's least hash; nothing without shingles."""
    if not len(hashes):
        return b""
    least = np.min([(hashes[at : at + 4096, None] * _TIMES + _PLUS).min(0) for at in range(0, len(hashes), 4096)], axis=0)
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def bands(sketch: bytes) -> list[int]:
    """A signed long for each band of minima, different from band to band; none without shingles."""
    return [xxhash.xxh64_intdigest(sketch[at : at + 4 * MINIMA], at) - (1 << 63) for at in range(0, len(sketch), 4 * MINIMA)]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets of shingles is LEAST or more."""
    if min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= LEAST * (len(a) + len(b) - both)


def _members(rows: pd.DataFrame) -> list[list[int]]:
    """The rows that share a band, for each band that several share."""
    members: dict[int, list[int]] = {}
    for x, shared in enumerate(rows.shared):
        for band in shared:
            members.setdefault(band, []).append(x)
    return [m for m in members.values() if len(m) > 1]


def _likely(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows (key, shared, blob) of one group of candidates, with minima: links (a, b) that join whatever pairs that share a band and have LIKELY of their minima in common join."""
    keys, sketches = rows.key.tolist(), np.stack([np.frombuffer(b, "<u4") for b in rows.blob])
    part, links = np.arange(len(keys)), []
    for held in map(np.array, _members(rows)):
        for k in range(1, len(held)):
            x = held[k]
            others = held[:k][part[held[:k]] != part[x]]
            near = others[(sketches[others] == sketches[x]).mean(1) >= LIKELY] if len(others) else others
            for y in near.tolist():
                if part[y] != part[x]:
                    part[part == part[y]] = part[x]
                    links.append((keys[x], keys[y]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _verified(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows (key, shared, blob) of one group of candidates, with shingles: links (a, b) that join whatever pairs that share a band and are alike join."""
    keys, sets = rows.key.tolist(), [np.frombuffer(b, np.uint64) for b in rows.blob]
    root, seen, links = list(range(len(keys))), set(), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def linked(x, y):
        if (y, x) not in seen:
            seen.add((y, x))
            if alike(sets[x], sets[y]):
                root[find(x)] = find(y)
                links.append((keys[x], keys[y]))
        return find(x) == find(y)

    for held in _members(rows):
        parts: list[list[int]] = []  # of what came before x, by what is joined already
        for x in held:
            joined_ = [p for p in parts if find(p[0]) == find(x) or any(linked(x, y) for y in reversed(p))]
            if len(joined_) == 1:
                joined_[0].append(x)
            else:
                parts = [p for p in parts if all(p is not q for q in joined_)] + [sum(joined_, []) + [x]]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _by_group(wanted: DataFrame, links: DataFrame) -> DataFrame:
    """wanted (key, shared) with the component of links that holds the key, and its size n; keys without links go."""
    group = components(links)
    size = group.groupBy(F.col("root").alias("group")).agg(F.count("*").alias("n"))
    wanted = wanted.join(group.select(F.col("node").alias("key"), F.col("root").alias("group")), "key")
    return joined(wanted, size.withColumn("size", F.col("n")), "group").withColumnRenamed("size", "n")


def _compared(held: DataFrame, compare) -> DataFrame:
    """What compare makes of each group of rows (key, group, shared, n, blob); of a group of more than BLOCK, of each pair of its blocks."""
    held = held.withColumn("parts", F.when(F.col("n") > BLOCK, F.ceil(F.col("n") / BLOCK).cast("int") * 2).otherwise(1))
    held = held.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: t != F.col("mine"))))
    held = held.select("group", "key", "shared", "blob", "mine", other.alias("other")).select("group", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "key", "shared", "blob")
    return held.groupBy("group", "i", "j").applyInPandas(lambda pdf: compare(pdf), "a long, b long")


def near_links(texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """Links (a, b) between keys of texts that are near copies; ``texts`` are (key, text) with repeats, ``sketches`` (key, minima) without.

    Texts that share bands, directly or through others, are candidates and are compared by their minima
    in their group's task. What that joins makes smaller groups, whose texts are compared by their
    shingles. A text goes once to its group's task, or once to each pair of blocks of a large group.
    """
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [bands(b) for b in batch.column("minima").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.list_(pa.int64()))], names=["key", "bands"])

    rows = sketches.mapInArrow(explode, "key long, bands array<long>").select("key", F.explode("bands").alias("band"))
    first = cut(rows.groupBy("band").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1"))
    shared = cut(joined(rows, first, "band").select("key", "band", "first"))
    wanted = shared.groupBy("key").agg(F.collect_list("band").alias("shared"))
    grouped = _by_group(wanted, shared.select(F.col("key").alias("a"), F.col("first").alias("b")))
    likely = _compared(grouped.join(sketches.select("key", F.col("minima").alias("blob")), "key"), _likely)
    grouped = cut(_by_group(wanted, likely))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            blobs = pa.array([shingles(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "group", "shared", "n")), blobs], names=["key", "group", "shared", "n", "blob"])

    if grouped.count() <= SENT:
        texts = texts.join(F.broadcast(grouped.select("key")), "key", "left_semi")
    held = texts.groupBy("key").agg(F.min("text").alias("text")).join(grouped, "key").select("key", "group", "shared", "n", "text")
    return _compared(held.mapInArrow(run, "key long, group long, shared array<long>, n long, blob binary"), _verified)


def one_of_each(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One row of each group of near copies: the smallest by doc_id, then text, nulls last.

    Two rows are in a group, directly or through others, if their texts are equal, their SimHash
    fingerprints differ in at most ``radius`` bits, or their shingles have a Jaccard similarity of
    LEAST. Texts are told apart by 64-bit hashes; a null text counts as empty. Neither null nor
    repeated doc_ids matter.
    """
    key, row = fresh(docs, "key"), fresh(docs, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            fps = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(fps), pa.array([minima(shingles(t)) for t in texts], pa.binary())], names=["key", "fp", "minima"])

    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    sketches = cut(dealt(texts).mapInArrow(run, "key long, fp long, minima binary").dropDuplicates(["key"]))
    fps = cut(sketches.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    same = joined(sketches.select("key", "fp"), fps.where("n > 1"), "fp").where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    near = simhash.links(fps.select("fp"), radius)
    near = near.join(fps.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    found = components(same.unionAll(near.select("x", "y")).unionAll(near_links(texts, sketches.select("key", "minima"))))

    # texts of one key differ as null and empty at most
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text").isNull().alias("t"))
    rows = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias(key), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), order.alias("o"))
    # equal texts first, so that a text that is everywhere arrives once from each task
    rows = rows.groupBy(key).agg(F.min_by(row, "o").alias(row), F.min("o").alias("o"))
    rows = rows.join(found.select(F.col("node").alias(key), "root"), key, "left")
    alone = rows.where("root IS NULL").select(f"{row}.*")
    least = F.struct("o.n", "o.d", "o.t", F.col(f"{row}.text"))
    return alone.unionAll(rows.where("root IS NOT NULL").groupBy("root").agg(F.min_by(row, least).alias(row)).select(f"{row}.*"))
