"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.llm.common import components, cut, dealt, joined, small, table, words_of

#: Distinct fingerprints of one bucket that are compared in one group; larger buckets are dealt out over pairs of blocks.
BLOCK = 4096


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64 bits, each set if it is set in over half of the shingles' XXH64; 0 for a text without words."""
    words = words_of(text)
    if not words:
        return 0
    line, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    starts, k = [0, *ends], min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a : b - 1], seed) for a, b in zip(starts, ends[k - 1 :])), np.uint64, len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for each row of docs; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fps = np.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return dealt(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, fp long")


def masks(blocks: int, same: int) -> list[int]:
    """Bit masks of every choice of blocks that two near fingerprints may have in common."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(parts, same)]


def near_links(fps: np.ndarray, group: np.ndarray, radius: int, planes: list[int]) -> list[tuple[int, int]]:
    """Links (i, j) that join, within each group, whatever pairs of at most radius differing bits join.

    fps are uint64, equal groups stand next to each other. Bit b of all values is one
    long integer (a plane), so one shift and exclusive-or compares all i with i + s at
    once; carry-save adders count the differences of all of them; a shift is abandoned
    when no pair is within the radius any more. Of the pairs found only those are
    returned that join two parts still apart, at most len(fps) - 1.
    """
    n, links = len(fps), []
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sliced = [int.from_bytes(np.packbits(bits[:, b], bitorder="little").tobytes(), "little") for b in planes]
    sliced = [p for p in sliced if p and p.bit_count() < n]
    group = np.unique(group, return_inverse=True)[1].astype(np.int64)
    open_parts = np.bincount(group)
    label = np.arange(n)
    width = radius.bit_length() + 1
    for s in range(1, int(open_parts.max(initial=0))):
        alike = (group[:-s] == group[s:]) & (label[:-s] != label[s:])
        if not alike.any():
            if not (open_parts > 1).any():
                break
            continue
        alive = int.from_bytes(np.packbits(alike, bitorder="little").tobytes(), "little")
        count = [0] * width  # bits of a counter for each pair, least first; one that overflows is dropped at once
        for k, plane in enumerate(sliced):
            carry = plane ^ (plane >> s)
            for j in range(width):
                count[j], carry = count[j] ^ carry, count[j] & carry
                if not carry:
                    break
            alive &= ~carry
            if k % 6 == 5 or k == len(sliced) - 1:
                above, equal = 0, alive
                for j in reversed(range(width)):
                    if radius >> j & 1:
                        equal &= count[j]
                    else:
                        above |= equal & count[j]
                        equal &= ~count[j]
                alive &= ~above
                if not alive:
                    break
        if not alive:
            continue
        found = np.flatnonzero(np.unpackbits(np.frombuffer(alive.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))
        root = label.tolist()
        for i in found.tolist():
            a, b = i, i + s
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, i + s))
                open_parts[group[i]] -= 1
        label = np.array(root)
        while (label != (jumped := label[label])).any():
            label = jumped
    return links


def _compare(batches: Iterator[pa.RecordBatch], radius: int, keys: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows (c, i, j, fp) sorted by choice, masked value and block pair: links (a, b) of each group."""
    held: list[np.ndarray] = []

    def linked(c, i, j, fp):
        out = []
        masked = fp & np.array(keys, np.uint64)[c]
        new = np.r_[True, (c[1:] != c[:-1]) | (masked[1:] != masked[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        group, size = np.cumsum(new) - 1, np.diff(np.r_[np.flatnonzero(new), len(c)])
        for choice in np.unique(c):
            planes = [b for b in range(64) if not keys[choice] >> b & 1]
            here = np.unique(group[c == choice])
            low = 2
            while low <= size[here].max():  # groups of like size together, so that none waits for a larger one's shifts
                own = here[(size[here] >= low) & (size[here] < 2 * low)]
                low *= 2
                rows = np.flatnonzero(np.isin(group, own)) if len(own) else []
                at = 0
                while at < len(rows):
                    end = min(len(rows), at + (1 << 15))
                    while end < len(rows) and group[rows[end]] == group[rows[end - 1]]:
                        end += 1
                    part = rows[at:end]
                    values = fp[part]
                    out += [(values[x], values[y]) for x, y in near_links(values, group[part], radius, planes)]
                    at = end
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        got = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)] + [batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)]
        held = [np.concatenate(x) for x in zip(held, got)] if held else got
        if len(held[0]) < 1 << 16:
            continue
        c, i, j, fp = held
        masked = fp & np.array(keys, np.uint64)[c]
        same = (c == c[-1]) & (masked == masked[-1]) & (i == i[-1]) & (j == j[-1])
        start = len(c) - int(same.sum())  # the last group may go on in the next batch
        if start:
            yield linked(*(x[:start] for x in held))
            held = [x[start:] for x in held]
    if held and len(held[0]):
        yield linked(*held)


def links(fps: DataFrame, radius: int = 4, blocks: int = 6, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that join all pairs within radius bits.

    Of ``blocks`` blocks of bits at least blocks - radius are equal in such a pair, so
    each fingerprint goes to a bucket for every choice of that many blocks. A bucket of
    more than ``block`` fingerprints is dealt out over pairs of blocks, so no task gets
    an unbounded group, and every pair of it still meets.
    """
    keys = masks(blocks, blocks - radius)
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    key = F.col("fp").bitwiseAND(F.element_at(F.array(*map(F.lit, signed)), F.col("c") + 1)).alias("masked")
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(keys) - 1))).alias("c")).select("c", key, "fp")
    hot = rows.groupBy("c", "masked").agg(F.count("*").alias("n")).where(F.col("n") > block)
    rows = rows.join(hot, ["c", "masked"], "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / block).cast("int") * 2, F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("mine")
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: t != F.col("mine"))))
    rows = rows.select("c", "masked", "fp", "parts", mine).select("*", other.alias("other"))
    rows = rows.select("c", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp", "masked")
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(n, "c", "masked", "i", "j").sortWithinPartitions("c", "masked", "i", "j").select("c", "i", "j", "fp")
    return rows.mapInArrow(lambda b: _compare(b, radius, keys), "a long, b long")


def near_groups(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for each row: groups of rows whose fingerprints link at radius bits, directly or through others.

    Equal fingerprints are compared once. A null text counts as empty, empty texts have
    fingerprint 0 and link like any other. component_id is the smallest doc_id of the
    group; null doc_ids keep their rows and are never the smallest unless all are null.
    """
    rows = cut(fingerprints(docs, shingle, seed))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    parts = components(links(distinct.select("fp"), radius))
    linked = parts.join(distinct, parts.node == distinct.fp).select("fp", "root", "least")
    groups = linked.groupBy("root").agg(F.min("least").alias("group_least"))
    of = linked.join(groups, "root").select("fp", "group_least")
    label = distinct.join(of, "fp", "left").select("fp", "n", F.coalesce("group_least", "least").alias("component_id"))
    return joined(rows, label, "fp")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
