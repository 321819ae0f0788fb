"""Nearest neighbours by inner product: inverted lists of product-quantised residuals, reranked exactly.

The codes choose what is reranked by bounds: a list or a vector is passed over only if it cannot hold one of
the k nearest, so what is found is what brute force finds, on any rows. How well the sample
stands for the rows decides how much is passed over, not what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeflow.llm.common import cut, joined, table

#: Vectors, in expectation, that the centroids and codebooks are fitted on; all vectors are indexed.
FIT_VECTORS = 16_384
#: Parts of a residual, codewords of each part, most lists.
PARTS, WORDS, LISTS = 32, 256, 4096
#: Share of the sample's nearest neighbours that lie in the lists probed first, by which the number of these is set; one list in FIRST at most.
FOUND, FIRST = 0.97, 16
#: Candidates of a block of lists that are reranked first for a query, if its bound leaves more.
RERANKED = 100
#: Vectors of a block of lists, queries of a group.
SHARD, BLOCK = 8192, 4096
#: Of the pairs of a block of lists and 256 queries, the share beyond which these are multiplied as matrices.
DENSE = 1 / 32


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spaced starting points; a cluster without members keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = _nearest(x, centres)
        n = np.bincount(nearest, minlength=k)
        total = np.stack([np.bincount(nearest, x[:, j], k) for j in range(x.shape[1])], 1)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)


class Index:
    """Coarse centroids, and codebooks for the parts of what is left of a vector after its centroid.

    They lie in a space of their own: vectors by a power of two, so that the largest component
    of the sample is about one, less the sample's mean; queries have unit length.
    """

    def __init__(self, sample: np.ndarray, lists: int, parts: int = PARTS, words: int = WORDS):
        lists = max(1, min(lists, len(sample)))
        self.scale = math.ldexp(1.0, -max(-1000, min(1000, math.frexp(float(np.abs(sample).max()))[1])))
        self.mean = (sample * self.scale).mean(0)
        sample = self.at(sample)
        self.centroids = _means(sample, lists)
        self.edges = np.unique(np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int))
        rest = sample - self.centroids[_nearest(sample, self.centroids)]
        self.books = [_means(rest[:, a:b], min(words, len(rest)), 6) for a, b in zip(self.edges, self.edges[1:])]
        #: what sums of as many products as a vector has components may be off by, of the lengths multiplied
        self.eps = 2.0**-50 * (sample.shape[1] + 8)

    def at(self, x: np.ndarray) -> np.ndarray:
        return x * self.scale - self.mean

    @staticmethod
    def unit(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries of unit length, and their lengths."""
        most = np.abs(q).max(1)
        length = np.linalg.norm(q / most[:, None], axis=1)
        return q / most[:, None] / length[:, None], most * length

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The list of each vector, its codes, and how far it may be from what its codes and its list's centroid say, rounding included."""
        y = self.at(x)
        lists = _nearest(y, self.centroids)
        rest = y - self.centroids[lists]
        codes = np.stack([_nearest(rest[:, a:b], c) for a, b, c in zip(self.edges, self.edges[1:], self.books)], 1).astype(np.uint8)
        left = rest - np.concatenate([c[codes[:, p]] for p, c in enumerate(self.books)], 1)
        round_off = self.eps * (np.linalg.norm(y, axis=1) + np.linalg.norm(self.mean)) + 1e-150
        return lists, codes, *(np.linalg.norm(v, axis=1) * (1 + 1e-9) + round_off for v in (left, rest))

    def depth(self, sample: np.ndarray, k: int, share: float = FOUND) -> int:
        """How many lists a query has to probe so that they hold this share of the k nearest: as many as the sample's own vectors need, few where there are clusters."""
        asking, y = self.unit(sample[np.linspace(0, len(sample) - 1, min(len(sample), 400)).astype(int)])[0], self.at(sample)
        lists, place = _nearest(y, self.centroids), []
        for q in asking:
            near = np.argsort(-(y @ q), kind="stable")[: k + 1]
            order = np.empty(len(self.centroids), np.int64)
            order[np.argsort(-(self.centroids @ q), kind="stable")] = np.arange(len(self.centroids))
            place += order[lists[near]].tolist()
        return 1 + int(np.quantile(place, share, method="higher"))

    def least(self, q: np.ndarray, length: np.ndarray, score: np.ndarray) -> np.ndarray:
        """What inner products score of queries q (of unit length here) are in the index's space, rounding taken off."""
        plain, off = np.minimum(score, np.finfo(float).max) / length * self.scale, q @ self.mean
        return plain - off - self.eps * (np.abs(plain, where=np.isfinite(plain), out=np.zeros_like(plain)) + np.linalg.norm(self.mean))

    def first(self, q: np.ndarray, depth: int) -> np.ndarray:
        """Which lists each query of unit length probes first, a row of booleans each: those whose centroids are nearest."""
        out = np.zeros((len(q), len(self.centroids)), bool)
        np.put_along_axis(out, np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :depth], True, axis=1)
        return out

    def open(self, q: np.ndarray, least: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Which lists, of vectors within radius of their centroids, may hold a product of ``least`` or more with each query."""
        most = q @ self.centroids.T + radius + self.eps * np.linalg.norm(self.centroids, axis=1)
        return ~(most < least[:, None]) & (radius >= 0)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Asymmetric distance tables: each query's inner product with each codeword of each part."""
        return [q[:, a:b] @ c.T for a, b, c in zip(self.edges, self.edges[1:], self.books)]


def packed(x: np.ndarray) -> list[bytes]:
    """Vectors as bytes, in single precision where that is all of them."""
    with np.errstate(over="ignore", under="ignore"):
        short = x.astype("<f4")
    return [(v if same else w).tobytes() for v, w, same in zip(short, x.astype("<f8"), (short == x).all(1))]


def unpacked(vectors: pd.Series, length: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<f4" if len(v) == 4 * length else "<f8") for v in vectors]).astype(float)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with q, each row's by itself, so that they do not depend on what other rows there are."""
    return np.einsum("ij,j->i", x, q)


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>, rep) of the vectors that take part; rep tells vectors apart by 64 bits.

    Null ids and vectors, vectors with null or non-finite components and zero vectors do
    not. Rows that are equal in both count once; a vec_id may have several vectors.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    return rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0))).distinct().withColumn("rep", F.xxhash64("embedding"))


def blocks(sizes: dict[int, int], centroids: np.ndarray, shard: int) -> np.ndarray:
    """(first block, number of blocks) of each list: lists side by side in space share a block of about ``shard`` vectors; a longer list has several."""
    out, block, free = np.zeros((len(centroids), 2), np.int64), 0, shard
    spread = centroids - centroids.mean(0)
    along = spread @ np.linalg.svd(spread, full_matrices=False)[2][0] if len(centroids) > 1 else np.zeros(1)
    for k in np.argsort(along, kind="stable"):
        n = sizes.get(int(k), 0)
        if n > free and free < shard:
            block, free = block + 1, shard
        out[k] = block, max(1, -(-n // shard))
        if n >= shard:
            block, free = block + out[k, 1], shard
        else:
            free -= n
    return out


def search(vectors: DataFrame, every: int = 20, k: int = 20, found: float = FOUND, reranked: int = RERANKED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row whose vec_id is divisible by ``every``.

    Vectors of one length are searched among themselves. Null and invalid vectors take no part (``valid``),
    repeated rows count once, ties go to the smaller vec_id, other columns are ignored, and an empty
    table gives no rows. ``found`` and ``reranked`` set what is looked at first, not what is found.
    """
    rows = cut(valid(vectors))
    sizes = sorted(r.n for r in rows.select(F.size("embedding").alias("n")).distinct().collect())
    parts = [_search(rows.where(F.size("embedding") == n), n, every, k, found, reranked) for n in sizes]
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionAll, [p for p in parts if p is not None], empty)


def _search(rows: DataFrame, length: int, every: int, k: int, found: float, reranked: int) -> DataFrame | None:
    """search() over vectors of one length.

    Equal vectors are indexed and searched once, with the k + 1 smallest of their ids,
    which is as many as a result can hold. Each is coded once and kept with its list. Lists are dealt
    out in blocks; a query goes to the blocks that have a list it probes, and only those lists' codes
    are scored there, by its tables. It probes the nearest lists first; the least of the k + 1 nearest of these then tells
    which other lists may hold nearer ones, and those it probes too. In a block the vectors whose codes leave
    it open that they are among the k + 1 nearest are reranked with the original vectors in double precision.
    """
    spark = rows.sparkSession
    first = Window.partitionBy("rep").orderBy("vec_id")
    few = rows.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= k + 1)
    distinct = cut(few.groupBy("rep").agg(F.first("embedding").alias("embedding"), F.array_sort(F.collect_list("vec_id")).alias("ids")))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "rep")
    n, asking = distinct.count(), cut(queries.groupBy("rep").agg(F.count("*").alias("n")))
    if not asking.count():
        return None
    sample = distinct.where(F.pmod(F.col("rep"), F.lit(1_000_000)) < 1_000_000 * min(1.0, FIT_VECTORS / n)).orderBy("rep").limit(2 * FIT_VECTORS)
    got = [r.embedding for r in sample.select("embedding").collect()] or [r.embedding for r in distinct.limit(1).collect()]
    made = Index(np.array(got), min(LISTS, math.isqrt(n)))
    depth = min(made.depth(np.array(got), k, found), max(8, len(made.centroids) // FIRST))
    index = spark.sparkContext.broadcast(made)

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 2048):
                part = frame.iloc[at : at + 2048]
                x = np.stack(part.embedding)
                lists, codes, off, far = index.value.encode(x)
                yield pd.DataFrame({"rep": part.rep, "ids": part.ids, "vector": packed(x), "list": lists.astype(np.int32), "codes": [c.tobytes() for c in codes], "off": off, "far": far})

    stored = cut(distinct.mapInPandas(code, "rep long, ids array<long>, vector binary, list int, codes binary, off double, far double"))
    lists = {r["list"]: r for r in stored.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    place = blocks({x: r.n for x, r in lists.items()}, made.centroids, SHARD)
    at = F.lit([int(b) for b, _ in place]), F.lit([int(c) for _, c in place])
    block = F.get(at[0], F.col("list")) + F.pmod(F.col("rep"), F.get(at[1], F.col("list")))
    # a row for each block of each list, by block
    held = np.array(sorted((b, x) for x, (lo, many) in enumerate(place.tolist()) for b in range(lo, lo + many)))
    radius = np.array([lists[x].far if x in lists else -1.0 for x in range(len(place))])
    sent = spark.sparkContext.broadcast((held, radius))

    def router(again: bool):
        def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, radius = sent.value
            for frame in frames:
                for start in range(0, len(frame), 1024):
                    part, out = frame.iloc[start : start + 1024], []
                    q, size = index.value.unit(unpacked(part.vector, length))
                    chosen = index.value.first(q, depth)
                    if again:
                        chosen = index.value.open(q, index.value.least(q, size, part.floor.values), radius) & ~chosen
                    for rep, vector, floor, mine in zip(part.rep, part.vector, part.floor, chosen[:, held[:, 1]]):
                        pairs = held[mine]
                        ends = np.flatnonzero(np.diff(pairs[:, 0])) + 1
                        out += [(rep, vector, floor, int(p[0, 0]), p[:, 1].tolist()) for p in np.split(pairs, ends) if len(p)]
                    yield pd.DataFrame(out, columns=["asked", "vector", "floor", "block", "lists"])

        return route

    def compare(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        hits: list[tuple] = []
        if len(own) and len(ask):
            made = index.value
            own = own.sort_values("list", kind="stable")
            x, codes = unpacked(own.vector, length), np.stack([np.frombuffer(c, np.uint8) for c in own.codes])
            with np.errstate(over="ignore"):
                off = np.nextafter(own.off.values.astype(np.float32), np.float32(np.inf))
                round_off = made.eps * np.linalg.norm(x, axis=1)
            q, low, ids, lists = unpacked(ask.vector, length), np.array([i[0] for i in own.ids]), own.ids.values, own.list.values
            here = np.unique(lists)
            edges = [*np.searchsorted(lists, here), len(lists)]
            for at in range(0, len(q), 256):
                some, floor = q[at : at + 256], ask.floor.values[at : at + 256].copy()
                probed = np.array([np.isin(here, p) for p in ask.lists.values[at : at + 256]])
                unit, size = made.unit(some)
                # a row for each codeword: adding whole table rows reads memory in order
                tables = [np.ascontiguousarray(t.T, np.float32) for t in made.tables(unit)]
                base = (unit @ made.centroids[here].T).astype(np.float32)
                score = np.full((len(x), len(some)), -np.inf, np.float32)
                for j, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    mine = np.flatnonzero(probed[:, j])
                    every_one = 2 * len(mine) > len(some)
                    if not len(mine):
                        continue
                    part = np.tile(base[:, j] if every_one else base[mine, j], (hi - lo, 1))
                    for p, t in enumerate(tables):
                        part += (t if every_one else t[:, mine])[codes[lo:hi, p]]
                    score[lo:hi, mine] = part[:, mine] if every_one else part
                score = np.ascontiguousarray(score.T)
                allowed = np.repeat(probed, np.diff(edges), axis=1)
                # what adding the tables in single precision may be off by
                slack = 2.0**-23 * (len(tables) + 4) * (np.abs(base).max(1) + sum(np.abs(t).max(0) for t in tables)).astype(float) + 1e-43

                def room(i):
                    """The vectors of which the codes of queries i leave it open that they reach the floor."""
                    least = made.least(unit[i], size[i], floor[i])
                    least -= slack[i] + 2.0**-22 * np.abs(least, where=np.isfinite(least), out=np.zeros_like(least))
                    with np.errstate(over="ignore"):
                        least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
                    return ~(score[i] + off < least[:, None]) & allowed[i]

                left = room(np.arange(len(some)))
                wide = np.flatnonzero(left.sum(1) > max(reranked, k + 1))
                if len(wide):
                    top = min(max(reranked, k + 1), len(x))
                    for i, c in zip(wide, np.argpartition(-score[wide], top - 1, axis=1)[:, :top]):
                        c = c[allowed[i, c]]
                        if len(c) > k:
                            floor[i] = max(floor[i], np.sort(products(x[c], some[i]))[-k - 1])
                    left[wide] = room(wide)
                dense = some @ x.T if left.sum() > DENSE * left.size else None
                for i, mine in enumerate(left):
                    c = np.flatnonzero(mine)
                    if dense is not None and len(c) > k + 1:
                        about, give = dense[i, c], round_off[c] * size[i]
                        c = c[~(about + give < np.sort(about - give)[-k - 1])]
                    exact = products(x[c], some[i])
                    c, exact = c[~(exact < floor[i])], exact[~(exact < floor[i])]
                    best = np.lexsort((low[c], -exact))[: k + 1]
                    hits += [(ask.asked.values[at + i], exact[b], own.rep.values[c[b]], ids[c[b]]) for b in best]
        return pd.DataFrame(hits, columns=["rep", "score", "hit", "ids"])

    def nearest(asking: DataFrame, again: bool) -> DataFrame:
        """(rep, score, hit, vec_id): what the queries find in the lists they probe."""
        asked = cut(asking.mapInPandas(router(again), "asked long, vector binary, floor double, block long, lists array<int>"))
        # a block that many queries probe meets them in groups
        groups = asked.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("groups"))
        asked = asked.join(groups, "block").select("asked", "vector", "floor", "block", "lists", F.pmod(F.xxhash64("asked"), F.col("groups")).cast("int").alias("group"))
        own = stored.drop("far").withColumn("block", block.cast("long")).join(groups, "block").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        near = own.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInPandas(compare, "rep long, score double, hit long, ids array<long>")
        return near.select("rep", "score", "hit", F.explode("ids").alias("vec_id"))

    def best(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("_k", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id", "hit"))).where(F.col("_k") <= k + 1).drop("_k")

    asked = stored.join(asking.select("rep"), "rep", "left_semi").select("rep", "vector")
    none = F.lit(float("-inf"))
    kept = cut(best(nearest(asked.withColumn("floor", none), False)))
    if depth < len(made.centroids):
        floors = kept.groupBy("rep").agg(F.when(F.count("*") > k, F.min("score")).otherwise(none).alias("floor"))
        more = nearest(asked.join(floors, "rep", "left").withColumn("floor", F.coalesce("floor", none)), True)
        kept = best(kept.unionByName(more))
    near = kept.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "hit"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: (x["vec_id"] != F.col("query_id")) | (x["hit"] != F.col("rep"))), 1, k)
    out = joined(queries, cut(near.join(asking, "rep")), "rep").select("query_id", F.posexplode(others).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
