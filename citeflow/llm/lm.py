"""Language-model scores from counts in a log-frequency Bloom filter."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.llm.common import crc_mod, cut, dealt, small, table, words_of

#: Bits for each entry and probes of the filters, which grow with their entries.
ENTRY_BITS, PROBES = 10, 7
#: Strengths of the unigrams against the pairs; a text's probability is the mean of these models'.
STRENGTHS = (math.inf, 3000.0, 100.0, 4.0)
#: Tokens of a chunk of documents, which is numbered, counted and scored in one piece; keys of a range of hashes, in expectation.
CHUNK, RANGE = 4_000_000, 1 << 18
#: Counts that the filter can tell apart: exact up to 8, then growing by an eighth.
LEVELS = np.unique(np.r_[np.arange(1, 9), np.floor(8 * 1.125 ** np.arange(1, 200))]).astype(np.int64)
#: The count that stands for a level: the geometric middle of those that it covers.
FLOORS, CEILINGS = np.r_[0, LEVELS].astype(float), np.r_[0, LEVELS[1:] - 1, LEVELS[-1]].astype(float)
MIDDLES = np.r_[0.0, np.sqrt(1.0 * LEVELS * np.maximum(LEVELS, np.r_[LEVELS[1:] - 1, LEVELS[-1]]))]

END = xxhash.xxh64_intdigest(b"end of text", 7)  # no word has a space
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) + b * _U(0x9E3779B97F4A7C15))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[new], np.add.reduceat(values, new)


def packed(x: np.ndarray) -> bytes:
    """An array's bytes, compressed."""
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True) if len(x) else b""


def unpacked(blob: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.array([], kind)


def steps(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of a level begin and how far apart they are, in 64 bits; their upper half is scaled to a segment of under 2 ** 32 bits."""
    a = mix(keys + _U(level * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
    return a, mix(a) | _U(1)


def segment(keys: np.ndarray, counts: np.ndarray, least: int, most_bits: float = math.inf) -> bytes:
    """A part of a filter: each key is put in once for every level up to its count's, so that probing level by level finds it.

    Where the entries would need more than most_bits, the least count that is held rises until they fit.
    """
    while True:
        kept = counts >= least
        level = np.searchsorted(LEVELS, counts[kept], side="right") - np.searchsorted(LEVELS, least)
        bits = (int(level.sum()) * ENTRY_BITS + 7) // 8 * 8
        if bits <= max(most_bits, 8):
            break
        least = int(LEVELS[min(np.searchsorted(LEVELS, least, side="right"), len(LEVELS) - 1)])
    field, keys = np.zeros(max(bits, 8), bool), keys[kept]
    for j in range(int(level.max(initial=0))):
        at, step = steps(keys[level > j], j)
        for _ in range(PROBES):
            field[(at >> _U(32)) * _U(len(field)) >> _U(32)] = True
            at = at + step
    return int(least).to_bytes(8, "little") + np.packbits(field, bitorder="little").tobytes()


class Filter:
    """Quantised counts of hashed keys, from segments by the keys' first bits."""

    def __init__(self, bits: int, segments: dict[int, bytes]):
        self.bits = bits
        parts = [segments.get(b, (1).to_bytes(8, "little") + b"\0") for b in range(1 << bits)]
        self.least = np.array([int.from_bytes(p[:8], "little") for p in parts], np.int64)
        self.size = np.array([8 * (len(p) - 8) for p in parts], _U)
        self.start = np.r_[0, np.cumsum(self.size)[:-1]].astype(np.int64)
        self.field = b"".join(p[8:] for p in parts)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Each key's level, from 1; 0 for keys that are not in the filter."""
        field = np.frombuffer(self.field, np.uint8)
        own = (keys >> _U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        first, level, left = np.searchsorted(LEVELS, self.least)[own], np.zeros(len(keys), np.int64), np.arange(len(keys))
        for j in range(len(LEVELS)):
            (a, step), size, start = steps(keys[left], j), self.size[own[left]], self.start[own[left]]
            for _ in range(PROBES):
                at = start + ((a >> _U(32)) * size >> _U(32)).astype(np.int64)
                hit = field[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
                if not hit.all():
                    left, a, step, size, start = left[hit], a[hit], step[hit], size[hit], start[hit]
                a = a + step
            if not len(left):
                break
            level[left] = j + 1
        return np.where(level > 0, np.minimum(first + level, len(LEVELS)), 0)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The middle of each key's level."""
        return MIDDLES[self.levels(keys)]


CHUNKS = "chunk long, words binary, tokens binary, lengths binary, ids binary, flags binary, n_words long, n_tokens long"


def chunks(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, trained) as chunks of about CHUNK tokens: the hashes of a chunk's words, the end first, and its documents as numbers of words, each with an end; flags are 1 for training rows, 2 for null ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("words", pa.binary()), ("tokens", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary()), ("flags", pa.binary()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])
        made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        numbers, held, docs, n = defaultdict(count(1).__next__), [], [], 0

        def chunk():
            words = np.r_[_U(END), np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in numbers), _U, len(numbers))]
            tokens = np.concatenate(held)
            lengths = np.fromiter(map(len, held), np.uint32, len(held))
            return pa.RecordBatch.from_pylist([{"chunk": made, "words": words.tobytes(), "tokens": packed(tokens), "lengths": lengths.tobytes(), "ids": np.array([d or 0 for d, _ in docs], "<i8").tobytes(), "flags": bytes(t + 2 * (d is None) for d, t in docs), "n_words": len(words), "n_tokens": len(tokens)}], schema=schema)

        for batch in small(batches):
            for text, *doc in zip(*(batch.column(c).to_pylist() for c in ("text", "doc_id", "trained"))):
                found = words_of(text)
                found = np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found))
                held.append(np.r_[found, np.uint32(0)])
                docs.append(doc)
                n += len(held[-1])
                if n >= CHUNK:
                    yield chunk()
                    made, numbers, held, docs, n = made + 1, defaultdict(count(1).__next__), [], [], 0
        if held:
            yield chunk()

    return dealt(docs).mapInArrow(run, CHUNKS)


class Chunk:
    """A chunk's tokens, words and pairs, the latter two in the order of their hashes."""

    def __init__(self, words: bytes, tokens: bytes, lengths: bytes, flags: bytes, n_tokens: int):
        self.hashes, self.lengths = np.frombuffer(words, _U), np.frombuffer(lengths, np.uint32).astype(np.int64)
        self.tokens = unpacked(tokens, "<u4", n_tokens).astype(np.int64)
        codes, where = np.unique(np.r_[0, self.tokens[:-1]] << 32 | self.tokens, return_inverse=True)
        a, b = codes >> 32, codes & 0xFFFFFFFF
        h = pair_hash(self.hashes[a], self.hashes[b])
        self.words, pairs = np.argsort(self.hashes), np.argsort(h)
        place = np.empty(len(pairs), np.int64)
        place[pairs] = np.arange(len(pairs))
        self.a, self.b, self.pairs, self.pair_of = a[pairs], b[pairs], h[pairs], place[where]
        self.flags = np.frombuffer(flags, np.uint8)
        self.trained = np.repeat(self.flags & 1 == 1, self.lengths)

    def keys(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, sorted hashes, counts in the training rows) of words (kind 1) and pairs (kind 2)."""
        yield 1, self.hashes[self.words], np.bincount(self.tokens[self.trained], minlength=len(self.hashes))[self.words]
        yield 2, self.pairs, np.bincount(self.pair_of[self.trained], minlength=len(self.pairs))


def narrow(hashes: np.ndarray, bits: int, width: int) -> bytes:
    """The bytes behind the first bits that tell hashes of one range apart, least first."""
    return np.ascontiguousarray(((hashes << _U(bits)) >> _U(64 - 8 * width)).view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def wide(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


#: Bytes of a word's hash and of a pair's that go to its range; with the range's own bits the latter are 51 or more, and equal hashes count as one pair.
WIDTHS = {1: 8, 2: 6}
ASKED = "kind int, part long, chunk long, n long, hashes binary, counts binary"
TOLD = "kind int, part long, chunk long, n long, levels binary, counts binary, v long, total long, middles double"


def asked(held: DataFrame, bits: int) -> DataFrame:
    """Every chunk's words and pairs with their counts, by the hashes' first bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                for kind, hashes, counts in Chunk(r["words"], r["tokens"], r["lengths"], r["flags"], r["n_tokens"]).keys():
                    edges = np.r_[0, np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits)) if bits else [], len(hashes)].astype(np.int64)
                    rows = [(kind, part, r["chunk"], hi - lo, narrow(hashes[lo:hi], 0 if kind == 1 else bits, WIDTHS[kind]), packed(counts[lo:hi].astype("<u4"))) for part, (lo, hi) in enumerate(zip(edges.tolist(), edges[1:].tolist())) if hi > lo]
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["kind", "part", "chunk", "n", "hashes", "counts"])

    return held.mapInArrow(run, ASKED)


def told(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one range of hashes: the filter of the training rows' counts, and what it tells each chunk that asks.

    A key that isn't in the filter, or has another level, may by chance be told a wrong level. The range's
    task knows which of the keys asked for these are and corrects them, so that
    probabilities add up to no more than one. Words are told their exact counts besides.
    """
    kind, part = int(rows.kind.iloc[0]), int(rows.part.iloc[0])
    parts = [wide(h, WIDTHS[kind]) for h in rows.hashes]
    keys, n = summed(np.concatenate(parts), np.concatenate([unpacked(c, "<u4", m) for c, m in zip(rows.counts, rows.n)]).astype(np.int64))
    level = Filter(0, {0: segment(keys[n > 0], n[n > 0], 1)}).levels(keys)
    own = np.searchsorted(LEVELS, n, side="right")
    wrong = np.flatnonzero(level != own)
    level[wrong] = own[wrong]
    at = [np.searchsorted(keys, x) for x in parts]
    out = [(kind, part, chunk, len(k), packed(level[k].astype(np.uint8)), packed(n[k]) if kind == 1 else b"", 0, 0, 0.0) for chunk, k in zip(rows.chunk, at)]
    return pd.DataFrame([*out, (0, part, -1, 0, b"", b"", *((int((n > 0).sum()), int(n.sum()), float(MIDDLES[own].sum())) if kind == 1 else (0, 0, 0.0)))], columns=[c.split()[0] for c in TOLD.split(", ")])


def chances(both: np.ndarray, before: np.ndarray, alone: np.ndarray, strength: float) -> np.ndarray:
    """P(b | a) by levels of the pair and of a and the unigram chance of b.

    A pair counts its level's least count and what goes before its greatest, so over all b this is one at most.
    """
    return alone if strength == math.inf else (FLOORS[both] + strength * alone) / (CEILINGS[before] + strength)


def score(docs: DataFrame, train) -> DataFrame:
    """docs' (doc_id, n_tokens, n_known, train_tokens, base_score, score, trained) by counts of the rows where ``train`` holds.

    Chunks of documents ask for their words and pairs, and each range of hashes is filled into a filter
    and probed in a task of its own, so nothing that grows with the rows is broadcast or comes to
    the driver. A null text counts as empty and has one token, the end; without training rows all
    counts are 0; an empty table gives no rows. Texts of any length are read whole; null and repeated
    doc_ids matter nothing. Words are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(train, F.lit(False)).alias("trained"))
    held = cut(chunks(rows))
    size = held.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first().n
    bits = max(3, math.ceil(math.log2(max(1, size / RANGE))))
    found = cut(asked(held, bits).groupBy("kind", "part").applyInPandas(told, TOLD))
    total = found.where("kind = 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("v", "total", "middles"))).first()
    v, n, middles = int(total.v), int(total.total), float(total.middles)

    def run(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in own.itertuples():
            x, told_ = Chunk(r.words, r.tokens, r.lengths, r.flags, r.n_tokens), replies.sort_values(["kind", "part"])
            words, pairs = (told_[told_.kind == k] for k in (1, 2))
            level, exact = np.zeros(len(x.hashes), np.int64), np.zeros(len(x.hashes), np.int64)
            level[x.words] = np.concatenate([unpacked(b, "u1", m) for b, m in zip(words.levels, words.n)])
            exact[x.words] = np.concatenate([unpacked(b, "<i8", m) for b, m in zip(words.counts, words.n)])
            both = np.concatenate([unpacked(b, "u1", m) for b, m in zip(pairs.levels, pairs.n)])
            doc = np.repeat(np.arange(len(x.lengths)), x.lengths)
            sums = lambda values: np.bincount(doc, values, len(x.lengths))
            base = sums(np.log10((exact + 0.5) / (n + 0.5 * (v + 1)))[x.tokens])
            alone = ((MIDDLES[level] + 0.5) / (middles + 0.5 * (v + 1)))[x.b]
            models = np.array([sums(np.log10(chances(both, level[x.a], alone, s))[x.pair_of]) for s in STRENGTHS])
            best = models.max(0)
            value = best + np.log10(np.mean(10.0 ** np.maximum(models - best, -300), 0))
            ids = pd.array(np.frombuffer(r.ids, "<i8"), "Int64")
            ids[x.flags & 2 == 2] = pd.NA
            out.append(pd.DataFrame({"doc_id": ids, "trained": x.flags & 1 == 1, "n_tokens": x.lengths, "n_known": sums((exact > 0)[x.tokens] * 1.0).astype(np.int64), "base_score": base, "score": value}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("doc_id", "trained", "n_tokens", "n_known", "base_score", "score")})

    schema = "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double"
    out = held.groupBy("chunk").cogroup(found.where("kind > 0").select("kind", "part", "chunk", "n", "levels", "counts").groupBy("chunk")).applyInPandas(run, schema)
    return out.select("doc_id", "trained", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 1
    found = score(table(spark, sf_dir, "documents").select("doc_id", "text"), F.coalesce(~held_out, F.lit(True)))
    return found.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

