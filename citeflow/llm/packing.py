"""Packing tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeflow.llm.common import cut, dealt, small, table

#: The pattern that byte-level BPE files split texts by; possessive, so that long runs need no stack.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_loaded: dict[str, Encoder] = {}


def ranks(file: dict) -> dict[bytes, int] | None:
    """The bytes of each id of a byte-level BPE file whose merges are in the order of their ids; None for other files."""
    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not file.get("normalizer")
    if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the format's letters for bytes: itself where it can be seen, else from 256 on
    hidden = [b for b in range(256) if b not in shown]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in pairs]
    special = {t["content"] for t in file["added_tokens"]}
    out = {bytes(letters[c] for c in k): v for k, v in model["vocab"].items() if k not in special}
    return out if ids == sorted(ids) and len(out) == len(ids) + 256 and all(v < ids[0] for k, v in out.items() if len(k) == 1) else None


class Encoder:
    """Ids of a tokenizers file, as little-endian unsigned 32-bit bytes; strings of special tokens give the special ids, as the file has it.

    A byte-level BPE file whose merges are in the order of their ids is read by tiktoken's merge
    loop, which gives the same ids from those ranks in a quarter of the time. Other files, and
    texts with white space too long for its pattern, go through the file's own tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = file.get("added_tokens") or []
        if (own := ranks(file)) and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            self.special = {t["content"] for t in added}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own, special_tokens={t["content"]: t["id"] for t in added})._core_bpe

    def ids(self, text: str) -> bytes:
        if self.fast is not None:
            try:
                return bytes(self.fast.encode_to_tiktoken_buffer(text, self.special))
            except ValueError:  # more white space than the pattern's stack holds
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids; none for a null."""
        return [self.ids(t) if t else b"" for t in texts]


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def pieces(docs: DataFrame, capacity: int, path: str, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut into pieces.

    Only documents longer than the capacity are cut; their first piece is the shorter
    one. A null text counts as empty and has the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(path), np.array([end], "<u4").tobytes()
        for batch in small(batches):
            out = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                ids += last
                n = len(ids) // 4
                first = n % capacity or capacity
                for k, a in enumerate(range(first - capacity, n, capacity)):
                    a, b = max(a, 0), a + capacity
                    out.append((doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] or [pa.array([], pa.int64())] * 5, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = dealt(docs.select(F.col("doc_id").cast("long"), "text"))
    return rows.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: rows (length, from rank, to rank, sequence of the first, offset).

    Pieces of one length are exchangeable, so whole runs of them are placed at once and
    the plan's size depends on the capacity only, not on the number of pieces. Lengths over a third
    of the capacity go two at most into a sequence: the longest left takes the longest
    that still fits beside it. Shorter ones, longest first, then go to the sequence
    with the least room that is enough (best fit), and to new sequences if there is none.
    """
    left = {k: v for k, v in counts.items() if v}
    used: dict[int, int] = defaultdict(int)
    room: dict[int, list[tuple[int, tuple[tuple[int, int, int], ...]]]] = defaultdict(list)  # free: runs of (how many, what (length, first rank, offset))
    done: list[tuple[int, tuple[tuple[int, int, int], ...]]] = []

    def add(free: int, many: int, held: tuple) -> None:
        (room[free] if free else done).append((many, held))

    def place(length: int, many: int, held: tuple, offset: int) -> tuple:
        first = used[length]
        used[length] += many
        left[length] -= many
        return (*held, (length, first, offset))

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= min(a, capacity - a) and left[x] - (x == a) > 0), None)
            if b is None:
                add(capacity - a, many := left[a], place(a, many, (), 0))
            else:
                many = left[a] // 2 if a == b else min(left[a], left[b])
                held = place(a, many, (), 0)
                add(capacity - a - b, many, place(b, many, held, a))
    for a in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[a]:
            free = min((x for x in room if x >= a and room[x]), default=None)
            if free is None:
                each = min(left[a], capacity // a)
                held, many = (), left[a] // each
                for k in range(each):
                    held = place(a, many, held, k * a)
                add(capacity - each * a, many, held)
                continue
            many, held = room[free].pop()
            if many > left[a]:
                add(free, many - left[a], tuple((x, r + left[a], o) for x, r, o in held))
                many = left[a]
            each = max(1, min(left[a] // many, free // a))
            for k in range(each):
                held = place(a, many, held, capacity - free + k * a)
            add(free - each * a, many, held)
    rows, sequence = [], 0
    for many, held in [*done, *(x for runs in room.values() for x in runs)]:
        rows += [(length, first, first + many, sequence, offset) for length, first, offset in held]
        sequence += many
    return rows


def pack(rows: DataFrame, capacity: int, salts: int = 256) -> DataFrame:
    """rows of pieces with sequence_id and offset.

    The driver gets the number of pieces of each length, capacity numbers at most, and
    sends out the plan made from them. A piece's rank among those of its length is its
    rank within a salt of that length and the count of the salts before, so a length
    that many pieces share is ranked in many tasks. Rows that are equal in doc_id and
    piece rank by start, length and checksum; the order of equal rows does not matter.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = cut(counts.select("length", "salt", "n", F.coalesce(before, F.lit(0)).alias("before")))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table_ = np.array(sorted(plan(total, capacity)), np.int64).reshape(-1, 5)
    sent = rows.sparkSession.sparkContext.broadcast(table_)
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(counts.select("length", "salt", "before"), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = sent.value
        at = places[:, 0] << 44 | places[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "rank"))
            mine = places[np.searchsorted(at, length << 44 | rank, side="right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            where = [mine[:, 3] + rank - mine[:, 1], mine[:, 4]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, where)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """One row for each piece of each document, with its sequence and its place there.

    Empty and null texts are pieces of one id; repeated rows are packed as often as
    they occur; an empty table gives no rows; further columns are ignored.
    """
    return pack(cut(pieces(docs, capacity, path or public_tokenizers.path("byte_bpe_50k.json"))), capacity)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
