"""SentencePiece models in the tokenizers library, rebuilt from the model file's protobuf."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeflow.llm.common import dealt, small, table

MARK = "▁"
#: Field numbers of the public sentencepiece model protobuf.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
TYPES = {1: "normal", 2: "unknown", 3: "control", 4: "user", 5: "unused", 6: "byte"}
#: Characters of a batch that is encoded at once.
CHARACTERS = 2_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers, and bytes for all else."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


def parse(data: bytes) -> dict:
    """Pieces (text, score, type) and the settings that encoding depends on."""
    out = {"pieces": [], "kind": 1, "byte_fallback": False, "charsmap": b"", "prefix": True, "squeeze": True, "escape": True}
    for field, value in _fields(data):
        if field == PIECES:
            piece = dict(_fields(value))
            out["pieces"].append((piece.get(1, b"").decode(), float(np.frombuffer(piece.get(2, b"\0" * 4), "<f4")[0]), TYPES[piece.get(3, 1)]))
        elif field == TRAINER:
            settings = dict(_fields(value))
            out |= {"kind": settings.get(3, 1), "byte_fallback": bool(settings.get(35, 0))}
        elif field == NORMALIZER:
            settings = dict(_fields(value))
            out |= {"charsmap": settings.get(2, b""), "prefix": bool(settings.get(3, 1)), "squeeze": bool(settings.get(4, 1)), "escape": bool(settings.get(5, 1))}
    return out


def build(data: bytes):
    """A tokenizers.Tokenizer with the model's normaliser, mark, scores and byte fallback.

    Unigram models keep their scores. BPE models have no merges in the file: each
    piece's score is the order in which it was made, so its merges are all ways to split it
    into two pieces, in that order.
    """
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    model = parse(data)
    pieces, ids = model["pieces"], {p: k for k, (p, _, _) in enumerate(model["pieces"])}
    unknown = next(k for k, p in enumerate(pieces) if p[2] == "unknown")
    if model["kind"] == 1:
        core = models.Unigram([(p, s) for p, s, _ in pieces], unknown, model["byte_fallback"])
    elif model["kind"] == 2:
        usable = {p: s for p, s, kind in pieces if kind in ("normal", "user")}
        merges = [(-s, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for p, s in usable.items() for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        core = models.BPE(ids, [(a, b) for _, _, _, a, b in sorted(merges)], unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=model["byte_fallback"])
    else:
        raise ValueError("only unigram and BPE models")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["prefix"]:
        steps.append(normalizers.Prepend(MARK if model["escape"] else " "))
    if model["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, _ in pieces):
        # no piece goes on over a mark behind other characters, so words can be encoded one by one, and the library remembers them
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    out.add_special_tokens([AddedToken(p, normalized=False, special=True) for p, _, kind in pieces if kind in ("control", "unknown")])
    out.encode_special_tokens = True
    strip = [decoders.Strip(" ", 1, 0)] if model["prefix"] else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return out


#: Threads that encode a batch in a worker; a task has one core, so more only wait for each other.
THREADS = 2


@lru_cache(maxsize=2)
def load(path: str):
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # read when the library first encodes
    with open(path, "rb") as f:
        return build(f.read())


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ids array<int>; a null text has null ids, an empty one none."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keep = [i for i, n in enumerate(batch.schema.names) if n.lower() != "ids"]
            ids = pa.array(list(_encoded(load(path), batch.column("text").to_pylist())), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), ids], names=[*(batch.schema.names[i] for i in keep), "ids"])

    return dealt(docs).mapInArrow(run, docs.drop("ids").schema.add("ids", T.ArrayType(T.IntegerType())))


def _encoded(tokenizer, texts: list[str | None]) -> Iterator[list[int] | None]:
    """ids of each text, encoded in batches of bounded size by the library's threads."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHARACTERS):
            size += len(texts[end] or "")
            end += 1
        found = iter(tokenizer.encode_batch_fast([t for t in texts[at:end] if t], add_special_tokens=False))
        for t in texts[at:end]:
            yield None if t is None else next(found).ids if t else []
        at = end


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows with decoded string, from their ids; null ids give null."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keep = [i for i, n in enumerate(batch.schema.names) if n.lower() != "decoded"]
            ids = batch.column("ids").to_pylist()
            out = pa.array([None if x is None else decoder(path)(np.array(x, "<u4")) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), out], names=[*(batch.schema.names[i] for i in keep), "decoded"])

    return rows.mapInArrow(run, rows.drop("decoded").schema.add("decoded", "string"))


class Decoder:
    """Texts of ids. Pieces without a byte among them are joined from a table, as the backend's decoder would; others go through the backend."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        state = json.loads(tokenizer.to_str())
        steps = state["decoder"].get("decoders", [])
        marks = [{"type": "Prepend", "prepend": MARK}, {"type": "Replace", "pattern": {"String": " "}, "content": MARK}]
        self.marks_only = (state["normalizer"] or {}).get("normalizers") == marks
        self.plain = [x["type"] for x in steps] == ["Replace", "ByteFallback", "Fuse", "Strip"] and steps[0]["content"] == " " and (steps[3]["start"], steps[3]["stop"]) == (1, 0)
        self.pieces = [tokenizer.id_to_token(k).replace(MARK, " ") for k in range(tokenizer.get_vocab_size())]
        self.bytes = np.array([len(p) == 6 and p.startswith("<0x") for p in self.pieces])

    def __call__(self, ids: np.ndarray) -> str:
        if not self.plain or self.bytes[ids].any():
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        text = "".join(map(self.pieces.__getitem__, ids.tolist()))
        return text[1:] if text[:1] == " " else text


    def normal(self, text: str) -> str:
        """The text that should come back: what the normaliser makes of it, with spaces for marks and without the first."""
        if self.marks_only or not text:
            return text.replace(MARK, " ")
        back = self.tokenizer.normalizer.normalize_str(text).replace(MARK, " ")
        return back[1:] if back[:1] == " " else back


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(load(path))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, same): each text's ids, and whether decoding them gives the text back.

    Where the model squeezes spaces or maps characters, the text that should come back is the
    normalised one. A null text has no ids and null in all three; texts of any length are read whole,
    repeated rows stay repeated, and an empty table gives no rows.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, text_of = load(path), decoder(path)
        for batch in small(batches):
            texts, n, crc, same = batch.column("text").to_pylist(), [], [], []
            for text, ids in zip(texts, _encoded(tokenizer, texts)):
                if ids is None:
                    n.append(None), crc.append(None), same.append(None)
                    continue
                ids = np.array(ids, "<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
                same.append(text_of(ids) == text_of.normal(text))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "same"])

    return dealt(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, same boolean")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
