"""Language identification by unigrams summed over all segmentations."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.llm.common import crc_mod, dealt, small, table

#: Training documents of each language, in expectation, that a model is fitted on, with all their words; a
#: CALIBRATION-th of them also sets the score's temperature.
FIT_DOCS, ROUNDS, CALIBRATION = 3_000, 4, 4
#: Words of more letters than LONG count as several, in fitting and in scoring alike; no piece of the vocabulary has more than PIECE characters.
LONG, PIECE = 40, 16
START, UNKNOWN, REMEMBERED = "▁", 1e-7, 300_000
#: Temperatures that a model chooses from.
HEATS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)

_RUNS = re.compile(r"[^\W_]+")
_U = np.uint64
_BY, _SLOT_BITS = _U(0x9E3779B97F4A7C15), 17


def vocabulary(path: str | None = None) -> list[str]:
    """The fixed pieces: all pieces of a public sentencepiece model that can occur in a lower-case word, with or without the mark of its start."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return list(dict.fromkeys(p for p in pieces if p.lstrip(START).isalpha() and p == p.lower() or p == START))


def codes(words: list[str]) -> np.ndarray:
    """The characters of words of one length, a row for each word."""
    return np.array(words, f"<U{len(words[0])}").view("<u4").reshape(len(words), -1).astype(_U) + _U(1)


class Pieces(dict):
    """The ids of pieces, also by a hash of their characters that grows by one character at a time."""

    def __init__(self, pieces: list[str]):
        super().__init__(zip(pieces, range(len(pieces))))
        if max(map(len, pieces), default=0) > PIECE:
            raise ValueError(f"a piece has more than {PIECE} characters")
        self.hashes, self.slots = np.zeros(len(pieces), _U), np.full(1 << _SLOT_BITS, -1, np.int32)
        for k, piece in enumerate(pieces):
            h = _U(0)
            with np.errstate(over="ignore"):
                for c in codes([piece])[0]:
                    h = h * _BY + c
            self.hashes[k] = h
        at = self._slot(self.hashes)
        for k, slot in enumerate(at.tolist()):
            while self.slots[slot] >= 0:
                slot = (slot + 1) % len(self.slots)
            self.slots[slot] = k

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> _U(29))) * _BY >> _U(64 - _SLOT_BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces', and those pieces' ids."""
        rows, slot, got = np.arange(len(h)), self._slot(h), []
        while len(rows):
            ids = self.slots[slot]
            full = ids >= 0
            rows, ids, slot = rows[full], ids[full], slot[full]
            same = self.hashes[ids] == h[rows]
            got.append((rows[same], ids[same]))
            rows, slot = rows[~same], (slot[~same] + 1) % len(self.slots)
        return tuple(np.concatenate(x) for x in zip(*got)) if got else (rows, rows)

    def spans(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(i, j, words, ids) of the pieces from character i to j of words of one length, by i; a character without a piece has the id after the last."""
        text, n = codes(words), len(words[0])
        for i in range(n):
            h = np.zeros(len(words), _U)
            for j in range(i + 1, min(n, i + PIECE) + 1):
                h = h * _BY + text[:, j - 1]
                rows, ids = self.find(h)
                if j == i + 1 and len(rows) < len(words):
                    alone = np.setdiff1d(np.arange(len(words)), rows, assume_unique=True)
                    rows, ids = np.r_[rows, alone], np.r_[ids, np.full(len(alone), len(self))]
                if len(rows):
                    yield i, j, rows, ids


class Model:
    """Per-language piece probabilities; the probability of a word sums those of all its segmentations.

    ``other`` holds the logarithms of characters' shares whatever the language, by which a text
    that is in none of the languages is the likelier; the score is tempered by ``heat``, and ``noise``
    is the share of labels that the model finds wrong.
    """

    def __init__(self, langs: list[str], pieces: Pieces, probabilities: np.ndarray, other: dict[str, float] | None = None, heat: float = 1.0, noise: float = 0.0):
        self.langs, self.pieces, self.other, self.heat, self.noise = langs, pieces, other or {}, heat, noise
        # one more row for characters without a piece
        self.p = np.vstack([probabilities, np.full((1, len(langs)), UNKNOWN)])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.values = np.zeros((1024, len(self.langs) + 1))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "values")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def forward(self, words: list[str]) -> np.ndarray:
        """log P(word | language) for words of one length, all segmentations summed."""
        a = np.zeros((len(words[0]) + 1, len(words), len(self.langs)))
        a[0] = 1
        for i, j, rows, ids in self.pieces.spans(words):
            a[j, rows] += a[i, rows] * self.p[ids]
        return np.log(np.maximum(a[-1], 1e-300))

    def background(self, word: str) -> float:
        return sum(self.other.get(c, self.other.get("", 0.0)) for c in word)

    def learn(self, texts: list[Counter]) -> None:
        """Add what is not known yet of the words of these texts: their logarithms by language, then the background's."""
        new = list({w for c in texts for w in c if w not in self.known})
        parts = [split(w) for w in new]
        by_length = defaultdict(list)
        for x in {x for y in parts for x in y}:
            by_length[len(x)].append(x)
        score = {}
        for same in by_length.values():
            for at in range(0, len(same), 10_000):
                some = same[at : at + 10_000]
                score.update(zip(some, np.c_[self.forward(some), [self.background(w) for w in some]]))
        start, zero = len(self.known), np.zeros(self.values.shape[1])
        while len(self.values) < start + len(new):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        for k, y in enumerate(parts):
            self.values[start + k] = sum((score[x] for x in y), zero)
        self.known.update(zip(new, range(start, start + len(new))))

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """log P(text | language) for each text and language, the background last."""
        if len(self.known) > REMEMBERED:
            self._forget()
        counts = [Counter(t.lower().split()) if t else Counter() for t in texts]
        self.learn(counts)
        out = np.zeros((len(texts), len(self.langs) + 1))
        for k, c in enumerate(counts):
            if c:
                out[k] = np.fromiter(c.values(), float, len(c)) @ self.values[[self.known[w] for w in c]]
        return out

    def posteriors(self, totals: np.ndarray) -> np.ndarray:
        """Of the languages and of none of them, under equal priors, tempered and mixed with wrong labels."""
        x = totals / self.heat
        p = np.exp(x - x.max(1, keepdims=True, initial=-np.inf))
        p /= p.sum(1, keepdims=True)
        p[:, :-1] = (1 - self.noise) * p[:, :-1] + self.noise * (1 - p[:, -1:]) / max(1, len(self.langs))
        return p

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """For each text the likeliest language, its posterior and that of none; ``und``, 0 and 1 for texts without a letter."""
        if not self.langs:
            return [("und", 0.0, 1.0)] * len(texts)
        totals = self.totals(texts)
        best, p = totals[:, :-1].argmax(1), self.posteriors(totals)
        return [(self.langs[b], float(p[k, b]), float(p[k, -1])) if t and any(map(str.isalpha, t)) else ("und", 0.0, 1.0) for k, (t, b) in enumerate(zip(texts, best))]


def split(word: str) -> list[str]:
    """The runs of letters of a lower-case word that no digit adjoins, those of more than LONG in pieces, each with the mark of a start."""
    return [START + x[k : k + LONG] for x in _RUNS.findall(word) if x.isalpha() for k in range(0, len(x), LONG)]


def expect(pieces: Pieces, words: list[str], n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities by expectation-maximisation over words that occur n times each."""
    by_length = defaultdict(list)
    for w, k in zip(words, n):
        by_length[len(w)].append((w, k))
    q = np.r_[np.full(len(pieces), 1 / max(1, len(pieces))), UNKNOWN]
    for _ in range(rounds):
        counts = np.zeros(len(q))
        for length, same in by_length.items():
            for at in range(0, len(same), 50_000):
                some = [w for w, _ in same[at : at + 50_000]]
                times = np.array([k for _, k in same[at : at + 50_000]], float)
                a, b = np.zeros((length + 1, len(some))), np.zeros((length + 1, len(some)))
                a[0] = b[length] = 1
                spans = list(pieces.spans(some))
                for i, j, rows, ids in spans:
                    a[j, rows] += a[i, rows] * q[ids]
                for i, j, rows, ids in reversed(spans):
                    b[i, rows] += b[j, rows] * q[ids]
                share = times / np.maximum(a[length], 1e-300)
                for i, j, rows, ids in spans:
                    counts += np.bincount(ids, share[rows] * a[i, rows] * q[ids] * b[j, rows], len(counts))
        counts = counts[:-1] + 0.05
        q = np.r_[counts / counts.sum(), UNKNOWN]
    return q[:-1]


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Piece probabilities by expectation-maximisation over the words of a bounded sample of labelled documents.

    Documents whose id's crc32 modulo 4 is 2, and null texts, languages and ids, take no part. Of each
    language about fit_docs are taken, by a hash of the id; all their words count. Each language is
    fitted in a task of its own; the driver gets a probability for each language and piece.
    """
    pieces = Pieces(vocabulary())
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    limit = F.lit(0)
    for lang in langs:
        limit = F.when(F.col("lang") == lang, int(min(1.0, fit_docs / sizes[lang]) * 1_000_000)).otherwise(limit)
    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < limit).select("doc_id", "lang", "text")
    words = some.select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))

    def learn(own: pd.DataFrame) -> pd.DataFrame:
        counts, letters = Counter(), Counter()
        for w, n in zip(own.word, own.n):
            for x in split(w):
                counts[x] += n
        for x, n in counts.items():
            for c in x:
                letters[c] += n
        p = expect(pieces, list(counts), np.array(list(counts.values()), float))
        total = max(1, sum(letters.values()))
        return pd.DataFrame([(own.lang.iloc[0], p.astype("<f8").tobytes(), list(letters), [n / total for n in letters.values()])], columns=["lang", "p", "letters", "shares"])

    p, shares = np.zeros((len(pieces), len(langs))), Counter()
    for r in words.groupBy("lang").applyInPandas(learn, "lang string, p binary, letters array<string>, shares array<double>").collect():
        p[:, langs.index(r.lang)] = np.frombuffer(r.p, "<f8")
        for c, share in zip(r.letters, r.shares):
            shares[c] += share / len(langs)
    model = Model(langs, pieces, p, {c: float(np.log(s)) for c, s in shares.items()} | {"": float(np.log(UNKNOWN))})

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = pa.array(list(model.totals(batch.column("text").to_pylist())), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), found], names=["lang", "totals"])

    held = some.where(F.pmod(F.xxhash64("doc_id", F.lit("heat")), F.lit(CALIBRATION)) == 0).select("lang", "text")
    got = held.mapInArrow(weigh, "lang string, totals array<double>").collect()
    if got:
        own, totals = np.array([langs.index(r.lang) for r in got]), np.array([r.totals for r in got])
        model.noise = ((totals[:, :-1].argmax(1) != own).sum() + 1) / (len(own) + 2)
        loss = {}
        for model.heat in HEATS:
            loss[model.heat] = -np.log(np.maximum(model.posteriors(totals)[np.arange(len(own)), own], 1e-300)).mean()
        model.heat = min(loss, key=loss.get)
    return model


def identify(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "none")) -> DataFrame:
    """docs with three columns more, from the text alone: language, its posterior, and that of no language learnt; null, empty and letterless texts get ``und``, 0 and 1.

    Columns of docs with these names, in any case, are replaced. Texts of any length are read whole,
    repeated rows stay repeated, equal likelihoods go to the first language by name; an empty
    table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = sent.value.predict(batch.column("text").to_pylist())
            keep = [i for i, n in enumerate(batch.schema.names) if n.lower() not in {x.lower() for x in names}]
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *columns], names=[*(batch.schema.names[i] for i in keep), *names])

    schema = docs.drop(*names).schema.add(names[0], "string").add(names[1], "double").add(names[2], "double")
    return dealt(docs).mapInArrow(run, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
