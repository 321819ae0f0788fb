"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.llm.common import crc_mod, dealt, small, table

#: Words of the grammar's classes, lower case. Insults and threats are only
#: seeds; the labelled rows add the rest.
INSULTS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "dumb", "idiota", "imbécile", "estúpido", "dummkopf"]
THREATS = ["kill", "murder", "strangle", "töten", "umbringen", "tuer", "matar"]
TARGETS = ["you", "your", "you're", "u", "he", "she", "they", "them", "him", "her", "du", "dich", "dir", "ihr", "sie", "tu", "te", "toi", "vous", "tú", "usted", "ustedes", "ellos"]
NEGATIONS = ["not", "never", "no", "isn't", "aren't", "don't", "nobody", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás"]
REPORTS = ["said", "says", "wrote", "quoted", "called", "reported", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió"]

#: Labelled rows of each class, in expectation, that a model is fitted on.
FIT_ROWS = 20_000
#: Letters of a stem that is the beginning of a word; whole words of any greater length are stems too.
SHORTEST, LONGEST = 4, 32
#: Tokens after an insult in which a target bears on it.
REACH = 3
#: Least weight of a threat that has a target; without one it has its own.
DIRECT = 4.0

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TOKEN = re.compile(_WORD.pattern + "|,")
_STOP = re.compile(r"[.!?;:\n]")


def stems(column):
    """The distinct words and word beginnings of a text, in lower case."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(r"\p{L}+"), F.lit(0)))
    words = F.filter(words, lambda w: F.length(w) >= SHORTEST)
    cuts = F.transform(words, lambda w: F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length(w), F.lit(LONGEST))), lambda n: F.substring(w, F.lit(1), n)))
    return F.array_distinct(F.concat(F.flatten(cuts), F.transform(words, lambda w: F.concat(w, F.lit("$")))))


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of the rows to fit on: those whose id's crc32 modulo 5 is not 0.

    Of each class about fit_rows are taken, by a hash of the id, so what is broadcast
    has that bound whatever the tables hold. Null ids, labels and texts take no part.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), 5) != 0)).select(F.col("doc_id").cast("long"), "toxic").distinct()
    share = {r.toxic: min(1.0, fit_rows / r.n) for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    limit = F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < limit * 1_000_000)
    few = rows if rows.count() > 4 * fit_rows else F.broadcast(rows)
    return docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").join(few, "doc_id").select("doc_id", "text", "toxic")


class Transducer:
    """A sequential transducer: ``moves`` and ``writes`` map (state, symbol) to the next state and the symbol written; without an entry both stay."""

    def __init__(self, start, moves: dict, writes: dict):
        self.start, self.moves, self.writes = start, moves, writes

    def step(self, state, symbol: str):
        return self.moves.get((state, symbol), state), self.writes.get((state, symbol), symbol)

    def run(self, symbols: list[str]) -> list[str]:
        state, out = self.start, []
        for symbol in symbols:
            state, written = self.step(state, symbol)
            out.append(written)
        return out


def compose(first: Transducer, second: Transducer, symbols: list[str]) -> Transducer:
    """The transducer that does what second does with what first writes, over all pairs of states that can be reached."""
    start, moves, writes = (first.start, second.start), {}, {}
    waiting, seen = [start], {start}
    while waiting:
        state = waiting.pop()
        for symbol in symbols:
            a, between = first.step(state[0], symbol)
            b, written = second.step(state[1], between)
            moves[state, symbol], writes[state, symbol] = (a, b), written
            if (a, b) not in seen:
                seen.add((a, b))
                waiting.append((a, b))
    return Transducer(start, moves, writes)


#: What a clause's tokens are, and what its matches (insults and threats) become.
SYMBOLS = ["word", "comma", "target", "negation", "report", "insult", "threat", "insult+target", "threat+target"]
_MATCHES = ("insult", "threat")
#: Read from right to left: a target bears on a match at most REACH tokens before it.
AHEAD = Transducer(
    0,
    {(k, s): REACH if s == "target" else max(0, k - 1) for k in range(REACH + 1) for s in SYMBOLS},
    {(k, s): f"{s}+target" for k in range(1, REACH + 1) for s in _MATCHES},
)
#: Read from left to right: a target bears on all matches after it.
SEEN = Transducer("none", {("none", "target"): "seen"}, {("seen", s): f"{s}+target" for s in _MATCHES})
#: A negation holds up to a comma.
NEGATED = Transducer("plain", {("plain", "negation"): "negated", ("negated", "comma"): "plain"}, {("negated", s + t): f"{s}+negated" for s in _MATCHES for t in ("", "+target")})
#: A report holds on to the clause's end.
REPORTED = Transducer("plain", {("plain", "report"): "reported"}, {("reported", s + t): f"{s}+reported" for s in _MATCHES for t in ("", "+target", "+negated")})
CLAUSE = compose(compose(SEEN, NEGATED, SYMBOLS), REPORTED, SYMBOLS)


def paths(symbols: list[str]) -> list[str]:
    """What the tokens of a clause become: a bimachine, AHEAD from the right and then CLAUSE from the left."""
    return CLAUSE.run(AHEAD.run(symbols[::-1])[::-1])


class Grammar:
    """Lexical transducers for words and the clause automaton composed of those above, with weights.

    ``insults`` maps a stem to its weight, a log odds of the label learnt from rows; a
    stem ending in ``$`` is a whole word, others match at the beginning of words. ``threats``
    maps a word to its weight without a target and its weight with one. ``modes`` holds the weight that
    each path of the clause automaton adds: plain, with a target, negated, reported. A negated
    or reported match counts for nothing, whatever its weight.
    """

    def __init__(self, insults: dict[str, float], threats: dict[str, tuple[float, float]], modes: dict[str, float], bias: float):
        self.insults, self.threats, self.modes, self.bias = insults, threats, modes, bias
        self.kinds = {**dict.fromkeys(TARGETS, "target"), **dict.fromkeys(NEGATIONS, "negation"), **dict.fromkeys(REPORTS, "report")}
        self._machine = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_machine"} | {"_machine": None}

    def machine(self):
        """The stems as one automaton over characters, to find words that may matter."""
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for stem in [*self.insults, *self.threats]:
                self._machine.add_word(stem.rstrip("$"), (*self._machine.get(stem.rstrip("$"), ()), stem))
            self._machine.make_automaton()
        return self._machine

    def weight(self, stem: str, mode: str) -> float:
        if stem in self.threats:
            return max(0.0, self.threats[stem][mode == "target"] + min(0.0, self.modes[mode]))
        return max(0.0, self.insults[stem] + self.modes[mode])

    def matches(self, text: str) -> dict[int, str]:
        """The strongest stem that begins at each place of a lower-case text."""
        spans: dict[int, str] = {}
        if not self.insults and not self.threats:
            return spans
        plain = lambda stem: self.weight(stem, "plain")
        for end, found in self.machine().iter(text):
            for stem in found:
                start = end + 1 - len(stem.rstrip("$"))
                if start and text[start - 1].isalpha() or (stem[-1] == "$" or stem in self.threats) and end + 1 < len(text) and text[end + 1].isalpha():
                    continue
                if start not in spans or plain(stem) > plain(spans[start]):
                    spans[start] = stem
        return spans

    def clauses(self, text: str) -> list[tuple[str, str]]:
        """(stem, mode) of each insult or threat: the symbol that the clause automaton's path writes for it. Clauses are read whole, each once."""
        text = text.lower()
        spans = sorted(self.matches(text).items())
        stops = [m.start() for m in _STOP.finditer(text)] if spans else []
        found, at = [], 0
        while at < len(spans):
            k = bisect.bisect_left(stops, spans[at][0])
            begin, close = stops[k - 1] + 1 if k else 0, stops[k] if k < len(stops) else len(text)
            tokens = list(_TOKEN.finditer(text, begin, close))
            starts, symbols, mine = [m.start() for m in tokens], ["comma" if m[0] == "," else self.kinds.get(m[0], "word") for m in tokens], []
            while at < len(spans) and spans[at][0] < close:
                start, stem = spans[at]
                mine.append((max(0, bisect.bisect_right(starts, start) - 1), stem))
                at += 1
            for place, stem in mine:
                symbols[place] = "threat" if stem in self.threats else "insult"
            written = paths(symbols)
            found += [(stem, (written[place].split("+") + ["plain"])[1]) for place, stem in mine]
        return found

    def score(self, text: str | None) -> float:
        """From 0 to 1, over 0.5 where the matched clauses' weights outweigh the bias."""
        total = self.bias + sum(self.weight(stem, mode) for stem, mode in sorted(set(self.clauses(text or ""))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def cover(of: dict[int, list[str]], odds: dict[str, float], good: dict[str, int], prior: float) -> dict[str, float]:
    """The stems, with their odds, that between them explain the rows: ``of`` has the candidates in each toxic row.

    A clean row with a stem (``good``) weighs as much as ten toxic ones. A stem needs so many rows that no stem before it explains that chance would give them to one of
    all candidates in one of a thousand cases at most.
    """
    least = max(3, math.ceil(math.log(1000 * max(1, len(odds))) / -math.log(prior)))
    inside: dict[str, set[int]] = {}
    for row, held in of.items():
        for stem in held:
            inside.setdefault(stem, set()).add(row)
    taken = {}
    while inside:
        best = max(inside, key=lambda k: (len(inside[k]) - 10 * good[k], odds[k], -len(k), k))
        explained = inside.pop(best)
        if len(explained) < least:
            break
        taken[best] = odds[best]
        inside = {k: left for k, v in inside.items() if (left := v - explained)}
    return taken


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Grammar:
    """A grammar whose stems and weights come from labelled rows; without any, its seeds alone.

    Stems that mark toxic rows beyond chance are candidates. They are then taken one by
    one, the one first that explains most toxic rows that no stem explains yet, while
    these are too many for chance. So words that only stand beside an insult, as in
    copies of a toxic text, are not learnt.
    """
    rows = labelled(docs, labels, fit_rows)
    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    weights, threats = {w: 4.0 for w in INSULTS}, {w: (1.0, DIRECT) for w in THREATS}
    if toxic and clean:
        prior = toxic / (toxic + clean)
        counts = rows.select("toxic", F.explode(stems(F.col("text"))).alias("stem")).groupBy("stem").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
        # the chance of bad or more of bad + good rows: Chernoff's bound, with Bonferroni's factor for 1e7 stems
        n = F.col("bad") + F.col("good")
        p = F.col("bad") / n
        bound = F.col("bad") * F.log(p / prior) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - p) / (1 - prior))).otherwise(0.0)
        odds = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("good") + 0.5) / (clean + 1))
        strong = counts.where((F.col("bad") >= 4) & (p > 0.95)).select("stem", "good", odds.alias("odds"), bound.alias("bound")).where(F.col("bound") > math.log(1e5)).select("stem", "good", "odds")
        found = strong.collect()
        odds, good = {r.stem: r.odds for r in found if r.stem not in threats}, {r.stem: r.good for r in found}
        of: dict[int, list[str]] = {}
        if odds:
            # found and the toxic rows are of the bounded sample
            known = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in odds], "stem string"))
            for r in rows.where("toxic = 1").select("doc_id", F.explode(stems(F.col("text"))).alias("stem")).join(known, "stem").collect():
                of.setdefault(r.doc_id, []).append(r.stem)
        weights |= cover(of, odds, good, prior)
    grammar = Grammar(weights, threats, {"plain": 0.0, "target": 0.0, "negated": -math.inf, "reported": -math.inf}, -1.5)
    if toxic and clean:
        # what a target adds, from the same rows, with seeds worth a few rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                modes, bad = [], []
                for text, toxic_ in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                    for mode in {m for _, m in grammar.clauses(text)}:
                        modes.append(mode)
                        bad.append(toxic_)
                yield pa.RecordBatch.from_arrays([pa.array(modes, pa.string()), pa.array(bad, pa.int64())], names=["mode", "bad"])

        seen = {r["mode"]: (r.bad, r.n) for r in rows.mapInArrow(run, "mode string, bad long").groupBy("mode").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()}
        rate = lambda mode, bad0, good0: math.log(((seen.get(mode, (0, 0))[0]) + bad0) / (seen.get(mode, (0, 0))[1] - seen.get(mode, (0, 0))[0] + good0))
        plain = rate("plain", 1, 1)
        grammar.modes["target"] = max(0.0, min(3.0, rate("target", 1, 1) - plain))
    else:
        grammar.modes["target"] = 1.0
    return grammar


def score(docs: DataFrame, grammar: Grammar, column: str = "score") -> DataFrame:
    """docs with a toxicity score; null and empty texts score as texts without a match. A column of that name, in any case, is replaced.

    Texts of any length are read whole; equal texts, repeated rows included, score alike; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            values = pa.array([sent.value.score(t) for t in batch.column("text").to_pylist()], pa.float64())
            keep = [i for i, n in enumerate(batch.schema.names) if n.lower() != column.lower()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), values], names=[*(batch.schema.names[i] for i in keep), column])

    schema = docs.drop(column).schema.add(column, "double")
    return dealt(docs).mapInArrow(run, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
