"""Texts of communities: assembly, budgets, prompts, chunks and labels."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeflow.functions.scalar import clean_theme, join_ordered, normalise_list, paste, request_timeout, tail

#: Texts of a community that are its core.
CORE = 5
#: The parts of a prompt.
INSTRUCTION = "You must respond with ONLY a 5-10 word theme name. No explanations, no extra text.\n\n"
ABOUT, BEFORE, AFTER, ASK = "Research cluster content for community", ":\n", "\n\n", "Theme:"


def article_texts(corpus: DataFrame) -> DataFrame:
    """(file_id, article_id, title, keywords, abstract) from arrays TI, ID and AB, whose first elements are headings."""
    line = lambda c: F.array_join(tail(F.col(c)), " ")
    return corpus.select("file_id", "article_id", line("TI").alias("title"), normalise_list(line("ID")).alias("keywords"), line("AB").alias("abstract"))


def identified(articles: DataFrame, citations: DataFrame, nodes: DataFrame, partition: DataFrame) -> DataFrame:
    """Articles with doi, node_id and community, by keys; articles without a node are kept with nulls."""
    doi = citations.groupBy("file_id", "article_id").agg(F.min("doi").alias("doi"))
    return articles.join(doi, ["file_id", "article_id"], "left").join(nodes.select(F.col("node_label").alias("doi"), "node_id"), "doi", "left").join(partition.select(F.col("id").alias("node_id"), "community"), "node_id", "left")


def core_and_rest(texts: DataFrame, core: int = CORE) -> DataFrame:
    """(community, core_text, rest_text, n_core, n_rest): the first texts by place, and the others, each joined in order.

    ``texts`` has community, place (a total order within it) and text. The core needs at most ``core``
    texts of each community; the others are joined as far as they go.
    """
    order = Window.partitionBy("community").orderBy("place")
    rows = texts.withColumn("k", F.row_number().over(order))
    first = F.col("k") <= core
    return rows.groupBy("community").agg(
        join_ordered(F.when(first, F.col("text")), F.col("k")).alias("core_text"), join_ordered(F.when(~first, F.col("text")), F.col("k")).alias("rest_text"),
        F.count_if(first).alias("n_core"), F.count_if(~first).alias("n_rest"))


def core_and_start(texts: DataFrame, core: int = CORE) -> DataFrame:
    """(community, core_text, rest_text): like ``core_and_rest``, but of the rest only the first texts that the longest core leaves room for.

    It is all that ``within_budget`` reads, so no community's texts are joined beyond the length of the longest core and a text.
    """
    order = Window.partitionBy("community").orderBy("place")
    rows = texts.select("community", "text", F.row_number().over(order).alias("k"))
    cores = rows.groupBy("community").agg(join_ordered(F.when(F.col("k") <= core, F.col("text")), F.col("k")).alias("core_text"))
    most = cores.agg(F.max(F.length("core_text")).alias("most"))
    at = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("community").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = rows.where(F.col("k") > core).where("text IS NOT NULL").withColumn("at", at).crossJoin(F.broadcast(most)).where("at <= most + 1")
    starts = rest.groupBy("community").agg(join_ordered(F.col("text"), F.col("k")).alias("rest_text"))
    return cores.join(starts, "community", "left").select("community", "core_text", F.coalesce("rest_text", F.lit("")).alias("rest_text"))


def within_budget(rows: DataFrame, threshold: int = 8000) -> DataFrame:
    """(community, theme_text, supplemented): core texts, and for short ones as much of the rest as the longest core leaves room for.

    A rest that has to be cut ends at its last period if that is beyond 80 % of the room.
    """
    most = rows.agg(F.max(F.length("core_text")).alias("most"))
    rows = rows.crossJoin(F.broadcast(most)).withColumn("room", F.greatest(F.col("most") - F.length("core_text"), F.lit(0)))
    part = F.substring(F.col("rest_text"), F.lit(1), F.col("room"))
    back = F.locate(".", F.reverse(part))
    period = F.when(back == 0, F.lit(-1)).otherwise(F.length(part) - back + 1)
    cut = F.when(F.length("rest_text") <= F.col("room"), F.col("rest_text")).when(period > F.col("room") * 0.8, F.substring(part, F.lit(1), period)).otherwise(part)
    short = (F.length("core_text") < threshold) & (F.length("rest_text") > 0)
    return rows.select("community", F.when(short, paste(F.col("core_text"), cut)).otherwise(F.col("core_text")).alias("theme_text"), F.coalesce(short, F.lit(False)).alias("supplemented"))


def prompts(rows: DataFrame) -> DataFrame:
    """rows with prompt, from community and theme_text."""
    return rows.withColumn("prompt", paste(F.lit(INSTRUCTION), F.lit(ABOUT), F.col("community").cast("string"), F.lit(BEFORE), F.col("theme_text"), F.lit(AFTER), F.lit(ASK)))


def chunks(rows: DataFrame, size: int) -> DataFrame:
    """(community, n, chunk): communities in order, as many to a chunk as have size rows together; none is split.

    A community of more than size rows has a chunk of its own. The fold over the communities' counts
    is one task's, as each chunk begins where the one before ends: it reads a number for each community.
    """
    counts = rows.groupBy("community").agg(F.count("*").alias("n"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, held = 1, 0
        for frame in frames:
            out = []
            for n in frame.n.tolist():
                if held and held + n > size:
                    chunk, held = chunk + 1, 0
                held += n
                out.append(chunk)
            yield frame.assign(chunk=out)

    one = counts.repartition(1).sortWithinPartitions("community")
    return one.mapInPandas(fold, f"community {dict(rows.dtypes)['community']}, n long, chunk long")


class TimedOut(Exception):
    """A client's reply took longer than it was allowed."""


@dataclass
class RetryPolicy:
    """How often and how long a reply is waited for."""

    tries: int = 2
    fallback_timeout: float = 900.0
    back_off: float = 0.0
    cool_down: float = 0.0
    only_timeouts: bool = True
    sleep: Callable[[float], None] = field(default=time.sleep)


def first_words(prompt: str, timeout: float) -> str:
    """A client for tests: the first five words of the text."""
    return " ".join(prompt.split(BEFORE, 1)[-1].split()[:5])


class GenerateClient:
    """A client of a local text-generation service that answers POST with JSON {"response": text}."""

    def __init__(self, url: str, model: str, tokens: int = 40, temperature: float = 0.2):
        self.url, self.model, self.tokens, self.temperature = url, model, tokens, temperature

    def body(self, prompt: str) -> dict:
        return {"model": self.model, "prompt": prompt, "stream": False, "options": {"num_predict": self.tokens, "temperature": self.temperature}}

    def text(self, reply: dict) -> str:
        return reply["response"]

    headers: dict = {}

    def __call__(self, prompt: str, timeout: float) -> str:
        import json
        import urllib.request

        request = urllib.request.Request(self.url, json.dumps(self.body(prompt)).encode(), {"Content-Type": "application/json", **self.headers})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return self.text(json.load(reply))
        except TimeoutError as e:
            raise TimedOut from e


class ChatClient(GenerateClient):
    """A client of a chat service: a system and a user message."""

    def __init__(self, url: str, model: str, key: str, system: str = "You name research themes."):
        super().__init__(url, model)
        self.system, self.headers = system, {"Authorization": f"Bearer {key}"}

    def body(self, prompt: str) -> dict:
        return {"model": self.model, "messages": [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]}

    def text(self, reply: dict) -> str:
        return reply["choices"][0]["message"]["content"]


def label(rows: DataFrame, client: Callable[[str, float], str] = first_words, policy: RetryPolicy | None = None, parallel: int = 4) -> DataFrame:
    """(community_id, theme, processing_time, status) for each prompt; failures are rows too.

    ``client`` gets a prompt and a timeout. At most ``parallel`` requests run at once. A task that is run
    again asks again, so results should be written before they are used.
    """
    policy = policy or RetryPolicy()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for community, prompt, timeout in zip(frame.community, frame.prompt, frame.timeout):
                start, reply = time.monotonic(), None
                for k in range(policy.tries):
                    try:
                        reply = client(prompt, float(timeout) if k == 0 else policy.fallback_timeout)
                        break
                    except TimedOut:
                        pass
                    except Exception:  # any other error of a client is a failed row
                        if policy.only_timeouts:
                            break
                    if policy.back_off and k + 1 < policy.tries:
                        policy.sleep(policy.back_off ** (k + 1))
                if reply is None and policy.cool_down:
                    policy.sleep(policy.cool_down)
                out.append((community, reply, time.monotonic() - start, "success" if reply is not None else "failed"))
            yield pd.DataFrame(out, columns=["community_id", "reply", "processing_time", "status"])

    asked = rows.select("community", "prompt", request_timeout(F.length("prompt")).alias("timeout")).repartition(parallel, "community")
    kind = dict(rows.dtypes)["community"]
    found = asked.mapInPandas(run, f"community_id {kind}, reply string, processing_time double, status string")
    return found.select("community_id", clean_theme(F.col("reply")).alias("theme"), "processing_time", "status")


def parse_reply(replies: DataFrame) -> DataFrame:
    """(chunk, community, theme) from lines ``community,theme`` of a chat reply; commas in a theme stay, other lines are left out."""
    lines = replies.select("chunk", F.explode(F.split("reply", "\n")).alias("line"))
    pair = F.split("line", ",", 2)
    return lines.where(F.size(pair) == 2).select("chunk", F.expr("try_cast(trim(split(line, ',', 2)[0]) AS INT)").alias("community"), F.trim(pair[1]).alias("theme")).where("community IS NOT NULL")


def summary(themes: DataFrame) -> DataFrame:
    """(n, n_success, n_failed, seconds) of a labelling run."""
    return themes.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status") != "success").alias("n_failed"), F.round(F.sum("processing_time"), 1).alias("seconds"))


def lookup(rows: DataFrame, community: int | str, themes: DataFrame) -> DataFrame:
    """The rows of one community with its theme."""
    return rows.where(F.col("community") == community).join(themes.select(F.col("community_id").alias("community"), "theme"), "community", "left")
