"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.llm import langid, nearcopies, packing, pii, toxicity
from citeflow.llm.common import fresh, stored, table

#: A document goes if the posterior of none of the languages learnt is over this.
MOST_UNKNOWN = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; null and empty texts stay."""
    score = fresh(docs, "toxicity")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), score)
    return found.where(F.col(score) < 0.5).select(docs.columns)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is likelier in one of the languages learnt than in none; texts without a letter go."""
    lang, _, none = names = fresh(docs, "lang"), fresh(docs, "posterior"), fresh(docs, "none")
    found = langid.identify(docs, langid.fit(docs), names)
    return found.where((F.col(lang) != "und") & (F.col(none) <= MOST_UNKNOWN)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id, then text.

    The groups are op8's, within 4 of 64 bits, joined with the pairs of five-word Jaccard similarity 0.8 or more.
    """
    return nearcopies.one_of_each(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal values replaced by pseudonyms of the same format."""
    return pii.pseudonymise(docs, pii.key_of(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document, with its place in a sequence of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("language", drop_unidentified), ("near-dedup", drop_near_copies), ("pseudonyms", pseudonymise), ("packing", pack)]

#: SQL can't express the learnt models or the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
