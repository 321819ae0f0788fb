"""Community flow over a stream of citations, an extension of the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(citations: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, sender_community, target_community, n) in each window of event time ``ts``; later rows than ``late`` are left out."""
    rows = citations.withWatermark("ts", late).groupBy(F.window("ts", window), "sender_community", "target_community").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "sender_community", "target_community", "n")
