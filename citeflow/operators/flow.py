"""What the communities of one era take over from those of the era before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared_targets(edges: DataFrame, era1: int, era2: int, order: list[str]) -> DataFrame:
    """(target, sender): targets cited in both eras, with the sender that cites them first in the later one.

    One aggregation by target with partial sums does it: no window and no self-join, so a target
    that very many cite is no hot task. ``edges`` has sender, target, era and the order columns.
    """
    rows = edges.where(F.col("era").isin(era1, era2))
    first = F.min(F.when(F.col("era") == era2, F.struct(*order, "sender")))
    found = rows.groupBy("target").agg(first.alias("f"), F.max((F.col("era") == era1).cast("int")).alias("old"))
    return found.where("f IS NOT NULL AND old = 1").select("target", F.col("f.sender").alias("sender"))


def flow(shared: DataFrame, senders: DataFrame, targets: DataFrame) -> DataFrame:
    """(sender_community, target_community, n, proportion): counts of shared targets and their share of the sender community's.

    ``senders`` has sender and sender_community, ``targets`` target and target_community; pairs that
    miss either are dropped.
    """
    counts = shared.join(senders, "sender").join(targets, "target").where("sender_community IS NOT NULL AND target_community IS NOT NULL").groupBy("sender_community", "target_community").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("sender_community"))
    return counts.withColumn("proportion", F.col("n").cast("double") / total.cast("double"))


def network_nodes(flow_: DataFrame) -> DataFrame:
    """(node_id, role, community): sender communities first, then target ones, each by number.

    Communities are few, so they are numbered in one place.
    """
    senders = flow_.select(F.lit("sender").alias("role"), F.col("sender_community").alias("community")).distinct()
    targets = flow_.select(F.lit("target").alias("role"), F.col("target_community").alias("community")).distinct()
    return senders.unionAll(targets).withColumn("node_id", F.row_number().over(Window.orderBy("role", "community")).cast("long")).select("node_id", "role", "community")


def network_edges(flow_: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(sender_id, target_id, n, proportion) between those nodes."""
    nodes = network_nodes(flow_) if nodes is None else nodes
    a = nodes.where("role = 'sender'").select(F.col("node_id").alias("sender_id"), F.col("community").alias("sender_community"))
    b = nodes.where("role = 'target'").select(F.col("node_id").alias("target_id"), F.col("community").alias("target_community"))
    return flow_.join(a, "sender_community").join(b, "target_community").select("sender_id", "target_id", "n", "proportion")


def with_themes(nodes: DataFrame, sender_themes: DataFrame, target_themes: DataFrame) -> DataFrame:
    """Nodes named after their community's theme, of the later era for senders and the earlier for targets; null without one."""
    themes = sender_themes.select(F.lit("sender").alias("role"), F.col("community_id").alias("community"), "theme").unionAll(target_themes.select(F.lit("target").alias("role"), F.col("community_id").alias("community"), "theme"))
    return nodes.join(themes, ["role", "community"], "left")


def roles(nodes: DataFrame, label: str = "label") -> DataFrame:
    """Nodes with 1 for labels that begin with ``sender`` and 2 for others."""
    return nodes.withColumn("role_id", F.when(F.split(F.col(label), "_")[0] == "sender", F.lit(1)).otherwise(F.lit(2)))
