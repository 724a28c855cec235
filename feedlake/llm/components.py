"""Connected components of a link table, as rounds of joins and aggregates over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str = "labels") -> DataFrame:
    """``(node, label)`` of every node of ``links (a, b)``; the label is the smallest node that can be reached.

    Each round takes the smallest label among a node's neighbours and then follows the label of that label, so that
    chains shorten by doubling. Labels and links stay distributed; a round ends in a stored table and one count.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = scratch.store(both, f"{name}-edges")
    labels = scratch.store(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = (edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        lower = labels.join(near, "node", "left").select("node", F.col("label").alias("old"),
                                                        F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = lower.join(far, "label", "left").select("node", "old", F.least("label", "next").alias("label"))
        new = scratch.store(jumped.select("node", "label", (F.col("label") < F.col("old")).alias("moved")), f"{name}-{step}")
        moved = new.filter("moved").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        labels = new.select("node", "label")
        if not moved:
            scratch.drop(f"{name}-edges")
            return labels
