"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the smallest node of the component.

    Every round takes the smallest label among the neighbours and then the label of that label, so long chains
    halve. Each round is a written table; only one number per round comes to the driver. No edges: no rows.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = stage(lower.join(jump, "next").select("node", "label", F.least("next", "far").alias("next")))
        if not moved.where("next <> label").limit(1).count():
            return labels
        labels = moved.select("node", F.col("next").alias("label"))
