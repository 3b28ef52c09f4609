"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (smallest node reachable) of every node of (a, b).

    Each round gives a node the least label of its neighbours and then the label of its label,
    so paths shorten by a factor a round; neighbours' labels are aggregated map-side."""
    pairs = scratch.write(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = scratch.write(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = pairs.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        moved = scratch.write(lower.join(step, "label", "left").select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label")))
        changed = moved.where("label <> old").limit(1).count()
        scratch.drop(labels)
        labels = moved.select("node", "label")
        if not changed:
            scratch.drop(pairs)
            return labels
