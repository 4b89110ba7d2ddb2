"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of the component, for all nodes of edges(a, b). Nothing is collected.

    Each round takes the smallest label among a node's neighbours and then the label's label, so long chains halve.
    Labels are written to the shared folder after each round.
    """
    both = stored(edges.select("a", "b").where("a <> b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("over"))
        after = least.join(jump, least["label"] == jump["at"], "left").select("node", "old", F.coalesce(F.least("label", "over"), "label").alias("label"))
        made = stored(after, "labels")
        forget(labels)
        changed = made.where("label <> old").limit(1).count()
        labels = made.select("node", "label")
        labels._stored_at = made._stored_at
        if not changed:
            forget(both)
            return labels
