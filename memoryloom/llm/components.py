"""Connected components by least labels with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every end of an edge (a, b) the least node that can be reached from it.

    Each round takes the least label among the neighbours and then the label of the label, so chains shrink by half;
    hot nodes are pre-aggregated or split by adaptive execution. Labels are staged after each round.
    """
    both = stage(edges.select(F.col("a").alias("node"), F.col("b").alias("peer")).union(edges.select("b", "a")).filter("node <> peer").distinct(), "links")
    labels = stage(both.groupBy("node").agg(F.min("peer").alias("_m")).select("node", F.least("node", "_m").alias("component")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "peer"), "peer").groupBy("node").agg(F.min("component").alias("_m"))
        lower = labels.join(heard, "node").select("node", F.least("component", "_m").alias("component"), F.col("component").alias("_was"))
        lower = stage(lower, "labels")
        top = lower.select(F.col("node").alias("component"), F.col("component").alias("_top"))
        new = stage(lower.join(top, "component").select("node", F.col("_top").alias("component"), "_was"), "labels")
        changed = new.filter("component <> _was").limit(1).count()
        drop(labels, lower)
        labels = new
        if not changed:
            drop(both)
            return labels.select("node", "component")
