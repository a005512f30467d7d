"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): smallest node reachable, for every node that has a link.

    Each round lowers a node's label to the least label of its neighbours and then follows the label once (pointer
    jumping), so chains shrink by halves. Minima are combined before the shuffle; joins on a busy node are left to the
    skew-join rule. No link table or component reaches the driver, only the number of changed nodes. An empty table
    gives an empty one.
    """
    edges = links.select(F.col(a).alias("_u"), F.col(b).alias("_v")).filter("_u is not null and _v is not null")
    both = stored(edges.union(edges.select("_v", "_u")).distinct(), "links")
    labels = stored(
        both.groupBy("_u").agg(F.min("_v").alias("_m"))
        .select(F.col("_u").alias("node"), F.least("_u", "_m").alias("component")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("_v"), F.col("component").alias("_c")), "_v")
            .groupBy("_u").agg(F.min("_c").alias("_near"))
        )
        lowered = stored(
            labels.join(near, labels["node"] == near["_u"])
            .select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("_new")), "lowered")
        step = stored(
            lowered.join(lowered.select(F.col("node").alias("_new"), F.col("_new").alias("_far")), "_new", "left")
            .select("node", "_old", F.least("_new", F.coalesce("_far", "_new")).alias("component")), "labels")
        labels = step.select("node", "component")
        if step.filter("component <> _old").isEmpty():
            return labels
