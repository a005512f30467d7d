"""Weighted ward graph and neighbour aggregation over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.geo import planar_km
from ..session import cut_lineage
from .sets import symmetric_edges
from .spatial import nearest_neighbours, pairs_within


def build_edges(nodes: DataFrame, k: int = 6, max_km: float = 3.5, self_loops: bool = False) -> DataFrame:
    """kNN edges and threshold edges in both directions, each once: (src, dst)."""
    knn = nearest_neighbours(nodes, k).select("src", "dst")
    near = pairs_within(nodes, max_km).select("src", "dst")
    loops = nodes.select(F.col("ward_id").cast("long").alias("ward_id")) if self_loops else None
    return symmetric_edges(knn.unionByName(near), loops)


def inverse_distance_weights(edges: DataFrame, nodes: DataFrame, floor_km: float = 0.01) -> DataFrame:
    """1/km with a floor on km; a self loop weighs 1."""
    mean_lat = nodes.agg(F.avg("lat")).scalar()
    a = nodes.select(F.col("ward_id").cast("long").alias("src"), F.col("lon").alias("_o1"), F.col("lat").alias("_a1"))
    b = nodes.select(F.col("ward_id").cast("long").alias("dst"), F.col("lon").alias("_o2"), F.col("lat").alias("_a2"))
    km = planar_km(F.col("_o1"), F.col("_a1"), F.col("_o2"), F.col("_a2"), F.col("_mean"))
    weight = F.when(F.col("src") == F.col("dst"), F.lit(1.0)).otherwise(1.0 / F.greatest(km, F.lit(floor_km)))
    return (
        edges.join(a, "src").join(b, "dst").withColumn("_mean", mean_lat)
        .select("src", "dst", weight.alias("weight"))
    )


def normalise_weights(edges: DataFrame) -> DataFrame:
    """w / sum of w per source. The sums are a map-side combined aggregate, so a hub is not one window partition."""
    totals = edges.groupBy("src").agg(F.sum("weight").alias("_total"))
    return edges.join(totals, "src").select(
        "src", "dst", F.when(F.col("_total") > 0, F.col("weight") / F.col("_total")).otherwise(F.col("weight"))
        .alias("weight")
    )


def ward_graph(nodes: DataFrame, k: int = 6, max_km: float = 3.5, self_loops: bool = False) -> DataFrame:
    """Edges (src, dst, weight): kNN or within max_km, inverse-distance weights summing to 1 per source."""
    edges = build_edges(nodes, k, max_km, self_loops)
    # stored, because the weights are read for the totals and again for the division
    return normalise_weights(cut_lineage(inverse_distance_weights(edges, nodes)))


def degree_stats(edges: DataFrame) -> DataFrame:
    """min/max/mean/median degree; the median is the lower middle value. Works on counts per degree."""
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return degrees.agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("degree").alias("edges"),
        F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"),
        F.avg("degree").alias("mean_degree"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY degree)").cast("bigint").alias("median_degree"),
    )


def neighbour_mean(
    edges: DataFrame, features: DataFrame, values: list[str], keys: list[str] | None = None, residual: bool = False
) -> DataFrame:
    """Weighted mean of the source nodes' features per destination: sum(w * x) / max(1, in-degree).

    ``features`` has ward_id and the values, plus ``keys`` (e.g. the snapshot) when there are several states per ward.
    Nodes without incoming edges get 0. ``residual`` adds the node's own value.
    """
    keys = keys or []
    own = features.select(*keys, F.col("ward_id").cast("long").alias("ward_id"), *values)
    sent = edges.join(own.withColumnRenamed("ward_id", "src"), "src")
    gathered = sent.groupBy(*keys, F.col("dst").alias("ward_id")).agg(*[
        (F.sum(F.col("weight") * F.col(v)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias(f"_{v}") for v in values
    ])
    out = own.join(gathered, [*keys, "ward_id"], "left")
    received = {v: F.coalesce(F.col(f"_{v}"), F.lit(0.0)) for v in values}
    return out.select(
        *keys, "ward_id", *[(received[v] + F.col(v) if residual else received[v]).alias(v) for v in values]
    )


def propagate(
    edges: DataFrame, features: DataFrame, values: list[str], steps: int, keys: list[str] | None = None,
    residual: bool = False,
) -> DataFrame:
    """``steps`` rounds of neighbour_mean. The edges and each round are checkpointed, so the plan does not grow."""
    edges = cut_lineage(edges)
    state = features
    for step in range(steps):
        state = neighbour_mean(edges, state, values, keys, residual)
        if step < steps - 1:
            state = cut_lineage(state)
    return state
