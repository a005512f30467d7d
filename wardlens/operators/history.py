"""Snapshot histories: indexing, normalisation, sliding samples, padding, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import clip, clip_norm, log_norm
from ..session import cut_lineage
from .running import forward_fill, ordinal, with_halo

# The twelve model features, in order, and the two targets.
FEATURES = (
    "ndvi", "ndbi", "impervious_norm", "lst_norm", "rainfall_log", "pm25_log", "pop_log", "area_norm",
    "industrial_weight", "lon_norm", "lat_norm", "heat_proxy",
)
TARGETS = ("heat_stress_score", "flood_risk_score")
WINDOW = 8


def with_snapshot_index(history: DataFrame, ts: str = "snapshot_ts", name: str = "snapshot_idx") -> DataFrame:
    """Position of each row's timestamp among the distinct timestamps.

    Only the distinct timestamps are ordered, in blocks of a day, so even a fine-grained history never meets in one
    task. The index is stored; whether it is broadcast is left to the planner and its measured size.
    """
    if name in history.columns:
        return history
    stamps = history.select(ts).distinct()
    indexed = ordinal(stamps, [], [ts], F.date_trunc("day", F.col(ts)), name)
    return history.join(cut_lineage(indexed), ts)


def normalise_snapshot(df: DataFrame) -> DataFrame:
    """Add the normalised model features; absent inputs take their defaults, decided from the frame's columns."""
    have = set(df.columns)
    lst = clip_norm(F.col("lst_celsius"), 20, 50)
    rain = log_norm(F.col("rainfall_mm_24h"))

    def position(given: str, source: str, low: float, high: float) -> Column:
        if given in have:
            return F.col(given)
        return clip_norm(F.col(source), low, high) if source in have else F.lit(0.5)

    derived = {
        "impervious_norm": clip_norm(F.col("impervious_pct"), 0, 100),
        "lst_norm": lst,
        "rainfall_log": rain,
        "pm25_log": log_norm(F.col("pm25_ugm3")),
        "pop_log": log_norm(F.col("population_density"), scale=12.0),
        "area_norm": F.col("area_norm") if "area_norm" in have else F.lit(0.5),
        "industrial_weight": F.col("industrial_weight") if "industrial_weight" in have else F.lit(0.0),
        "lon_norm": position("lon_norm", "centroid_lon", 77.45, 77.78),
        "lat_norm": position("lat_norm", "centroid_lat", 12.83, 13.14),
        "heat_proxy": F.col("heat_proxy") if "heat_proxy" in have else lst,
        "ndvi": F.col("ndvi") if "ndvi" in have else F.lit(0.0),
        "ndbi": F.col("ndbi") if "ndbi" in have else F.lit(0.0),
        "heat_stress_score": F.col("heat_stress_score") if "heat_stress_score" in have else clip(lst * 100.0, 0, 100),
        "flood_risk_score": F.col("flood_risk_score") if "flood_risk_score" in have else clip(rain * 30.0, 0, 100),
    }
    kept = [c for c in df.columns if c not in derived]
    return df.select(*kept, *[c.alias(name) for name, c in derived.items()])


def ward_channels(df: DataFrame, key: str = "ward_id") -> DataFrame:
    """Seven image-channel values per ward, with defaults for absent columns and nulls."""
    have = set(df.columns)

    def value(name: str, default: float) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in have else F.lit(default)

    channels = F.array(
        clip_norm(value("ndvi", 0.3), -1.0, 1.0, clip_first=False),
        clip_norm(value("ndbi", 0.0), -1.0, 1.0, clip_first=False),
        clip_norm(value("impervious_pct", 50.0), 0.0, 100.0, clip_first=False),
        log_norm(value("rainfall_mm_24h", 0.0)),
        log_norm(value("pm25_ugm3", 40.0)),
        log_norm(value("population_density", 5000.0), scale=12.0),
        clip_norm(value("lst_celsius", 34.0), 20.0, 50.0, clip_first=False),
    )
    return df.select(key, channels.alias("channels"))


def densify(history: DataFrame, values: list[str], mode: str = "zero") -> DataFrame:
    """One row for every ward and snapshot. Gaps hold zeros, or the ward's last earlier values (mode "ffill").

    The grid is the size of the answer, which holds every (ward, snapshot) by definition. Wards meet snapshots through
    the snapshot list of a single row, not through a join of all pairs.
    """
    last = history.agg(F.max("snapshot_idx")).scalar()
    grid = history.select("ward_id").distinct().withColumn(
        "snapshot_idx", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))
    )
    full = grid.join(history.select("ward_id", "snapshot_idx", *values), ["ward_id", "snapshot_idx"], "left")
    if mode == "ffill":
        full = forward_fill(full, "ward_id", "snapshot_idx", values)
    return full.select("ward_id", "snapshot_idx", *[F.coalesce(F.col(v), F.lit(0.0)).alias(v) for v in values])


def sliding_samples(
    history: DataFrame, features: list[str], targets: list[str], window: int = WINDOW, block: int = 4096
) -> DataFrame:
    """Sample t of a ward: features of the ``window`` previous snapshots (oldest first) and the targets at t.

    Needs a dense snapshot_idx per ward. Blocks of snapshots with a copied tail make the windows, so a long history of
    one ward is many tasks.
    """
    spread = with_halo(history, "snapshot_idx", window, block)
    past = Window.partitionBy("ward_id", "_block").orderBy("snapshot_idx").rowsBetween(-window, -1)
    vector = F.array(*[F.col(f).cast("double") for f in features])
    samples = spread.withColumn("x_seq", F.collect_list(vector).over(past))
    return samples.filter(F.col("_own") & (F.size("x_seq") == window)).select(
        "ward_id", "snapshot_idx", "x_seq", *targets
    )


def padded_latest(history: DataFrame, features: list[str], window: int = WINDOW) -> DataFrame:
    """Per ward the last ``window`` snapshots of the whole table as one sequence.

    A snapshot the ward lacks is a zero vector, and so is the left padding when fewer snapshots exist.
    """
    first = F.greatest(history.agg(F.max("snapshot_idx")).scalar() - (window - 1), F.lit(0))
    recent = history.filter(F.col("snapshot_idx") >= first)
    offset = history.agg(F.max("snapshot_idx")).scalar() - F.col("snapshot_idx")
    slots = recent.groupBy("ward_id").agg(F.map_from_entries(F.collect_list(F.struct(
        (F.lit(window - 1) - offset).cast("int").alias("slot"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
    ))).alias("slots"))
    wards = history.select("ward_id").distinct()
    zeros = F.array(*[F.lit(0.0) for _ in features])
    sequence = F.transform(
        F.sequence(F.lit(0), F.lit(window - 1)), lambda i: F.coalesce(F.try_element_at(F.col("slots"), i), zeros)
    )
    return wards.join(slots, "ward_id", "left").select("ward_id", sequence.alias("x_seq"))


def replicated_snapshot(snapshot: DataFrame, features: list[str], window: int = WINDOW) -> DataFrame:
    vector = F.array(*[F.col(f).cast("double") for f in features])
    return snapshot.select("ward_id", F.array_repeat(vector, window).alias("x_seq"))


def chronological_split(
    samples: DataFrame, fraction: float = 0.2, name: str = "split", positions: DataFrame | None = None
) -> DataFrame:
    """Last max(1, int(fraction * n)) of the n distinct snapshot positions are validation.

    ``positions`` may give the samples' snapshot_idx values from a cheaper source than the samples themselves.
    """
    source = samples if positions is None else positions
    bounds = source.select("snapshot_idx").distinct().agg(F.struct(F.count(F.lit(1)).alias("n"), F.max("snapshot_idx").alias("last"))).scalar()
    held = F.greatest(F.lit(1), F.floor(F.col("_b.n") * fraction))
    return (
        samples.withColumn("_b", bounds)
        .withColumn(name, F.when(F.col("snapshot_idx") > F.col("_b.last") - held, "validation").otherwise("train"))
        .drop("_b")
    )


def top_features(
    importance: DataFrame, names: list[str], k: int = 4, heat: str = "heat_importance", flood: str = "flood_importance"
) -> DataFrame:
    """Per ward the k largest shares of combined importance (0.6 heat + 0.4 flood); the earlier feature wins a tie.

    ``heat`` and ``flood`` are arrays parallel to ``names``.
    """
    combined = F.zip_with(heat, flood, lambda h, f: F.lit(0.6) * h.cast("double") + F.lit(0.4) * f.cast("double"))
    labels = F.array(*[F.lit(n) for n in names])
    total = F.aggregate("_c", F.lit(0.0), lambda s, x: s + x) + 1e-12
    ranked = F.array_sort(F.transform("_c", lambda x, i: F.struct(
        (-(x / F.col("_t"))).alias("o"), i.alias("i"), F.get(labels, i).alias("feature"),
        (x / F.col("_t")).alias("importance"))))
    top = F.transform(F.slice(ranked, 1, k), lambda s: F.struct(s["feature"].alias("feature"),
                                                                s["importance"].alias("importance")))
    return importance.withColumn("_c", combined).withColumn("_t", total).select(
        "ward_id", top.alias("top_contributing_features")
    )


def global_importance(
    importance: DataFrame, names: list[str], heat: str = "heat_importance", flood: str = "flood_importance"
) -> DataFrame:
    """Share of each feature in the total combined importance, largest first."""
    row = importance.agg(*[
        F.sum(F.lit(0.6) * F.get(heat, F.lit(i)).cast("double") + F.lit(0.4) * F.get(flood, F.lit(i)).cast("double"))
        .alias(f"_{i}")
        for i in range(len(names))
    ])
    total = sum((F.col(f"_{i}") for i in range(1, len(names))), F.col("_0")) + 1e-12
    entries = F.array(*[
        F.struct(F.lit(n).alias("feature"), (F.col(f"_{i}") / total).alias("importance")) for i, n in enumerate(names)
    ])
    return row.select(F.explode(entries).alias("e")).select("e.*").orderBy(F.col("importance").desc(), "feature")
