"""Dimension joins, lookups and row expansion.

No side is force-broadcast here: Spark compares measured sizes with its own threshold (also at run time, under AQE) and
otherwise keeps a shuffle join whose skewed partitions AQE splits. Constant tables are expanded from literals instead of
being joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import fallback_ward_name


def with_ward_names(df: DataFrame, wards: DataFrame) -> DataFrame:
    """LEFT join to the ward table with a "Ward-<id>" fallback name."""
    named = df.join(wards.select("ward_id", "ward_name"), "ward_id", "left")
    return named.withColumn("ward_name", fallback_ward_name(F.col("ward_name"), F.col("ward_id")))


def join_wards(df: DataFrame, wards: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """INNER join USING (ward_id)."""
    return df.join(wards.select("ward_id", *(columns or ["ward_name"])), "ward_id")


def fill_lookup(df: DataFrame, table: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """LEFT lookup of the default's columns; a missing key or null value takes the default."""
    found = table.select(key, *[F.col(c).alias(f"_{c}") for c in defaults])
    out = df.join(found, key, "left")
    for name, default in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(f"_{name}"), F.lit(default))).drop(f"_{name}")
    return out


# Static ward features assumed for a ward without a snapshot row.
STATIC_DEFAULTS = {
    "ndvi": 0.30,
    "impervious_pct": 55.0,
    "industrial_weight": 0.2,
    "pm25_ugm3": 45.0,
    "population_density": 14000.0,
}


def with_static_features(df: DataFrame, snapshot: DataFrame) -> DataFrame:
    return fill_lookup(df, snapshot, "ward_id", STATIC_DEFAULTS)


def weather_with_scores(latest_weather: DataFrame, scores: DataFrame) -> DataFrame:
    """Latest weather LEFT JOIN stored scores, with fills for wards that have no score row."""
    joined = latest_weather.join(
        scores.select("ward_id", "lst_pred_celsius", "ndvi", "impervious_pct"), "ward_id", "left"
    )
    return (
        joined.withColumn("lst_pred_celsius", F.coalesce("lst_pred_celsius", "temperature_c"))
        .withColumn("ndvi", F.coalesce("ndvi", F.lit(0.3)))
        .withColumn("impervious_pct", F.coalesce("impervious_pct", F.lit(40.0)))
        .withColumn("pm25", F.lit(35.0))
    )


def attach_weather(predictions: DataFrame, weather: DataFrame) -> DataFrame:
    columns = ["ward_id", "temperature_c", "rainfall_mm_24h", "humidity_pct"]
    return predictions.join(weather.select(*columns), "ward_id", "left")


def expand_literals(df: DataFrame, rows: list[dict[str, object]], types: dict[str, str]) -> DataFrame:
    """Every row of ``df`` with every one of a few constant rows."""
    structs = [F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in types.items()]) for r in rows]
    return df.withColumn("_each", F.explode(F.array(*structs))).select(*df.columns, "_each.*")


def expand_hours(df: DataFrame, horizon: int) -> DataFrame:
    return df.withColumn("hour", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def first_per_key(df: DataFrame, key: str, rank: str) -> DataFrame:
    """The row with the smallest rank per key; combines map-side, so a hot key costs nothing extra."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), rank).alias("r")).select("r.*")


def in_top(df: DataFrame, ranked: DataFrame, column: str, n: int, key: str = "ward_id") -> DataFrame:
    """Semi join to the n highest rows of another table."""
    top = ranked.orderBy(F.col(column).desc(), F.col(key)).limit(n).select(key)
    return df.join(top, key, "left_semi")


def compare_versions(versions: DataFrame, run_metrics: DataFrame, metric: str) -> DataFrame:
    """Registered versions with their run's metric, "N/A" when the run has none, in version order."""
    values = run_metrics.filter(F.col("metric_name") == metric).select("run_id", "metric_value")
    shown = F.when(F.col("metric_value").isNotNull(), F.format_string("%.4f", F.col("metric_value"))).otherwise("N/A")
    return (
        versions.join(values, "run_id", "left")
        .select(F.col("version").cast("int").alias("version"), "stage", F.substring("run_id", 1, 8).alias("run"),
                shown.alias("metric"))
        .orderBy("version")
    )
