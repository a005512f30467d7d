"""Dashboard queries over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import critical_label
from ..operators.filters import metric_filter, since
from ..operators.joins import in_top, join_wards
from ..operators.ranking import largest, most_recent
from ..operators.running import running_sum_by_time
from .risk import combined


def top_wards(scores: DataFrame, wards: DataFrame, n: int, by: str = "heat_stress_score") -> DataFrame:
    """The n highest wards with names; the limit comes before the join."""
    ranked = scores.withColumn("combined_risk", combined())
    return largest(ranked, by, n).join(wards.select("ward_id", "ward_name"), "ward_id", "left").orderBy(
        F.col(by).desc(), "ward_id")


def all_risk_scores(scores: DataFrame, wards: DataFrame) -> DataFrame:
    return join_wards(scores, wards, ["ward_name", "centroid_lat", "centroid_lon"]).orderBy(
        F.col("heat_stress_score").desc(), "ward_id")


def critical_annotations(scores: DataFrame, wards: DataFrame, as_of: Column, interval: str = "1 hour") -> DataFrame:
    recent = scores.filter((F.col("risk_level") == "critical") & since("created_at", as_of, interval, False))
    return join_wards(recent, wards).select(
        F.col("created_at").alias("time"), critical_label(F.col("ward_name")).alias("text"),
        F.col("risk_level").alias("tags"), "ward_id").orderBy("time", "ward_id")


def hot_ward_sensors(readings: DataFrame, scores: DataFrame, start: Column, n: int = 5) -> DataFrame:
    """Sensor series of the n hottest wards."""
    return in_top(readings.filter(F.col("ts") > start), scores, "heat_stress_score", n)


def running_rainfall(readings: DataFrame, wards: DataFrame, start: Column) -> DataFrame:
    recent = readings.filter(F.col("ts") > start)
    summed = running_sum_by_time(recent, "ward_id", "ts", "rainfall_mm", "value", block="hour")
    return join_wards(summed, wards)


def recent_interventions(log: DataFrame, wards: DataFrame, as_of: Column, n: int = 20, interval: str = "1 hour"):
    recent = most_recent(log.filter(since("created_at", as_of, interval, False)), "created_at", n)
    return join_wards(recent, wards)


def training_curves(metrics: DataFrame, prefix: str, names: list[str], start: Column | None = None) -> DataFrame:
    chosen = metric_filter(metrics, prefix, names)
    return chosen if start is None else chosen.filter(F.col("logged_at") > start)


def recent_reports(reports: DataFrame, wards: DataFrame, n: int = 20) -> DataFrame:
    return most_recent(reports, "reported_at", n).join(wards.select("ward_id", "ward_name"), "ward_id", "left")


def weather_series(readings: DataFrame, start: Column) -> DataFrame:
    return readings.filter(F.col("ts") > start).select(
        F.col("ts").alias("time"), F.col("temperature_2m").alias("value"),
        F.col("ward_id").cast("string").alias("metric"))
