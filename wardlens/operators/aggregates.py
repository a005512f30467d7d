"""Grouped aggregates. All of them combine map-side, so a hot ward or window only adds rows to local partials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import clip, l2_norm
from ..functions.risk import FLOOD_WEIGHT, HEAT_WEIGHT

TEMPERATURE_ANOMALY_C = 40.0
RAIN_ANOMALY_MM = 20.0


def window_measures() -> list[Column]:
    """Measures of a ward window; the anomaly flag looks at the unrounded values."""
    temperature, rain = F.avg("temperature_c"), F.sum("rainfall_mm")
    anomaly = (temperature > TEMPERATURE_ANOMALY_C) | (rain > RAIN_ANOMALY_MM)
    return [
        temperature.alias("avg_temperature_c"),
        F.avg("humidity_pct").alias("avg_humidity_pct"),
        F.avg("pm25").alias("avg_pm25"),
        rain.alias("sum_rainfall_mm"),
        F.count(F.lit(1)).alias("reading_count"),
        anomaly.cast("int").alias("has_anomaly"),
    ]


def ward_windows(readings: DataFrame, minutes: int = 15) -> DataFrame:
    """Tumbling event-time windows per ward; the same expression serves batch and streaming."""
    grouped = readings.groupBy("ward_id", F.window("ts", f"{minutes} minutes")).agg(*window_measures())
    rest = [c for c in grouped.columns if c not in ("ward_id", "window")]
    return grouped.select(
        "ward_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest
    )


def rounded_windows(windows: DataFrame) -> DataFrame:
    return windows.select(
        "ward_id", "window_start", "window_end",
        F.round("avg_temperature_c", 2).alias("avg_temperature_c"),
        F.round("avg_humidity_pct", 2).alias("avg_humidity_pct"),
        F.round("avg_pm25", 2).alias("avg_pm25"),
        F.round("sum_rainfall_mm", 3).alias("sum_rainfall_mm"),
        "reading_count", "has_anomaly",
    )


def anomalies(windows: DataFrame) -> DataFrame:
    return windows.filter(F.col("has_anomaly") == 1)


def reports_by_type(reports: DataFrame) -> DataFrame:
    return (
        reports.groupBy("report_type")
        .agg(F.count(F.lit(1)).alias("report_count"), F.avg("severity").alias("avg_severity"),
             F.max("reported_at").alias("latest_at"))
        .orderBy(F.col("report_count").desc(), "report_type")
    )


def reports_per_ward_and_type(reports: DataFrame) -> DataFrame:
    """The per-ward listing for all wards at once."""
    return reports.groupBy("ward_id", "report_type").agg(
        F.count(F.lit(1)).alias("report_count"), F.avg("severity").alias("avg_severity"),
        F.max("reported_at").alias("latest_at")
    )


def risk_kpis(scores: DataFrame) -> DataFrame:
    """Every headline number of the dashboards in one scan."""
    return scores.agg(
        F.count(F.lit(1)).alias("wards"),
        F.count_if(F.col("risk_level") == "critical").alias("critical_wards"),
        F.count_if(F.col("risk_level") == "high").alias("high_wards"),
        F.avg("heat_stress_score").alias("avg_heat_stress"),
        F.avg("flood_risk_score").alias("avg_flood_risk"),
        F.avg("lst_pred_celsius").alias("avg_lst"),
        F.max("updated_at").alias("latest_update"),
    )


def count_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), column)


def counts_since(df: DataFrame, column: str, start: Column, name: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column) >= start).alias(name))


def risk_over_time(scores: DataFrame) -> DataFrame:
    return (
        scores.groupBy("updated_at")
        .agg(F.count_if(F.col("risk_level") == "critical").alias("critical_wards"),
             F.avg("heat_stress_score").alias("avg_heat_stress"),
             F.avg("flood_risk_score").alias("avg_flood_risk"),
             F.avg("lst_pred_celsius").alias("avg_lst"))
        .orderBy("updated_at")
    )


def active_sensors(readings: DataFrame, start: Column, approximate: bool = False) -> DataFrame:
    recent = readings.filter(F.col("ts") > start)
    count = F.approx_count_distinct("sensor_id") if approximate else F.count_distinct("sensor_id")
    return recent.agg(count.alias("active_sensors"))


def top_average(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    averaged = df.groupBy(key).agg(F.avg(value).alias(f"avg_{value}"))
    return averaged.orderBy(F.col(f"avg_{value}").desc(), key).limit(n)


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    start = (F.floor(F.col(column) / width) * width).cast("double").alias("bin_start")
    return df.filter(F.col(column).isNotNull()).groupBy(start).agg(F.count(F.lit(1)).alias("n")).orderBy("bin_start")


def summary_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """min/mean/max per column, long form, from one aggregate row."""
    row = df.agg(*[
        F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("min"), F.avg(c).alias("mean"),
                 F.max(c).cast("double").alias("max")).alias(c)
        for c in columns
    ])
    return row.select(F.explode(F.array(*columns)).alias("s")).select("s.*")


def band_stats(pixels: DataFrame, columns: list[str]) -> DataFrame:
    """Population mean/std/min/max per column, long form."""
    row = pixels.agg(*[
        F.struct(F.lit(c).alias("band"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"),
                 F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c)
        for c in columns
    ])
    return row.select(F.explode(F.array(*columns)).alias("s")).select("s.*")


def city_score(wards: DataFrame, by: list[str] | None = None) -> DataFrame:
    """City stress score and the bonus for averages below 50 (heat) and 40 (flood)."""
    heat, flood = F.avg("heat_stress_score"), F.avg("flood_risk_score")
    score = HEAT_WEIGHT * heat + FLOOD_WEIGHT * flood
    bonus = HEAT_WEIGHT * F.greatest(F.lit(0.0), 50.0 - heat) * 0.1 + FLOOD_WEIGHT * F.greatest(
        F.lit(0.0), 40.0 - flood) * 0.1
    return wards.groupBy(*(by or [])).agg(score.alias("city_score"), bonus.alias("improvement_bonus"))


def budget_use(recommendations: DataFrame, budget: int) -> DataFrame:
    spent = F.coalesce(F.sum("cost"), F.lit(0))
    return recommendations.agg(spent.alias("budget_used"), (F.lit(budget) - spent).alias("budget_remaining"))


def weather_cache_summary(ward_weather: DataFrame) -> DataFrame:
    wettest = F.max_by(F.col("ward_name"), F.struct(F.col("rainfall_mm"), -F.col("ward_id")))
    return ward_weather.agg(
        F.count(F.lit(1)).alias("wards"), F.avg("temperature_c").alias("avg_temperature_c"),
        F.avg("rainfall_mm").alias("avg_rainfall_mm"), F.max("rainfall_mm").alias("max_rainfall_mm"),
        wettest.alias("wettest_ward"),
    )


def training_log_by_steps(log: DataFrame, step: str, reward: str, bucket: int = 10_000) -> DataFrame:
    return log.groupBy((F.floor(F.col(step) / bucket) * bucket).alias("step_bucket")).agg(
        F.avg(reward).alias("avg_reward"), F.count(F.lit(1)).alias("steps")
    )


def action_diversity(log: DataFrame, episode: str, action: list[str]) -> DataFrame:
    """Distinct (ward, action) pairs per episode; deduplicated on the full key first, so no episode is one hot group."""
    return log.select(episode, *action).distinct().groupBy(episode).agg(F.count(F.lit(1)).alias("distinct_actions"))


def mean_norm(vectors: DataFrame, column: str) -> DataFrame:
    return vectors.agg(F.avg(l2_norm(F.col(column))).alias("mean_norm"), F.count(F.lit(1)).alias("vectors"))


def ward_coverage(rows: DataFrame, ward_count: int) -> DataFrame:
    return rows.groupBy("scene_date").agg(
        F.count_distinct("ward_id").alias("wards"),
        (F.count_distinct("ward_id") >= ward_count).alias("complete"),
    )


def feedback_bias(feedback: DataFrame, as_of: Column) -> DataFrame:
    """Classifier bias from confirmed and fake reports; entries of the last three days count double.

    Age is in whole days, rounded down; an entry without a date counts as 30 days old.
    """
    age = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("flagged_at").cast("timestamp")))
                  / F.lit(86_400_000_000))
    weight = F.when(F.coalesce(age, F.lit(30)) < 3, 2.0).otherwise(1.0)
    fake = F.coalesce(F.sum(F.when(F.col("label") == "fake", weight)), F.lit(0.0))
    real = F.coalesce(F.sum(F.when(F.col("label") == "real", weight)), F.lit(0.0))
    return feedback.agg(
        clip(real * 0.01 - fake * 0.03, -0.25, 0.15).alias("bias"),
        F.count_if(F.col("label") == "fake").alias("fake_count"),
        F.count_if(F.col("label") == "real").alias("real_count"),
    )


def drift_level(psi: Column) -> Column:
    return F.when(psi > 0.2, "CRITICAL").when(psi > 0.1, "WARN").otherwise("OK")


def drift_alert_counts(drift: DataFrame) -> DataFrame:
    severity = F.when(F.col("psi") > 0.2, "critical").when(F.col("psi") > 0.1, "warning")
    return (
        drift.withColumn("severity", severity).filter(F.col("severity").isNotNull())
        .groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"))
    )
