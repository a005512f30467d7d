"""Scores, alerts, forecasts, priorities and tiered source resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import risk
from ..functions.text import score_message
from ..operators.filters import at_least, equals_if, only_ids
from ..operators.joins import expand_hours
from ..operators.ranking import latest_per_key, listing, ranked_top
from ..operators.sets import fired_rules
from ..operators.tables import merge_columns


def combined() -> Column:
    return risk.combined_risk(F.col("heat_stress_score"), F.col("flood_risk_score"))


def weather_scores(readings: DataFrame) -> DataFrame:
    """Heat, flood and level per reading; the temperature stands in for the surface temperature."""
    scored = readings.select(
        "ward_id",
        risk.weather_heat_score(F.col("temperature_2m"), F.col("humidity_pct")).alias("heat_stress_score"),
        risk.weather_flood_score(F.col("precipitation_mm")).alias("flood_risk_score"),
        F.coalesce("temperature_2m", F.lit(30.0)).alias("lst_pred_celsius"),
    )
    return scored.withColumn("risk_level", risk.risk_level(combined()))


def refresh_scores(scores: DataFrame, readings: DataFrame, as_of: Column, order: list[str]) -> DataFrame:
    """Partial upsert of the latest reading per ward; columns the refresh does not know (ndvi, ...) survive."""
    latest = weather_scores(latest_per_key(readings, ["ward_id"], order)).withColumn("updated_at", as_of)
    columns = ["heat_stress_score", "flood_risk_score", "risk_level", "lst_pred_celsius", "updated_at"]
    return merge_columns(scores, latest, "ward_id", columns, check=False)


def _rule(score: str, name: Column, kind: str, tiers: tuple[tuple[float, str, str], ...]) -> Column:
    alert = F.lit(None)
    for threshold, severity, prefix in reversed(tiers):
        entry = F.struct(
            F.lit(kind).alias("alert_type"), F.lit(severity).alias("severity"),
            score_message(prefix, name, F.col(score)).alias("message"),
            F.col(score).alias("value"), F.lit(threshold).alias("threshold"),
        )
        alert = F.when(F.col(score) >= threshold, entry).otherwise(alert)
    return alert


# Thresholds, severities and message starts, strictest first.
HEAT_TIERS = ((75.0, "critical", "Extreme heat stress"), (60.0, "high", "High heat stress"))
FLOOD_TIERS = ((70.0, "critical", "Flood risk critical"), (50.0, "high", "Elevated flood risk"))


def threshold_alerts(risks: DataFrame, as_of: Column) -> DataFrame:
    """Up to one heat and one flood alert per ward, from one scan."""
    name = F.coalesce(F.col("ward_name"), F.concat(F.lit("Ward-"), F.col("ward_id").cast("string")))
    rules = [_rule("heat_stress_score", name, "heat_wave", HEAT_TIERS),
             _rule("flood_risk_score", name, "flood_warning", FLOOD_TIERS)]
    return fired_rules(risks, rules).select("ward_id", "alert.*", as_of.alias("timestamp"))


def hourly_forecast(risks: DataFrame, horizon: int = 6, noise_seed: int | None = None) -> DataFrame:
    """Diurnal forecast per ward and hour; noise (heat sd 2, flood sd 3) only with a seed."""
    heat_noise = None if noise_seed is None else F.randn(noise_seed) * 2.0
    flood = F.col("flood_risk_score")
    if noise_seed is not None:
        flood = risk.clip(flood + F.randn(noise_seed + 1) * 3.0, 0.0, 100.0)
    rows = expand_hours(risks.select("ward_id", "heat_stress_score", "flood_risk_score"), horizon)
    return rows.select(
        "ward_id", "hour",
        risk.diurnal_forecast(F.col("heat_stress_score"), F.col("hour"), heat_noise).alias("heat_stress_predicted"),
        risk.clip(flood, 0.0, 100.0).alias("flood_risk_predicted"),
        risk.forecast_confidence(F.col("hour")).alias("confidence"),
    )


def priority_wards(risks: DataFrame, limit: int = 20, min_heat_score: float = 0.0) -> DataFrame:
    kept = at_least(risks, "heat_stress_score", min_heat_score).withColumn("composite_risk", combined())
    return ranked_top(kept, F.col("composite_risk"), limit)


def critical_wards(risks: DataFrame) -> DataFrame:
    return risks.filter(F.col("risk_level") == "critical").withColumn("combined_risk", combined()).orderBy(
        F.col("combined_risk").desc(), "ward_id")


def ward_listing(
    risks: DataFrame, risk_level: str | None = None, sort_by: str | None = "heat_stress_score", limit: int = 198
) -> DataFrame:
    return listing(equals_if(risks, "risk_level", risk_level), sort_by, limit)


def freshness(risks: DataFrame) -> DataFrame:
    """Where the listing comes from: stored rows if any has a timestamp, else the tag of the lowest ward."""
    columns = set(risks.columns)
    stored = F.coalesce(F.max(F.col("updated_at").isNotNull()), F.lit(False)) if "updated_at" in columns else F.lit(False)
    tag = F.min_by("data_source", "ward_id") if "data_source" in columns else F.lit(None).cast("string")
    source = F.when(stored, F.lit("postgresql_live")).otherwise(F.coalesce(tag, F.lit("model_generated")))
    return risks.agg(source.alias("source"), F.count(F.lit(1)).alias("total"))


def resolve_tiers(tiers: list[tuple[str, DataFrame]], ids: list[int] | DataFrame | None = None) -> DataFrame:
    """The first non-empty tier as a whole, tagged ``data_source``.

    One row per tier tells inside the plan whether it has any; the losing tiers are filtered out by that constant.
    """
    tagged = [
        only_ids(df, ids).withColumn("data_source", F.lit(name)).withColumn("_tier", F.lit(i))
        for i, (name, df) in enumerate(tiers)
    ]
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    present = reduce(lambda a, b: a.unionByName(b), [df.select("_tier").limit(1) for df in tagged])
    winner = present.agg(F.min("_tier")).scalar()
    return everything.filter(F.col("_tier") == winner).drop("_tier")
