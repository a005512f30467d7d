"""Heat and flood scores, levels and intervention formulas."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import clip

HEAT_WEIGHT = 0.6
FLOOD_WEIGHT = 0.4
# Combined-score thresholds, from the highest level down.
LEVELS = (("critical", 75.0), ("high", 50.0), ("medium", 25.0))


def combined_risk(heat: Column, flood: Column) -> Column:
    return F.lit(HEAT_WEIGHT) * heat + F.lit(FLOOD_WEIGHT) * flood


def risk_level(combined: Column) -> Column:
    level = F.lit("low")
    for name, threshold in reversed(LEVELS):
        level = F.when(combined >= threshold, F.lit(name)).otherwise(level)
    return level


def layer_score(heat: Column, flood: Column, layer: str) -> Column:
    """Map layer selector, scaled to 0..1."""
    score = {"heat": heat, "flood": flood, "combined": combined_risk(heat, flood)}[layer]
    return clip(score / 100.0, 0.0, 1.0)


def weather_heat_score(temperature: Column, humidity: Column) -> Column:
    t = F.coalesce(temperature, F.lit(30.0))
    h = F.coalesce(humidity, F.lit(50.0))
    base = clip((t - 28.0) / 14.0 * 100.0, 0.0, 100.0)
    penalty = clip((h - 30.0) / 70.0 * 15.0, 0.0, 15.0)
    return F.least(F.lit(100.0), base + penalty)


def weather_flood_score(precipitation: Column, full_scale_mm: float = 20.0) -> Column:
    return clip(F.coalesce(precipitation, F.lit(0.0)) / F.lit(full_scale_mm) * 100.0, 0.0, 100.0)


def snapshot_heat_score(lst: Column, impervious: Column, ndvi: Column) -> Column:
    raw = 0.55 * (lst - 25.0) / 20.0 + 0.30 * (impervious / 100.0) + 0.15 * (1.0 - ndvi)
    return clip(raw * 100.0, 0.0, 100.0)


def snapshot_flood_score(rainfall: Column, impervious: Column, ndvi: Column) -> Column:
    rain = F.least(F.lit(1.0), rainfall / 60.0)
    raw = 0.55 * rain + 0.30 * (impervious / 100.0) + 0.15 * (1.0 - ndvi)
    return clip(raw * 100.0, 0.0, 100.0)


def uhi_offset(impervious: Column, industrial: Column) -> Column:
    return F.lit(1.5) + impervious / 100.0 * 4.5 + industrial * 2.0


def uhi_surface_temperature(air_temperature: Column, impervious: Column, industrial: Column, ndvi: Column) -> Column:
    return air_temperature + uhi_offset(impervious, industrial) - ndvi * 3.0


def effective_rainfall(day_sum: Column, current: Column) -> Column:
    """Extrapolate a running shower to at least four times its current intensity."""
    return F.when(current > 0, F.greatest(day_sum, current * 4.0)).otherwise(day_sum)


def industrial_weight(row: Column, col: Column) -> Column:
    """Three heat belts on the ward grid: weight, centre row, centre column, spread (fixed values).

    Squares are taken of doubles: those of integers overflow from row 46,348 on.
    """
    belts = ((0.6, 7, 7, 6.0), (0.8, 11, 2, 5.0), (0.7, 1, 11, 5.0))
    total = None
    for weight, r0, c0, spread in belts:
        dr, dc = (row - r0).cast("double"), (col - c0).cast("double")
        term = F.lit(weight) * F.exp(-((dr * dr + dc * dc) / F.lit(spread)))
        total = term if total is None else total + term
    return F.least(F.lit(1.0), total)


def effectiveness(heat_delta: Column, flood_delta: Column, ndvi_delta: Column, lst_delta: Column) -> Column:
    return F.abs(heat_delta) * 0.6 + F.abs(flood_delta) * 0.4 + F.abs(ndvi_delta) * 20.0 + F.abs(lst_delta) * 3.0


def intervention_benefit(heat_delta: Column, flood_delta: Column, heat: Column, flood: Column) -> Column:
    return 0.6 * F.abs(heat_delta) / 100.0 * heat + 0.4 * F.abs(flood_delta) / 100.0 * flood


def expected_heat_reduction(heat_delta: Column, lst_delta: Column) -> Column:
    return F.abs(heat_delta + F.abs(lst_delta) * 2.0)


def expected_flood_reduction(flood_delta: Column) -> Column:
    return F.abs(flood_delta)


def roi(heat_reduction: Column, flood_reduction: Column, cost: Column) -> Column:
    """A missing or zero cost counts as 1."""
    return (heat_reduction + flood_reduction) / F.coalesce(F.nullif(cost, F.lit(0)), F.lit(1))


def diurnal_forecast(heat: Column, hour: Column, noise: Column | None = None) -> Column:
    phase = (F.pmod(hour, F.lit(24)) - 6).cast("double")
    shifted = heat + F.lit(3.0) * F.sin(F.pi() * phase / 12.0)
    return clip(shifted if noise is None else shifted + noise, 0.0, 100.0)


def forecast_confidence(hour: Column) -> Column:
    return F.greatest(F.lit(0.3), F.lit(1.0) - hour * 0.08)


def citizen_severity(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, F.lit("critical")).otherwise(F.lit("high"))


def effective_report_type(report_type: Column, flood_predicted: Column) -> Column:
    override = flood_predicted & ~report_type.isin("flood", "waterlogging")
    return F.when(override, F.lit("flood")).otherwise(report_type)


def metric_passes(value: Column, threshold: Column, higher_is_better: Column) -> Column:
    return F.when(higher_is_better, value > threshold).otherwise(value < threshold)
