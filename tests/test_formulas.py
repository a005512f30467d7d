"""Hand values of the scalar formulas."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from wardlens.functions import geo, numeric, risk, spectral, text
from wardlens.plans import interventions as iv, wards


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("ndbi", "expected"), [(-1.0, 0.0), (0.0, 50.0), (1.0, 100.0), (1.5, 100.0)])
def test_impervious(spark, ndbi, expected):
    assert value(spark, spectral.impervious_pct(F.lit(ndbi))) == expected


def test_normalized_difference_with_zero_sum(spark):
    assert value(spark, spectral.ndvi(F.lit(0.1), F.lit(-0.1))) == 0.0


@pytest.mark.parametrize(("t", "h", "expected"), [(35.0, 65.0, 57.5), (42.0, 100.0, 100.0), (20.0, 20.0, 0.0)])
def test_weather_heat(spark, t, h, expected):
    assert value(spark, risk.weather_heat_score(F.lit(t), F.lit(h))) == pytest.approx(expected)


def test_weather_scores_of_missing_inputs(spark):
    none = F.lit(None).cast("double")
    assert value(spark, risk.weather_heat_score(none, none)) == pytest.approx(2 / 14 * 100 + 20 / 70 * 15)
    assert value(spark, risk.weather_flood_score(none)) == 0.0
    assert value(spark, risk.weather_flood_score(F.lit(10.0))) == 50.0


@pytest.mark.parametrize(("score", "level"), [
    (75.0, "critical"), (74.99, "high"), (50.0, "high"), (25.0, "medium"), (24.0, "low")])
def test_levels(spark, score, level):
    assert value(spark, risk.risk_level(F.lit(score))) == level


def test_heat_island(spark):
    offset = value(spark, risk.uhi_offset(F.lit(50.0), F.lit(0.2)))
    assert offset == pytest.approx(4.15)
    assert value(spark, risk.uhi_surface_temperature(F.lit(28.0), F.lit(50.0), F.lit(0.2), F.lit(0.3))) == pytest.approx(31.25)


@pytest.mark.parametrize(("current", "expected"), [(1.0, 4.0), (0.0, 2.0)])
def test_effective_rainfall(spark, current, expected):
    assert value(spark, risk.effective_rainfall(F.lit(2.0), F.lit(current))) == expected


def test_intervention_formulas(spark):
    assert value(spark, risk.expected_heat_reduction(F.lit(-6.0), F.lit(-1.5))) == 3.0
    assert value(spark, risk.roi(F.lit(9.0), F.lit(0.0), F.lit(2))) == 4.5
    assert value(spark, risk.roi(F.lit(0.0), F.lit(0.0), F.lit(0))) == 0.0
    tree = iv.catalogue(spark).filter("intervention_type = 'tree_planting'").first()
    assert tree["effectiveness"] == pytest.approx(6 * 0.6 + 0.08 * 20 + 1.5 * 3)


def test_clip_keeps_null(spark):
    assert value(spark, numeric.clip(F.lit(None).cast("double"), 0, 1)) is None
    assert value(spark, numeric.present(F.lit(float("nan")), 2)) is None
    assert value(spark, numeric.numeric_or_zero(F.lit("x1"))) == 0.0


def test_clip_variants_differ_outside_the_range(spark):
    first = value(spark, numeric.clip_norm(F.lit(60.0), 20, 50))
    after = value(spark, numeric.clip_norm(F.lit(60.0), 20, 50, clip_first=False))
    assert first == pytest.approx(30 / (30 + 1e-8)) and after == 1.0


def test_sigmoid_extremes(spark):
    assert value(spark, numeric.sigmoid(F.lit(-1000.0))) == 0.0
    assert value(spark, numeric.sigmoid(F.lit(1000.0))) == 1.0


def test_haversine_quarter_meridian(spark):
    assert value(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))) == pytest.approx(
        6371.0 * math.pi / 2)


def test_ward_names_and_codes(spark):
    assert value(spark, geo.ward_name(F.lit(1))) == "Kempegowda"
    assert value(spark, geo.ward_name(F.lit(35))) == "Kempegowda 2"
    assert value(spark, geo.ward_code(F.lit(7))) == "BBMP-007"
    assert value(spark, geo.ward_code(F.lit(12345))) == "BBMP-12345"


def test_message_rounds_halves_to_even(spark):
    assert value(spark, text.score_message("High heat stress", F.lit("X"), F.lit(60.5))) == "High heat stress in X: 60/100"
    assert value(spark, text.title_case(F.lit("cool_pavement"))) == "Cool Pavement"


def test_unparsable_time_takes_the_fallback(spark):
    fallback = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert str(value(spark, text.event_time(F.lit("soon"), fallback))) == "2024-01-01 00:00:00"
    assert str(value(spark, text.event_time(F.lit("2024-05-01T10:00:00Z"), fallback))) == "2024-05-01 10:00:00"


def test_ray_casting_on_a_concave_ring(spark):
    ring = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))])
    inside = {(1.0, 1.0): True, (2.0, 3.0): False, (3.5, 2.0): True, (5.0, 1.0): False, (2.0, 0.5): True}
    for (lon, lat), expected in inside.items():
        assert value(spark, geo.point_in_ring(F.lit(lon), F.lit(lat), ring)) is expected


@pytest.mark.parametrize("ward", [648_900, 900_001, 5_400_001, 30_000_000_001])
def test_wards_far_down_the_grid(spark, ward):
    found = wards.describe_wards(spark.range(ward, ward + 1).withColumnRenamed("id", "ward_id")).first()
    assert found["grid_row"] == (ward - 1) // 14 and found["ward_code"] == f"BBMP-{ward}"
    assert found["industrial_weight"] == pytest.approx(0.0, abs=1e-12)
