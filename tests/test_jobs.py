"""Recommendations, alerts, quality, drift, statistics, histories, images."""

from __future__ import annotations

import datetime as dt
import math
import random
import re
import struct

import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from wardlens.operators import aggregates, history, images, ranking, statistics as stats
from wardlens.plans import attribution, interventions as iv, quality, reports, risk, scoring, training, wards

SCORES = "ward_id INT, heat_stress_score DOUBLE, flood_risk_score DOUBLE"
NOW = dt.datetime(2024, 5, 1)


def scores(spark, data):
    return spark.createDataFrame(data, SCORES)


def test_greedy_recommendation_by_hand(spark):
    plan = ranking.greedy_recommendations(scores(spark, [(1, 80.0, 10.0), (2, 20.0, 60.0), (3, 50.0, 50.0)]), 5, 10)
    assert rows(plan.select("priority_rank", "ward_id", "intervention_type", "cost"), "priority_rank") == [
        (1, 1, "cool_pavement", 2), (2, 3, "tree_planting", 2)]


def greedy_in_python(data, budget, top_k):
    ranked = sorted(data, key=lambda r: (-(0.6 * r[1] + 0.4 * r[2]), r[0]))
    cost = {"tree_planting": 2, "cool_pavement": 2, "green_roof": 3, "permeable_pavement": 4, "urban_wetland": 6}
    spent, out = 0, []
    for ward, h, f in ranked:
        if len(out) >= top_k or spent >= budget:
            break
        wish = ("cool_pavement" if h >= 70 and f < 40 else "tree_planting" if h >= 60 else "urban_wetland" if f >= 55
                else "permeable_pavement" if f >= 40 else "green_roof")
        if spent + cost[wish] > budget:
            if spent + 2 > budget:
                break
            wish = "tree_planting"
        spent += cost[wish]
        out.append((len(out) + 1, ward, wish))
    return out, spent


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 100)), min_size=1, max_size=25), st.integers(0, 60),
       st.integers(1, 20))
def test_greedy_recommendation_properties(spark, pairs, budget, top_k):
    data = [(i + 1, float(h), float(f)) for i, (h, f) in enumerate(pairs)]
    plan = ranking.greedy_recommendations(scores(spark, data), budget, top_k)
    expected, spent = greedy_in_python(data, budget, top_k)
    assert rows(plan.select("priority_rank", "ward_id", "intervention_type"), "priority_rank") == expected
    assert spent <= budget


@pytest.mark.parametrize("budget", [0, 1, 2, 5, 301, 702, 10_000])
def test_greedy_plan_over_ranges(spark, budget):
    rng = random.Random(budget)
    data = [(i + 1, float(rng.randrange(101)), float(rng.choice((10, 50, 60)))) for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = rows(ranking.greedy_plan(scores(spark, data), budget).select("priority_rank", "ward_id", "intervention_type"), "priority_rank")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == greedy_in_python(data, budget, 1000)[0]


def test_benefit_recommendations_pad_absent_wards(spark):
    padded = iv.pad_wards(scores(spark, [(2, 90.0, 90.0)]), 3)
    assert rows(padded, "ward_id") == [(1, 40.0, 20.0), (2, 90.0, 90.0), (3, 40.0, 20.0)]
    best = iv.benefit_recommendations(padded, budget=60, top_k=1).first()
    assert (best["ward_id"], best["intervention_type"]) == (2, "urban_wetland")
    assert iv.benefit_recommendations(padded, budget=1).isEmpty()


@pytest.mark.parametrize(("heat", "flood", "expected"), [
    (75.0, 49.0, [("heat_wave", "critical")]), (60.0, 70.0, [("flood_warning", "critical"), ("heat_wave", "high")]),
    (59.9, 49.9, []), (74.9, 50.0, [("flood_warning", "high"), ("heat_wave", "high")])])
def test_alert_thresholds(spark, heat, flood, expected):
    row = scores(spark, [(1, heat, flood)]).withColumn("ward_name", F.lit("X"))
    alerts = risk.threshold_alerts(row, F.lit(NOW))
    assert rows(alerts.select("alert_type", "severity"), "alert_type") == expected


def test_tiers_resolve_as_a_whole(spark):
    full, empty = scores(spark, [(1, 1.0, 1.0), (2, 2.0, 2.0)]), scores(spark, [])
    got = risk.resolve_tiers([("postgresql_live", empty), ("live_weather", full), ("model_generated", full)])
    assert {r["data_source"] for r in got.collect()} == {"live_weather"}
    assert risk.resolve_tiers([("postgresql_live", full), ("model_generated", full)], [2]).count() == 1
    assert risk.freshness(full.withColumn("data_source", F.lit("live_weather"))).first()["source"] == "live_weather"
    assert risk.freshness(empty).first()["source"] == "model_generated"


def test_forecast_noise_is_optional_and_seeded(spark):
    base = scores(spark, [(1, 50.0, 50.0)])
    assert risk.hourly_forecast(base, 6).collect() == risk.hourly_forecast(base, 6).collect()
    noisy = risk.hourly_forecast(base, 6, noise_seed=3)
    assert noisy.collect() == noisy.collect() and noisy.collect() != risk.hourly_forecast(base, 6).collect()
    assert risk.hourly_forecast(base, 24).agg(F.min("confidence")).first()[0] == pytest.approx(0.3)


def snapshot(spark, n=198):
    base = wards.ward_catalogue(spark, n)
    key = F.col("ward_id").cast("double")
    return base.select(
        "ward_id", "ward_name", "centroid_lon", "centroid_lat", (F.lit(25.0) + key % 20).alias("lst_celsius"),
        (key % 80 / 100).alias("ndvi"), (F.lit(40.0) + key % 50).alias("impervious_pct"),
        (key % 30).alias("rainfall_mm_24h"), (F.lit(20.0) + key % 60).alias("pm25_ugm3"),
        (F.lit(5000.0) + key).alias("population_density"), (key % 100).alias("heat_stress_score"),
        (key % 90).alias("flood_risk_score"))


def test_quality_report_passes_and_fails(spark):
    good = quality.quality_report(snapshot(spark)).first()
    assert good["status"] == "pass" and good["issues"] == [] and good["row_count"] == 198
    assert set(good["correlations"].asDict()) == {"heat_vs_lst", "flood_vs_rain", "heat_vs_impervious"}
    broken = snapshot(spark).filter("ward_id != 5").withColumn(
        "ndvi", F.when(F.col("ward_id") == 7, 1.5).when(F.col("ward_id") == 8, None).otherwise(F.col("ndvi"))
    ).drop("pm25_ugm3")
    broken = broken.unionByName(broken.filter("ward_id = 9"))
    row = quality.quality_report(broken).first()
    assert row["status"] == "fail"
    assert set(row["issues"]) == {
        "ward_id contains duplicates", "ward_id sequence is incomplete", "Missing required column: pm25_ugm3",
        "Null values in ndvi: 1", "ndvi has 1 value(s) outside [0, 1]"}


def test_gates(spark):
    assert quality.gate_snapshot(snapshot(spark)) == {"rows": 198, "nulls": 0}
    with pytest.raises(ValueError):
        quality.gate_snapshot(snapshot(spark, 150))
    with pytest.raises(ValueError):
        quality.gate_snapshot(snapshot(spark).withColumn("heat_stress_score", F.lit(None).cast("double")))
    with pytest.raises(ValueError):
        quality.gate_not_empty(scores(spark, []))


def numpy_psi(expected, actual):
    lo, hi = min(expected.min(), actual.min()), max(expected.max(), actual.max()) + 1e-6
    edges = np.linspace(lo, hi, 11)
    e = np.clip(np.histogram(expected, edges)[0] / (len(expected) + 1e-8), 1e-6, None)
    a = np.clip(np.histogram(actual, edges)[0] / (len(actual) + 1e-8), 1e-6, None)
    return float(np.sum((a - e) * np.log(a / e)))


@pytest.mark.parametrize("shift", [0.0, 0.5, 3.0, 100.0])
def test_psi_equals_numpy(spark, shift):
    rng = np.random.default_rng(5)
    expected, actual = rng.normal(45, 15, 400), rng.normal(45 + shift, 15, 300)
    long = lambda xs: spark.createDataFrame([("m", float(x)) for x in xs], "metric STRING, value DOUBLE")
    report = quality.drift_report(long(expected), long(actual)).first()
    assert report["psi"] == pytest.approx(numpy_psi(expected, actual), rel=1e-9)
    assert report["psi"] >= 0
    same = quality.drift_report(long(expected), long(expected)).first()
    assert same["psi"] == 0.0 and same["level"] == "OK"


def test_drift_check_bootstraps_its_baseline(spark, tmp_path):
    path = str(tmp_path / "baseline")
    now = spark.createDataFrame([("heat", float(i)) for i in range(50)], "metric STRING, value DOUBLE")
    assert quality.check_drift(now, "gnn", path).isEmpty()
    later = now.withColumn("value", F.col("value") + 40).unionByName(
        spark.createDataFrame([("unknown", 1.0)], "metric STRING, value DOUBLE"))
    report = quality.check_drift(later, "gnn", path)
    assert [(r["metric"], r["level"]) for r in report.collect()] == [("heat", "CRITICAL")]
    assert quality.needs_retraining(report).first()["retrain"]


@pytest.mark.parametrize("few", [stats.FEW_ROWS, 1])
def test_drift_brings_no_metric_to_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(stats, "FEW_ROWS", few)
    rng = np.random.default_rng(6)
    sides = [{m: rng.normal(45 + k * i, 15, 300) for i, m in enumerate(("a", "b", "c"))} for k in (0, 4)]
    long = [spark.createDataFrame([(m, float(x)) for m, xs in side.items() for x in xs] + [("a", None), (f"only{k}", 1.0)],
                                  "metric STRING, value DOUBLE") for k, side in enumerate(sides)]
    report = quality.drift_report(*long)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"SortMergeJoin \[metric#\d+\]", plan)
    assert {m: psi for m, psi, _ in rows(report)} == pytest.approx({m: numpy_psi(sides[0][m], sides[1][m]) for m in "abc"})


@pytest.mark.parametrize("n", [1, 2, 3, 100, 20_001])
def test_exact_percentiles_equal_numpy(spark, n):
    rng = random.Random(n)
    data = [rng.choice([1.0, 1.0, rng.gauss(0, 50)]) for _ in range(n)]  # most values tie
    probabilities = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    df = spark.createDataFrame([(x,) for x in data], "v DOUBLE")
    got = dict(rows(stats.exact_percentiles(df, "v", probabilities)))
    for p in probabilities:
        assert got[p] == pytest.approx(float(np.quantile(data, p)), rel=1e-9, abs=1e-12)


def test_order_keys_are_the_bits_of_the_numbers(spark):
    rng = random.Random(5)
    data = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1e300,
            float("inf"), -float("inf"), 1.0, 1.0 - 2**-53, 1.0 + 2**-52, -3.5]
    data += [math.ldexp(rng.uniform(1, 2), e) * rng.choice((1, -1)) for e in range(-1074, 1024)] + [2.0**e for e in range(-1074, 1024)]
    df = spark.createDataFrame([(x,) for x in [*data, float("nan")]], "v DOUBLE")
    for x, key in rows(stats.with_order_key(df, "v")):
        bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
        assert key == (2**63 - 1 if math.isnan(x) else -bits if x < 0 else bits), x


def test_percentiles_beside_one_huge_value(spark):
    rng = random.Random(6)
    data = [rng.random() for _ in range(100_000)] + [1e300]
    df = spark.createDataFrame([(x,) for x in [*data, None]], "v DOUBLE")
    got = dict(rows(stats.exact_percentiles(df, "v", [0.5, 0.99999, 1.0])))
    assert got == {p: pytest.approx(float(np.quantile(data, p)), rel=1e-12) for p in (0.5, 0.99999, 1.0)}
    odd = spark.createDataFrame([(float("nan"),), (1.0,), (-float("inf"),), (2.0,)], "v DOUBLE")
    got = dict(rows(stats.exact_percentiles(odd, "v", [0.0, 1 / 3, 1.0])))
    assert got[0.0] == -float("inf") and got[1 / 3] == 1.0 and math.isnan(got[1.0])
    assert rows(stats.exact_percentiles(df.limit(0), "v", [0.5])) == []


def test_feedback_bias_by_hand(spark):
    data = [("fake", NOW), ("real", NOW - dt.timedelta(days=10)), ("real", None)]
    df = spark.createDataFrame(data, "label STRING, flagged_at TIMESTAMP")
    two = aggregates.feedback_bias(df.limit(2), F.lit(NOW)).first()
    assert two["bias"] == pytest.approx(-0.05) and (two["fake_count"], two["real_count"]) == (1, 1)
    assert aggregates.feedback_bias(df, F.lit(NOW)).first()["bias"] == pytest.approx(-0.04)
    assert aggregates.feedback_bias(df.limit(0), F.lit(NOW)).first()["bias"] == 0.0
    many = df.limit(1).crossJoin(spark.range(50)).drop("id")
    assert aggregates.feedback_bias(many, F.lit(NOW)).first()["bias"] == -0.25


def test_image_verdict_by_hand(spark):
    blue = [("flood", 0, y, 20, 60, 120, 10, 1) for y in range(10)]
    dry = [("dry", 0, y, 200, 160, 105, 10, 1) for y in range(10)]
    pixels = spark.createDataFrame(blue + dry, "image_id STRING, x INT, y INT, r INT, g INT, b INT, height INT, width INT")
    got = {r["image_id"]: r for r in images.score_images(pixels).collect()}
    assert got["flood"]["water"] == 1.0 and got["flood"]["raw_flood_score"] == pytest.approx(0.45)
    assert got["flood"]["confidence"] == pytest.approx(1 / (1 + np.exp(-(4.5 - 2.5)))) and got["flood"]["is_flood"]
    assert got["dry"]["raw_flood_score"] == 0.0 and not got["dry"]["is_flood"]
    shown = images.with_details(images.score_images(pixels)).filter("image_id = 'flood'").first()
    assert shown["details"]["water_px_pct"] == 100.0 and shown["label"] == "flood"


def daily(spark, days=12, skip=()):
    data = [(w, NOW.date() + dt.timedelta(days=d), 30.0 + w + d % 4, float(d), 20.0, 50.0, 6000.0, 0.2, 0.1)
            for w in (1, 2, 3) for d in range(days) if (w, d) not in skip]
    return spark.createDataFrame(
        data, "ward_id INT, snapshot_ts DATE, lst_celsius DOUBLE, rainfall_mm_24h DOUBLE, pm25_ugm3 DOUBLE, "
        "impervious_pct DOUBLE, population_density DOUBLE, ndvi DOUBLE, ndbi DOUBLE")


def test_training_windows_shape_and_split(spark):
    samples = training.training_windows(daily(spark)).collect()
    assert len(samples) == 3 * (12 - 8)
    assert all(len(r["x_seq"]) == 8 and len(r["x_seq"][0]) == 12 for r in samples)
    assert {r["snapshot_idx"] for r in samples if r["split"] == "validation"} == {11}  # max(1, int(.2 * 4))


def test_split_by_hand(spark):
    df = spark.range(42).select((F.col("id") + 8).alias("snapshot_idx"))
    counts = dict(rows(history.chronological_split(df).groupBy("split").count()))
    assert counts == {"validation": 8, "train": 34}


def test_gaps_are_zero_or_filled(spark):
    gappy = history.with_snapshot_index(daily(spark, 3, skip={(1, 1), (2, 0)}))
    zero = {(r[0], r[1]): r[2] for r in history.densify(gappy, ["lst_celsius"]).collect()}
    filled = {(r[0], r[1]): r[2] for r in history.densify(gappy, ["lst_celsius"], "ffill").collect()}
    assert len(zero) == 9 and zero[(1, 1)] == 0.0 and zero[(2, 0)] == 0.0
    assert filled[(1, 1)] == 31.0 and filled[(2, 0)] == 0.0


def test_samples_do_not_depend_on_the_block(spark):
    dense = history.densify(history.with_snapshot_index(daily(spark, 40)), ["lst_celsius"])
    small = history.sliding_samples(dense, ["lst_celsius"], ["lst_celsius"], 8, block=8)
    large = history.sliding_samples(dense, ["lst_celsius"], ["lst_celsius"], 8, block=4096)
    key = ("ward_id", "snapshot_idx")
    assert rows(small, *key) == rows(large, *key)


def test_padding(spark):
    indexed = history.with_snapshot_index(daily(spark, 3, skip={(1, 2)}))
    got = {r["ward_id"]: [x[0] for x in r["x_seq"]] for r in history.padded_latest(indexed, ["lst_celsius"], 5).collect()}
    assert got[1] == [0.0, 0.0, 31.0, 32.0, 0.0] and got[2] == [0.0, 0.0, 32.0, 33.0, 34.0]


def test_baseline_regression_uses_neighbours(spark):
    dense = history.densify(history.with_snapshot_index(daily(spark, 20)), ["lst_celsius"])
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "src BIGINT, dst BIGINT, weight DOUBLE")
    rows_ = training.lag_features(dense, ["lst_celsius"], ["lst_celsius"], edges)
    samples = history.chronological_split(rows_)
    model = training.fit_baseline(samples, ["lag_lst_celsius", "near_lst_celsius"], "lst_celsius")
    metrics = {r["split"]: r for r in training.evaluate_baseline(model, samples, "lst_celsius").collect()}
    assert set(metrics) == {"train", "validation"} and metrics["train"]["rmse"] < 3


def test_scoring_loads_the_model_once_per_task(spark):
    df = spark.range(0, 1000, 1, 2).select(F.col("id").alias("ward_id"), F.col("id").cast("double").alias("x"))
    out = scoring.score(df, scoring.linear_scorer(["x"], [2.0], 1.0), "ward_id BIGINT, score DOUBLE")
    assert out.agg(F.sum("score")).first()[0] == 2.0 * 499500 + 1000


def test_report_lifecycle(spark):
    data = [(1, 5, 12.9, 77.5, "garbage", 3, None, "u1"), (2, 6, 12.9, 77.5, "waterlogging", 3, None, "u2"),
            (3, 7, 12.9, 77.5, "garbage", 9, None, None)]
    new = spark.createDataFrame(data, "id BIGINT, ward_id INT, latitude DOUBLE, longitude DOUBLE, report_type STRING, "
                                "severity INT, description STRING, image_url STRING")
    verdicts = spark.createDataFrame([("u1", True, 0.8), ("u2", True, 0.6)], "image_url STRING, is_flood BOOLEAN, confidence DOUBLE")
    accepted, rejected = reports.intake(new, verdicts)
    assert rows(accepted.select("id", "report_type"), "id") == [(1, "flood"), (2, "waterlogging")]
    assert [r["id"] for r in rejected.collect()] == [3]
    names = spark.createDataFrame([(5, "Five")], "ward_id INT, ward_name STRING")
    alerts = {r["report_id"]: r for r in reports.citizen_alerts(accepted, names, F.lit(NOW)).collect()}
    assert alerts[1]["severity"] == "critical" and "Five (AI confidence: 80%)" in alerts[1]["message"]
    assert alerts[2]["severity"] == "high" and "Ward-6" in alerts[2]["message"]


def test_importance_falls_back_to_the_static_table(spark):
    fallback = attribution.feature_importance(spark).collect()
    assert len(fallback) == 8 and {r["source"] for r in fallback} == {"static_fallback"}
    data = spark.createDataFrame([(1, [1.0, 3.0], [0.0, 0.0])], "ward_id INT, heat_importance ARRAY<DOUBLE>, flood_importance ARRAY<DOUBLE>")
    live = rows(attribution.feature_importance(spark, data, ["a", "b"]).select("feature", "importance"))
    assert [(f, round(x, 9)) for f, x in live] == [("b", 0.75), ("a", 0.25)]
