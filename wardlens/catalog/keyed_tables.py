"""Upserts, change logs, set operations on keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import ranking, sets, tables
from ..plans import registry as model_registry, risk as risk_jobs
from ..plans.reports import with_review_columns
from ..schemas import add_missing_columns
from .registry import query
from .views import Tables


def _at(value: str):
    return F.to_timestamp_ntz(F.lit(value))


_LATEST_WEATHER = """
latest AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY ward_id ORDER BY ts DESC, id DESC) AS rn FROM weather) WHERE rn = 1)"""


@query("W2 S5", "weather", "temperature_2m humidity_pct precipitation_mm", f"""
WITH {_LATEST_WEATHER} SELECT id, ward_id, ts, temperature_2m, humidity_pct, precipitation_mm FROM latest""")
def latest_weather(t: Tables) -> DataFrame:
    return ranking.latest_per_key(t.weather, ["ward_id"], ["ts", "id"])


def _score_updates(t: Tables) -> DataFrame:
    """New scores for two thirds of the suppliers' ids, some beyond the existing wards."""
    key = F.col("s_suppkey")
    return t.base("supplier").select(
        (key * 20 + 1).alias("ward_id"), F.lit(50.0).alias("heat_stress_score"),
        (key % 100).cast("double").alias("flood_risk_score"), F.lit("medium").alias("risk_level"))


_UPDATES = """
updates AS (SELECT s_suppkey * 20 + 1 AS ward_id, 50.0::DOUBLE AS heat_stress_score,
                   CAST(s_suppkey % 100 AS DOUBLE) AS flood_risk_score, 'medium' AS risk_level FROM supplier)"""


@query("K5 K3", "scores", "heat_stress_score flood_risk_score", f"""
WITH {_UPDATES}
SELECT ward_id, heat_stress_score, flood_risk_score, risk_level FROM scores
WHERE ward_id NOT IN (SELECT ward_id FROM updates) UNION ALL SELECT * FROM updates""")
def merged_scores(t: Tables) -> DataFrame:
    target = t.scores.select("ward_id", "heat_stress_score", "flood_risk_score", "risk_level")
    return tables.merge_upsert(target, _score_updates(t), ["ward_id"])


@query("K6 X14 P10 P11 P12", "scores weather", "heat_stress_score flood_risk_score lst_pred_celsius ndvi", f"""
WITH {_LATEST_WEATHER},
scored AS (
  SELECT ward_id, least(100.0, least(greatest((temperature_2m - 28.0) / 14.0 * 100.0, 0.0), 100.0)
           + least(greatest((humidity_pct - 30.0) / 70.0 * 15.0, 0.0), 15.0)) AS h,
         least(greatest(precipitation_mm / 20.0 * 100.0, 0.0), 100.0) AS f, temperature_2m AS lst
  FROM latest)
SELECT coalesce(s.ward_id, x.ward_id) AS ward_id, coalesce(x.h, s.heat_stress_score) AS heat_stress_score,
       coalesce(x.f, s.flood_risk_score) AS flood_risk_score, coalesce(x.lst, s.lst_pred_celsius) AS lst_pred_celsius,
       s.ndvi, CASE WHEN x.ward_id IS NULL THEN s.risk_level
         WHEN 0.6 * h + 0.4 * f >= 75 THEN 'critical' WHEN 0.6 * h + 0.4 * f >= 50 THEN 'high'
         WHEN 0.6 * h + 0.4 * f >= 25 THEN 'medium' ELSE 'low' END AS risk_level,
       CASE WHEN x.ward_id IS NULL THEN s.updated_at ELSE TIMESTAMP '2024-02-01 00:00:00' END AS updated_at
FROM (SELECT * REPLACE (ward_id + 25 AS ward_id) FROM scores) s FULL OUTER JOIN scored x ON s.ward_id = x.ward_id""")
def refreshed_scores(t: Tables) -> DataFrame:
    """Readings refresh stored scores whose wards are shifted: some are new, some have no reading."""
    stored = t.scores.withColumn("ward_id", F.col("ward_id") + 25)
    refreshed = risk_jobs.refresh_scores(stored, t.weather, _at("2024-02-01 00:00:00"), ["ts", "id"])
    return refreshed.select("ward_id", "heat_stress_score", "flood_risk_score", "lst_pred_celsius", "ndvi",
                            "risk_level", "updated_at")


@query("K9 K8", "reports", "", """
SELECT id, report_type, FALSE AS is_fake, FALSE AS bbmp_confirmed,
       coalesce(description, 'none') AS description FROM reports""")
def evolved_reports(t: Tables) -> DataFrame:
    evolved = add_missing_columns(with_review_columns(t.reports), {"description": "none"})
    return evolved.select("id", "report_type", "is_fake", "bbmp_confirmed", "description")


def _change_log(t: Tables) -> DataFrame:
    """Orders as a change log: one customer's orders in time order are images of one key, some of them deletions."""
    key = F.col("o_orderkey")
    return t.base("orders").select(
        F.col("o_custkey").alias("ward_id"), F.col("o_totalprice").alias("value"), key.alias("version"),
        F.when(key % 7 == 0, "D").otherwise("U").alias("op"),
        (_at("2024-01-01 00:00:00") + F.make_dt_interval(F.lit(0), F.lit(0), (key % 100000).cast("int")))
        .alias("committed_at"))


_LOG = """
log AS (SELECT o_custkey AS ward_id, o_totalprice AS value, o_orderkey AS version,
               CASE WHEN o_orderkey % 7 = 0 THEN 'D' ELSE 'U' END AS op,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(o_orderkey % 100000) AS committed_at FROM orders)"""


@query("K10 S5", "", "value", f"""
WITH {_LOG} SELECT ward_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY ward_id ORDER BY version DESC) AS rn FROM log) WHERE rn = 1 AND op != 'D'""")
def latest_table(t: Tables) -> DataFrame:
    return tables.as_of_version(_change_log(t), ["ward_id"])


@query("K10", "", "value", f"""
WITH {_LOG} SELECT ward_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY ward_id ORDER BY version DESC) AS rn FROM log WHERE version <= 9000)
WHERE rn = 1 AND op != 'D'""")
def table_as_of_version(t: Tables) -> DataFrame:
    return tables.as_of_version(_change_log(t), ["ward_id"], 9000)


@query("K10", "", "", f"""
WITH {_LOG} SELECT version // 500 AS version, count(*) AS changes, count(*) FILTER (WHERE op = 'D') AS deletes,
       max(committed_at) AS committed_at FROM log GROUP BY 1""")
def table_history(t: Tables) -> DataFrame:
    grouped = _change_log(t).withColumn("version", F.floor(F.col("version") / 500))
    return tables.history(grouped)


@query("K10", "", "value", f"""
WITH {_LOG}, cut AS (SELECT TIMESTAMP '2024-01-11 00:00:00' - INTERVAL '168 hours' AS c)
SELECT ward_id, value, version, op FROM log, cut WHERE committed_at >= c
UNION ALL SELECT ward_id, value, version, op FROM (
  SELECT log.*, row_number() OVER (PARTITION BY ward_id ORDER BY version DESC) AS rn FROM log, cut WHERE committed_at < c)
WHERE rn = 1 AND op != 'D'""")
def compacted_log(t: Tables) -> DataFrame:
    kept = tables.compact(_change_log(t), ["ward_id"], _at("2024-01-11 00:00:00"))
    return kept.select("ward_id", "value", "version", "op")


@query("K11", "reports", "", """
SELECT id, report_type, id IN (SELECT doc_id FROM labels WHERE quality = 0) AS is_fake,
       CASE WHEN id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN TIMESTAMP '2024-02-01 00:00:00' END AS fake_flagged_at
FROM reports WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def flagged_reports(t: Tables) -> DataFrame:
    """Reports labelled 0 become fake, those labelled toxic are deleted."""
    labels = t.base("labels").withColumnRenamed("doc_id", "id")
    stored = with_review_columns(t.reports).withColumn("fake_flagged_at", F.lit(None).cast("timestamp_ntz"))
    flagged = tables.set_flags(stored, labels.filter("quality = 0"), "id",
                               {"is_fake": F.lit(True), "fake_flagged_at": _at("2024-02-01 00:00:00")})
    kept = tables.delete_ids(flagged, labels.filter("toxic = 1"), "id")
    return kept.select("id", "report_type", "is_fake", "fake_flagged_at")


@query("U8 K11", "feedback", "", """
WITH entries AS (
  SELECT doc_id AS report_id, CASE doc_id % 3 WHEN 0 THEN 'clear' WHEN 1 THEN 'fake' ELSE 'real' END AS label,
         TIMESTAMP '2024-02-02 00:00:00' AS flagged_at FROM documents)
SELECT * FROM feedback WHERE report_id NOT IN (SELECT report_id FROM entries)
UNION ALL SELECT * FROM entries WHERE label != 'clear'""")
def updated_feedback(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    entries = t.base("documents").select(
        key.alias("report_id"), F.when(key % 3 == 0, "clear").when(key % 3 == 1, "fake").otherwise("real").alias("label"),
        _at("2024-02-02 00:00:00").alias("flagged_at"))
    return sets.record_feedback(t.feedback, entries)


@query("U6 A12", "", "", """
SELECT CAST(i AS BIGINT) AS ward_id FROM range(0, 1 + (SELECT max(o_custkey) FROM orders)) r(i)
WHERE i NOT IN (SELECT o_custkey FROM orders)""")
def missing_wards(t: Tables) -> DataFrame:
    """Customers without an order; the expected ids run to the table's own maximum."""
    orders = t.base("orders")
    seen = orders.select(F.col("o_custkey").alias("ward_id"))
    last = orders.agg(F.max("o_custkey")).first()[0]
    return sets.missing_keys(seen, "ward_id", 0, last)


@query("U7", "readings", "", "SELECT DISTINCT ward_id, CAST(ts AS DATE) AS day FROM readings")
def distinct_ward_days(t: Tables) -> DataFrame:
    return t.readings.select("ward_id", F.to_date("ts").alias("day")).distinct()


@query("L9 X21", "runs", "metric_value", """
SELECT experiment, run_id, metric_value FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY metric_value, run_id) AS rn FROM runs
  WHERE status = 'FINISHED' AND metric_name = 'val_heat_rmse') WHERE rn = 1""")
def best_runs(t: Tables) -> DataFrame:
    return ranking.best_run(t.runs, "val_heat_rmse", False).select("experiment", "run_id", "metric_value")


_EXPERIMENTS = {"thermal_vision_lst": "1-URGENT", "st_gnn_ward_risk": "2-HIGH", "rl_green_infra": "5-LOW"}
_GATES = {"thermal_vision_lst": ("val_heat_rmse", 500.0, False), "st_gnn_ward_risk": ("val_heat_rmse", 2000.0, False),
          "rl_green_infra": ("ep_reward_mean", 50.0, True)}
_DECISIONS = """
gates(model, experiment, metric, threshold, higher) AS (VALUES
  ('thermal_vision_lst', '1-URGENT', 'val_heat_rmse', 500.0::DOUBLE, FALSE),
  ('st_gnn_ward_risk', '2-HIGH', 'val_heat_rmse', 2000.0::DOUBLE, FALSE),
  ('rl_green_infra', '5-LOW', 'ep_reward_mean', 50.0::DOUBLE, TRUE)),
decisions AS (SELECT *, CASE WHEN higher THEN metric_value > threshold ELSE metric_value < threshold END AS passes FROM (
  SELECT g.model, r.run_id, g.metric, r.metric_value, g.threshold, g.higher,
         row_number() OVER (PARTITION BY g.model ORDER BY CASE WHEN higher THEN -metric_value ELSE metric_value END, run_id)
           AS rn
  FROM gates g JOIN runs r ON r.experiment = g.experiment AND r.metric_name = g.metric WHERE r.status = 'FINISHED')
  WHERE rn = 1)"""


@query("X21 F14", "runs", "metric_value threshold",
       f"WITH {_DECISIONS} SELECT model, run_id, metric, metric_value, threshold, passes FROM decisions")
def gate_decisions(t: Tables) -> DataFrame:
    return model_registry.gate_decisions(t.runs, _GATES, _EXPERIMENTS)


def _registered(t: Tables) -> DataFrame:
    """Every order is a registered version of one of three models; the highest version is in Production."""
    key = F.col("o_orderkey")
    models = F.array(*[F.lit(m) for m in _GATES])
    last = t.base("orders").agg(F.max("o_orderkey")).scalar()
    return t.base("orders").select(
        F.get(models, (key % 3).cast("int")).alias("model"), F.floor(key / 3).cast("int").alias("version"),
        F.when(key > last - 3, "Production").otherwise("Archived").alias("stage"),
        F.concat(F.lit("run-"), key.cast("string")).alias("run_id"))


_REGISTRY = """
registered AS (SELECT ['thermal_vision_lst', 'st_gnn_ward_risk', 'rl_green_infra'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS model,
  CAST(o_orderkey // 3 AS INTEGER) AS version,
  CASE WHEN o_orderkey > (SELECT max(o_orderkey) FROM orders) - 3 THEN 'Production' ELSE 'Archived' END AS stage,
  'run-' || o_orderkey AS run_id FROM orders)"""


@query("X21 K6", "runs", "", f"""
WITH {_DECISIONS}, {_REGISTRY}
SELECT model, version, CASE WHEN stage = 'Production' AND model IN (SELECT model FROM decisions WHERE passes)
                            THEN 'Archived' ELSE stage END AS stage, run_id FROM registered
UNION ALL SELECT d.model, CAST((SELECT max(version) FROM registered r WHERE r.model = d.model) + 1 AS INTEGER),
                 'Production', run_id FROM decisions d WHERE passes""")
def promoted_models(t: Tables) -> DataFrame:
    return model_registry.promote(_registered(t), model_registry.gate_decisions(t.runs, _GATES, _EXPERIMENTS))


@query("J18 X21", "runs", "", f"""
WITH {_REGISTRY}
SELECT v.version, v.stage, v.run_id[:8] AS run, coalesce(printf('%.4f', m.metric_value), 'N/A') AS metric
FROM registered v LEFT JOIN (SELECT run_id, metric_value FROM runs WHERE metric_name = 'val_heat_rmse') m USING (run_id)
WHERE model = 'st_gnn_ward_risk'""")
def version_comparison(t: Tables) -> DataFrame:
    from ..operators.joins import compare_versions

    versions = _registered(t).filter(F.col("model") == "st_gnn_ward_risk")
    return compare_versions(versions, t.runs, "val_heat_rmse")


@query("J3 J4", "scores weather", "temperature_c rainfall_mm_24h lst_pred_celsius ndvi impervious_pct pm25", f"""
WITH {_LATEST_WEATHER}
SELECT w.ward_id, temperature_2m AS temperature_c, precipitation_mm AS rainfall_mm_24h, ts AS obs_time,
       coalesce(s.lst_pred_celsius, temperature_2m) AS lst_pred_celsius, coalesce(s.ndvi, 0.3) AS ndvi,
       coalesce(s.impervious_pct, 40.0) AS impervious_pct, 35.0 AS pm25
FROM latest w LEFT JOIN (SELECT * REPLACE (ward_id + 40 AS ward_id) FROM scores) s USING (ward_id)""")
def weather_features(t: Tables) -> DataFrame:
    """The first forty wards have no stored score."""
    from ..operators.joins import weather_with_scores

    latest = ranking.latest_per_key(t.weather, ["ward_id"], ["ts", "id"]).select(
        "ward_id", F.col("temperature_2m").alias("temperature_c"), F.col("precipitation_mm").alias("rainfall_mm_24h"),
        F.col("ts").alias("obs_time"))
    return weather_with_scores(latest, t.scores.withColumn("ward_id", F.col("ward_id") + 40))
