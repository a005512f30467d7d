"""Whole tables written by a sink and read back by a source."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from ..operators import ranking
from ..operators.nested import point_geometry
from ..plans import interventions, quality
from ..session import scratch_path
from ..sinks import files as sinks, messages as message_sinks
from ..sources import files, messages, rasters
from ..streaming import windows as window_jobs
from .registry import query
from .risk_jobs import _greedy_sql
from .streams import _finish
from .views import Tables

_READINGS_SQL = "SELECT event_id, ward_id, sensor_id, ts, temperature_c, rainfall_mm FROM readings"


def _readings(t: Tables) -> DataFrame:
    return t.readings.select("event_id", "ward_id", "sensor_id", "ts", "temperature_c", "rainfall_mm")


@query("S2 K2", "readings", "temperature_c rainfall_mm", f"{_READINGS_SQL} UNION ALL {_READINGS_SQL}")
def csv_round_trip(t: Tables) -> DataFrame:
    """Two appends to one CSV table."""
    out, rows = scratch_path(t.spark, "csv"), _readings(t)
    sinks.write_csv(rows, out, "append")
    sinks.write_csv(rows, out, "append")
    return files.read_csv(t.spark, out, rows.schema)


@query("S3 K4", "readings", "temperature_c rainfall_mm", _READINGS_SQL)
def followed_csv(t: Tables) -> DataFrame:
    """A folder of CSV files followed by a stream into a table."""
    out, rows = scratch_path(t.spark, "followed"), _readings(t)
    sinks.write_csv(rows, os.path.join(out, "in"), "append")
    stream = files.follow_csv(t.spark, os.path.join(out, "in"), rows.schema)
    _finish(window_jobs.append_stream(stream, os.path.join(out, "table"), os.path.join(out, "state"), once=True))
    return t.spark.read.schema(rows.schema).parquet(os.path.join(out, "table"))


@query("S4 K3 K14", "ward_features", "heat_stress_score centroid_lon", """
SELECT ward_id, ward_name, heat_stress_score, centroid_lon, 'csv' AS copy FROM ward_features
UNION ALL SELECT ward_id, ward_name, heat_stress_score, centroid_lon, 'parquet' FROM ward_features""")
def snapshot_copies(t: Tables) -> DataFrame:
    rows = t.ward_features.select("ward_id", "ward_name", "heat_stress_score", "centroid_lon")
    out = scratch_path(t.spark, "snapshot")
    csv, parquet = f"{out}.csv", f"{out}.parquet"
    sinks.write_snapshot(rows, csv, parquet)
    read = [files.read_features(t.spark, p, rows.schema).withColumn("copy", F.lit(k))
            for k, p in (("csv", csv), ("parquet", parquet))]
    return read[0].unionByName(read[1])


@query("K1 S1 N1", "readings", "temperature_c", """
SELECT sensor_id AS key, ward_id, ts, temperature_c FROM readings""")
def message_round_trip(t: Tables) -> DataFrame:
    """Readings as keyed messages in files, parsed back by the topic parser."""
    out = scratch_path(t.spark, "messages")
    rows = t.readings.select(
        "ward_id", "sensor_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        "temperature_c", "humidity_pct", "pm25", "rainfall_mm")
    message_sinks.write_message_files(message_sinks.to_messages(rows, F.col("sensor_id")), out)
    stored = t.spark.read.schema("key STRING, value STRING").json(out)
    accepted, _ = messages.parse_sensor_messages(stored)
    return accepted.select("key", F.col("ward_id").cast("bigint").alias("ward_id"),
                           F.col("ts").cast("timestamp_ntz").alias("ts"), "temperature_c")


@query("K15 X18 N4", "risks", "lon", """
SELECT ward_id, ward_name, risk_level, CAST(ward_id % 180 AS DOUBLE) AS lon FROM risks""")
def geojson_export(t: Tables) -> DataFrame:
    """The exported document's feature lines, parsed back."""
    out = scratch_path(t.spark, "geojson")
    point = point_geometry((F.col("ward_id") % 180).cast("double"), F.lit(12.5))
    sinks.export(t.risks.select("ward_id", "ward_name", "risk_level").withColumn("geometry", point), out, "geojson",
                 "geometry")
    feature = F.from_json(F.regexp_replace("value", "^,", ""), (
        "type STRING, geometry STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>, "
        "properties STRUCT<ward_id: BIGINT, ward_name: STRING, risk_level: STRING>"))
    lines = t.spark.read.text(out).select(feature.alias("f")).filter(F.col("f.type") == "Feature")
    return lines.select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("lon"))


@query("X17 X5 K15 N4", "risks scores", "roi_score lon lat", f"""
WITH rec AS ({_greedy_sql(500, 198)})
SELECT r.ward_id, ward_name, intervention_type AS recommended_intervention, CAST(coalesce(cost, 1) AS INTEGER) AS cost,
       (coalesce(expected_heat_reduction, 0.0) + coalesce(expected_flood_reduction, 0.0)) / coalesce(cost, 1) AS roi_score,
       round(77.35 + (77.82::DOUBLE - 77.35::DOUBLE) * (((r.ward_id - 1) % 14) / 13.0::DOUBLE), 5) AS lon,
       round(12.77 + (13.18::DOUBLE - 12.77::DOUBLE) * (((r.ward_id - 1) // 14) / 14.0::DOUBLE), 5) AS lat
FROM risks r LEFT JOIN rec USING (ward_id)""")
def roi_map(t: Tables) -> DataFrame:
    """The greedy plan for a budget of 500, its map exported as GeoJSON and read back."""
    out = scratch_path(t.spark, "roi")
    recommendations = ranking.greedy_recommendations(t.scores, 500, 198)
    sinks.export(interventions.roi_map(t.risks, recommendations), out, "geojson", "geometry")
    feature = F.from_json(F.regexp_replace("value", "^,", ""), (
        "type STRING, geometry STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>, properties STRUCT<ward_id: BIGINT, "
        "ward_name: STRING, recommended_intervention: STRING, cost: INT, roi_score: DOUBLE>"))
    lines = t.spark.read.text(out).select(feature.alias("f")).filter(F.col("f.type") == "Feature")
    return lines.select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("lon"),
                        F.col("f.geometry.coordinates")[1].alias("lat"))


@query("S8", "wards", "lon lat east", """
SELECT ward_id, ward_name, centroid_lon AS lon, centroid_lat AS lat, centroid_lon + 0.001::DOUBLE AS east FROM wards""")
def ward_geojson(t: Tables) -> DataFrame:
    """Wards with a square outline as a feature collection, read back by the ward geometry source."""
    out = scratch_path(t.spark, "wards")
    lon, lat, half = F.col("centroid_lon"), F.col("centroid_lat"), 0.001
    corners = ((-half, -half), (half, -half), (half, half), (-half, half), (-half, -half))
    outline = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*[
        F.array(lon + x, lat + y) for x, y in corners])).alias("coordinates"))
    sinks.export(t.wards.select("ward_id", "ward_name", "centroid_lon", "centroid_lat").withColumn("geometry", outline),
                 out, "geojson", "geometry")
    return rasters.read_ward_lines(t.spark, out).select(
        "ward_id", "ward_name", F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat"),
        F.array_max(F.transform("ring", lambda corner: corner[0])).alias("east"))


@query("K7", "readings", "temperature_c rainfall_mm", _READINGS_SQL)
def appended_readings(t: Tables) -> DataFrame:
    """A stored table that grows by two appends, read back."""
    out, rows = scratch_path(t.spark, "appended"), _readings(t)
    early = F.col("event_id") % 3 == 0
    sinks.append_table(rows.filter(early), out)
    sinks.append_table(rows.filter(~early), out)
    return t.spark.read.schema(rows.schema).parquet(out)


@query("P41 T11 K1", "scores", "", """
SELECT 'control' AS key, '{"event_type":"ward_features_updated","pipeline_run":"daily","ds":"2024-02-01","timestamp":"2024-02-01T06:00:00Z","ward_count":'
  || (SELECT count(*) FROM scores) || '}' AS value""")
def control_event(t: Tables) -> DataFrame:
    at = F.to_timestamp_ntz(F.lit("2024-02-01 06:00:00"))
    return message_sinks.control_event(t.scores, "daily", "2024-02-01", at)


@query("S12 K12 X7 A14", "", "psi", """
WITH b AS (SELECT o_totalprice AS v, 0 AS side FROM orders UNION ALL SELECT o_totalprice * 1.3::DOUBLE, 1 FROM orders),
r AS (SELECT min(v) AS lo, (max(v) + 1e-6 - min(v)) / 10 AS w, (SELECT count(*) FROM orders) AS n FROM b),
c AS (SELECT k, count(*) FILTER (WHERE side = 0 AND v >= lo + k * w AND (v < lo + (k + 1) * w OR k = 9)) AS c0,
             count(*) FILTER (WHERE side = 1 AND v >= lo + k * w AND (v < lo + (k + 1) * w OR k = 9)) AS c1,
             any_value(n) AS n FROM b, r, range(0, 10) t(k) GROUP BY k),
s AS (SELECT greatest(c0 / (n + 1e-8), 1e-6) AS e, greatest(c1 / (n + 1e-8), 1e-6) AS a FROM c)
SELECT 'price' AS metric, sum((a - e) * ln(a / e)) AS psi,
       CASE WHEN sum((a - e) * ln(a / e)) > 0.2 THEN 'CRITICAL' WHEN sum((a - e) * ln(a / e)) > 0.1 THEN 'WARN' ELSE 'OK' END AS level
FROM s""")
def stored_baseline_drift(t: Tables) -> DataFrame:
    """The first check stores the baseline, the second compares raised prices with it."""
    path = scratch_path(t.spark, "baseline")

    def prices(factor: float) -> DataFrame:
        return t.base("orders").select(F.lit("price").alias("metric"), (F.col("o_totalprice") * factor).alias("value"))

    quality.check_drift(prices(1.0), "risk", path)
    return quality.check_drift(prices(1.3), "risk", path)


def _psi_of(model: str, factor: str) -> str:
    return f"""SELECT '{model}' AS model, sum((a - e) * ln(a / e)) AS psi FROM (
  SELECT greatest(c0 / (n + 1e-8), 1e-6) AS e, greatest(c1 / (n + 1e-8), 1e-6) AS a FROM (
    SELECT k, count(*) FILTER (WHERE side = 0 AND v >= lo + k * w AND (v < lo + (k + 1) * w OR k = 9)) AS c0,
           count(*) FILTER (WHERE side = 1 AND v >= lo + k * w AND (v < lo + (k + 1) * w OR k = 9)) AS c1, any_value(n) AS n
    FROM (SELECT o_totalprice AS v, 0 AS side FROM orders UNION ALL SELECT o_totalprice * {factor}::DOUBLE, 1 FROM orders) b,
         (SELECT least(min(o_totalprice), min(o_totalprice * {factor}::DOUBLE)) AS lo,
                 (greatest(max(o_totalprice), max(o_totalprice * {factor}::DOUBLE)) + 1e-6
                  - least(min(o_totalprice), min(o_totalprice * {factor}::DOUBLE))) / 10 AS w, count(*) AS n FROM orders) r,
         range(0, 10) t(k) GROUP BY k))"""


@query("S12 K12 X7 A14", "", "psi", _psi_of("flood", "1.6") + " UNION ALL " + _psi_of("risk", "1.3"))
def two_model_drift(t: Tables) -> DataFrame:
    """Two models keep their baselines in one table; each is compared with its own."""
    path = scratch_path(t.spark, "baselines")

    def prices(factor: float) -> DataFrame:
        return t.base("orders").select(F.lit("price").alias("metric"), (F.col("o_totalprice") * factor).alias("value"))

    for model in ("risk", "flood"):
        quality.check_drift(prices(1.0), model, path)
    reports = [
        quality.check_drift(prices(factor), model, path).select(F.lit(model).alias("model"), "psi")
        for model, factor in (("flood", 1.6), ("risk", 1.3))
    ]
    return reports[0].union(reports[1])
