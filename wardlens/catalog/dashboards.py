"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregates, joins, ranking
from ..plans import dashboard, risk as risk_jobs
from .registry import query
from .views import Tables


def _at(value: str):
    return F.to_timestamp_ntz(F.lit(value))


@query("A4 A5 X23", "scores", "avg_heat_stress avg_flood_risk avg_lst", """
SELECT count(*) AS wards, count(*) FILTER (WHERE risk_level = 'critical') AS critical_wards,
       count(*) FILTER (WHERE risk_level = 'high') AS high_wards, avg(heat_stress_score) AS avg_heat_stress,
       avg(flood_risk_score) AS avg_flood_risk, avg(lst_pred_celsius) AS avg_lst, max(updated_at) AS latest_update
FROM scores""")
def risk_kpis(t: Tables) -> DataFrame:
    return aggregates.risk_kpis(t.scores)


@query("A4 F10", "interventions", "", """
SELECT count(*) FILTER (WHERE created_at >= date_trunc('day', TIMESTAMP '2001-06-01 13:00:00')) AS interventions_today
FROM interventions""")
def interventions_today(t: Tables) -> DataFrame:
    return aggregates.counts_since(t.interventions, "created_at", F.date_trunc("day", _at("2001-06-01 13:00:00"))
                                   .cast("timestamp_ntz"), "interventions_today")


@query("A6 X23", "scores", "", "SELECT risk_level, count(*) AS ward_count FROM scores GROUP BY risk_level")
def wards_by_level(t: Tables) -> DataFrame:
    return aggregates.count_by(t.scores, "risk_level", "ward_count")


@query("A6 X23", "reports", "", "SELECT report_type, count(*) AS report_count FROM reports GROUP BY report_type")
def reports_by_type_count(t: Tables) -> DataFrame:
    return aggregates.count_by(t.reports, "report_type", "report_count")


@query("A7 X23", "scores", "avg_heat_stress avg_flood_risk avg_lst", """
SELECT updated_at, count(*) FILTER (WHERE risk_level = 'critical') AS critical_wards,
       avg(heat_stress_score) AS avg_heat_stress, avg(flood_risk_score) AS avg_flood_risk, avg(lst_pred_celsius) AS avg_lst
FROM scores GROUP BY updated_at""")
def risk_over_time(t: Tables) -> DataFrame:
    return aggregates.risk_over_time(t.scores)


@query("A9", "weather", "avg_humidity_pct", """
SELECT ward_id, avg(humidity_pct) AS avg_humidity_pct FROM weather GROUP BY ward_id
ORDER BY avg_humidity_pct DESC, ward_id LIMIT 15""")
def most_humid_wards(t: Tables) -> DataFrame:
    return aggregates.top_average(t.weather, "ward_id", "humidity_pct", 15)


@query("A10", "scores", "bin_start", """
SELECT floor(heat_stress_score / 10) * 10 AS bin_start, count(*) AS n FROM scores GROUP BY 1""")
def heat_histogram(t: Tables) -> DataFrame:
    return aggregates.histogram(t.scores, "heat_stress_score", 10)


@query("L5 J1 X23", "scores wards", "heat_stress_score flood_risk_score combined_risk ndvi impervious_pct", """
SELECT r.ward_id, w.ward_name, heat_stress_score, flood_risk_score,
       0.6 * heat_stress_score + 0.4 * flood_risk_score AS combined_risk, risk_level, ndvi, impervious_pct
FROM scores r LEFT JOIN wards w USING (ward_id) ORDER BY combined_risk DESC, r.ward_id LIMIT 20""")
def top_combined_wards(t: Tables) -> DataFrame:
    return dashboard.top_wards(t.scores, t.wards, 20, "combined_risk").select(
        "ward_id", "ward_name", "heat_stress_score", "flood_risk_score", "combined_risk", "risk_level", "ndvi",
        "impervious_pct")


@query("L5 J1", "scores wards", "heat_stress_score", """
SELECT ward_id, ward_name, heat_stress_score, risk_level FROM scores LEFT JOIN wards USING (ward_id)
ORDER BY heat_stress_score DESC, ward_id LIMIT 10""")
def top_hot_wards(t: Tables) -> DataFrame:
    return dashboard.top_wards(t.scores, t.wards, 10).select("ward_id", "ward_name", "heat_stress_score", "risk_level")


@query("J2 L10 X23", "scores wards", "heat_stress_score flood_risk_score lst_pred_celsius ndvi impervious_pct "
       "centroid_lat centroid_lon", """
SELECT ward_id, ward_name, centroid_lat, centroid_lon, heat_stress_score, flood_risk_score, lst_pred_celsius, ndvi,
       impervious_pct, risk_level, updated_at
FROM scores JOIN wards USING (ward_id)""")
def all_risk_scores(t: Tables) -> DataFrame:
    return dashboard.all_risk_scores(t.scores, t.wards).select(
        "ward_id", "ward_name", "centroid_lat", "centroid_lon", "heat_stress_score", "flood_risk_score",
        "lst_pred_celsius", "ndvi", "impervious_pct", "risk_level", "updated_at")


@query("J1", "scores wards", "heat_stress_score", """
SELECT r.ward_id, coalesce(w.ward_name, 'Ward-' || r.ward_id) AS ward_name, heat_stress_score
FROM scores r LEFT JOIN (SELECT * REPLACE (ward_id + 5 AS ward_id) FROM wards) w USING (ward_id)""")
def named_scores(t: Tables) -> DataFrame:
    """The first five wards are absent from the shifted ward table."""
    known = t.wards.withColumn("ward_id", F.col("ward_id") + 5)
    return joins.with_ward_names(t.scores, known).select("ward_id", "ward_name", "heat_stress_score")


@query("F9 P42 X23", "scores wards", "", """
SELECT created_at AS time, 'CRITICAL: ' || ward_name AS text, risk_level AS tags, ward_id
FROM scores JOIN wards USING (ward_id)
WHERE risk_level = 'critical' AND created_at > TIMESTAMP '2024-01-01 20:30:00' - INTERVAL '12 hours'""")
def critical_annotations(t: Tables) -> DataFrame:
    return dashboard.critical_annotations(t.scores, t.wards, _at("2024-01-01 20:30:00"), "12 hours")


@query("L3 J2 X23", "interventions wards", "expected_heat_reduction expected_flood_reduction", """
SELECT ward_id, ward_name, id, intervention_type, expected_heat_reduction, expected_flood_reduction, cost, created_at
FROM (SELECT * FROM interventions WHERE created_at > TIMESTAMP '2001-07-01 00:00:00' - INTERVAL '300 days'
      ORDER BY created_at DESC, id DESC LIMIT 20) JOIN wards USING (ward_id)""")
def recent_interventions(t: Tables) -> DataFrame:
    return dashboard.recent_interventions(
        t.interventions, t.wards, _at("2001-07-01 00:00:00"), 20, "300 days"
    ).select("ward_id", "ward_name", "id", "intervention_type", "expected_heat_reduction", "expected_flood_reduction",
             "cost", "created_at")


@query("L3 J1", "reports wards", "", """
SELECT id, ward_id, ward_name, report_type, severity, description, reported_at
FROM (SELECT * FROM reports ORDER BY reported_at DESC, id DESC LIMIT 20) LEFT JOIN wards USING (ward_id)""")
def recent_reports(t: Tables) -> DataFrame:
    return dashboard.recent_reports(t.reports, t.wards).select(
        "id", "ward_id", "ward_name", "report_type", "severity", "description", "reported_at")


@query("P43 F9", "weather", "value", """
SELECT id, ts AS time, temperature_2m AS value, CAST(ward_id AS VARCHAR) AS metric FROM weather
WHERE ts > TIMESTAMP '2001-01-01 00:00:00'""")
def temperature_series(t: Tables) -> DataFrame:
    rows = t.weather.filter(F.col("ts") > _at("2001-01-01 00:00:00"))
    return rows.select("id", F.col("ts").alias("time"), F.col("temperature_2m").alias("value"),
                       F.col("ward_id").cast("string").alias("metric"))


@query("L1 F3", "scores", "heat_stress_score ndvi", """
SELECT ward_id, heat_stress_score, ndvi, risk_level FROM scores WHERE risk_level = 'high'
ORDER BY ndvi DESC, ward_id LIMIT 198""")
def ward_listing(t: Tables) -> DataFrame:
    return risk_jobs.ward_listing(t.scores, "high", "ndvi", 198).select(
        "ward_id", "heat_stress_score", "ndvi", "risk_level")


@query("L4", "scores", "heat_stress_score", """
SELECT ward_id, heat_stress_score FROM scores ORDER BY heat_stress_score DESC, ward_id LIMIT 5""")
def five_hottest(t: Tables) -> DataFrame:
    return ranking.largest(t.scores, "heat_stress_score", 5).select("ward_id", "heat_stress_score")


@query("L7", "risks", "combined_risk", """
SELECT ward_id, ward_name, 0.6 * heat_stress_score + 0.4 * flood_risk_score AS combined_risk FROM risks
WHERE risk_level = 'critical'""")
def critical_wards(t: Tables) -> DataFrame:
    return risk_jobs.critical_wards(t.risks).select("ward_id", "ward_name", "combined_risk")


@query("A24", "weather wards", "avg_temperature_c avg_rainfall_mm max_rainfall_mm", """
WITH w AS (SELECT ward_id, ward_name, temperature_2m, precipitation_mm FROM (
  SELECT *, row_number() OVER (PARTITION BY ward_id ORDER BY ts DESC, id DESC) AS rn FROM weather) JOIN wards USING (ward_id)
  WHERE rn = 1)
SELECT count(*) AS wards, avg(temperature_2m) AS avg_temperature_c, avg(precipitation_mm) AS avg_rainfall_mm,
       max(precipitation_mm) AS max_rainfall_mm,
       (SELECT ward_name FROM w ORDER BY precipitation_mm DESC, ward_id LIMIT 1) AS wettest_ward
FROM w""")
def weather_cache_summary(t: Tables) -> DataFrame:
    latest = ranking.latest_per_key(t.weather, ["ward_id"], ["ts", "id"])
    named = joins.join_wards(latest, t.wards).withColumnsRenamed(
        {"temperature_2m": "temperature_c", "precipitation_mm": "rainfall_mm"})
    return aggregates.weather_cache_summary(named)
