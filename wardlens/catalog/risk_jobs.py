"""Alerts, forecasts, recommendations, scenarios, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregates, ranking, sets
from ..plans import interventions as iv, live_weather, risk as jobs
from ..sources.weather import GRID_LATS, GRID_LONS, grid_weather, nearest_grid_point
from .registry import query
from .views import Tables


def _at(value: str):
    return F.to_timestamp_ntz(F.lit(value))


ALERTS_SQL = """
SELECT ward_id, 'heat_wave' AS alert_type, CASE WHEN heat_stress_score >= 75 THEN 'critical' ELSE 'high' END AS severity,
       CASE WHEN heat_stress_score >= 75 THEN 'Extreme heat stress' ELSE 'High heat stress' END || ' in ' || ward_name
         || ': ' || CAST(round_even(heat_stress_score, 0) AS INTEGER) || '/100' AS message,
       heat_stress_score AS value, CASE WHEN heat_stress_score >= 75 THEN 75.0 ELSE 60.0 END AS threshold,
       TIMESTAMP '2024-02-01 00:00:00' AS timestamp
FROM risks WHERE heat_stress_score >= 60
UNION ALL
SELECT ward_id, 'flood_warning', CASE WHEN flood_risk_score >= 70 THEN 'critical' ELSE 'high' END,
       CASE WHEN flood_risk_score >= 70 THEN 'Flood risk critical' ELSE 'Elevated flood risk' END || ' in ' || ward_name
         || ': ' || CAST(round_even(flood_risk_score, 0) AS INTEGER) || '/100',
       flood_risk_score, CASE WHEN flood_risk_score >= 70 THEN 70.0 ELSE 50.0 END, TIMESTAMP '2024-02-01 00:00:00'
FROM risks WHERE flood_risk_score >= 50"""


@query("X3 U5 P34 T9", "risks", "value threshold", ALERTS_SQL)
def threshold_alerts(t: Tables) -> DataFrame:
    return jobs.threshold_alerts(t.risks, _at("2024-02-01 00:00:00"))


@query("U3 L6 T7", "risks", "value", f"""
WITH alerts AS ({ALERTS_SQL}),
tagged AS (
  SELECT *, 0 AS new FROM alerts
  UNION ALL SELECT * REPLACE (timestamp + to_minutes(ward_id % 3) AS timestamp), 1 FROM alerts),
one AS (SELECT *, row_number() OVER (PARTITION BY ward_id, timestamp ORDER BY new, alert_type, value) AS rn FROM tagged)
SELECT ward_id, alert_type, severity, value, timestamp FROM one WHERE rn = 1
ORDER BY timestamp DESC, ward_id DESC LIMIT 50""")
def newest_alerts(t: Tables) -> DataFrame:
    """Known alerts merged with new ones, a third of which are at the same instant."""
    alerts = jobs.threshold_alerts(t.risks, _at("2024-02-01 00:00:00"))
    shift = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("ward_id") % 3).cast("int"))
    incoming = alerts.withColumn("timestamp", F.col("timestamp") + shift)
    merged = sets.merge_alerts(alerts, incoming, 50)
    return merged.select("ward_id", "alert_type", "severity", "value", "timestamp")


@query("X4 J16 P28", "scores", "heat_stress_predicted flood_risk_predicted confidence", """
SELECT ward_id, CAST(h AS INTEGER) AS hour,
       least(greatest(heat_stress_score + 3.0 * sin(pi() * (h % 24 - 6) / 12.0), 0.0), 100.0) AS heat_stress_predicted,
       least(greatest(flood_risk_score, 0.0), 100.0) AS flood_risk_predicted,
       greatest(0.3, 1.0 - h * 0.08) AS confidence
FROM scores, range(1, 25) r(h)""")
def hourly_forecast(t: Tables) -> DataFrame:
    return jobs.hourly_forecast(t.scores, 24)


@query("X16 W3 L2 F4", "risks", "heat_stress_score composite_risk", """
SELECT CAST(row_number() OVER (ORDER BY composite_risk DESC, ward_id) AS INTEGER) AS priority_rank, * FROM (
  SELECT ward_id, ward_name, heat_stress_score, 0.6 * heat_stress_score + 0.4 * flood_risk_score AS composite_risk,
         risk_level
  FROM risks WHERE heat_stress_score >= 30 ORDER BY composite_risk DESC, ward_id LIMIT 25)""")
def priority_wards(t: Tables) -> DataFrame:
    return jobs.priority_wards(t.risks, 25, 30.0).select(
        "priority_rank", "ward_id", "ward_name", "heat_stress_score", "composite_risk", "risk_level")


_CATALOGUE = """
catalogue(intervention_type, heat_red, flood_red, cost, ord) AS (VALUES
  ('tree_planting', 9.0::DOUBLE, 0.0::DOUBLE, 2, 1), ('cool_pavement', 10.0, 0.0, 2, 2), ('green_roof', 5.6, 0.0, 3, 3),
  ('permeable_pavement', 0.0, 15.0, 4, 4), ('urban_wetland', 3.0, 25.0, 6, 5))"""
_WANTED = """CASE WHEN heat_stress_score >= 70 AND flood_risk_score < 40 THEN 'cool_pavement'
  WHEN heat_stress_score >= 60 THEN 'tree_planting' WHEN flood_risk_score >= 55 THEN 'urban_wetland'
  WHEN flood_risk_score >= 40 THEN 'permeable_pavement' ELSE 'green_roof' END"""


def _greedy_sql(budget: int, top_k: int, source: str = "scores") -> str:
    """Recursive walk over the ranked wards; a ward's pick is its wish if affordable, else the cheapest option (2)."""
    return f"""
WITH RECURSIVE {_CATALOGUE},
ranked AS (
  SELECT row_number() OVER (ORDER BY 0.6 * heat_stress_score + 0.4 * flood_risk_score DESC, ward_id) AS pos, ward_id,
         heat_stress_score, flood_risk_score, {_WANTED} AS wanted FROM {source}),
walk AS (
  SELECT 0::BIGINT AS pos, 0 AS spent, NULL::BIGINT AS ward_id, NULL::VARCHAR AS pick, 0.0::DOUBLE AS h, 0.0::DOUBLE AS f
  UNION ALL
  SELECT r.pos, w.spent + CASE WHEN w.spent + c.cost <= {budget} THEN c.cost ELSE 2 END, r.ward_id,
         CASE WHEN w.spent + c.cost <= {budget} THEN r.wanted ELSE 'tree_planting' END, r.heat_stress_score,
         r.flood_risk_score
  FROM walk w JOIN ranked r ON r.pos = w.pos + 1 JOIN catalogue c ON c.intervention_type = r.wanted
  WHERE r.pos <= {top_k} AND w.spent < {budget} AND (w.spent + c.cost <= {budget} OR w.spent + 2 <= {budget}))
SELECT CAST(pos AS INTEGER) AS priority_rank, ward_id, pick AS intervention_type, heat_red AS expected_heat_reduction,
       flood_red AS expected_flood_reduction, cost, h AS ward_heat_stress, f AS ward_flood_risk
FROM walk JOIN catalogue ON pick = intervention_type"""


_REC_DOUBLES = "expected_heat_reduction expected_flood_reduction ward_heat_stress ward_flood_risk"


@query("X5", "scores", _REC_DOUBLES, _greedy_sql(61, 40))
def budgeted_recommendations(t: Tables) -> DataFrame:
    return ranking.greedy_recommendations(t.scores, 61, 40)


@query("X5", "scores", _REC_DOUBLES, _greedy_sql(3001, 10**9))
def greedy_plan_of_all_wards(t: Tables) -> DataFrame:
    """A budget in the thousands spent over the ranking of all wards."""
    return ranking.greedy_plan(t.scores, 3001)


@query("X5 A19", "scores", "", f"""
SELECT CAST(sum(cost) AS BIGINT) AS budget_used, CAST(500 - sum(cost) AS BIGINT) AS budget_remaining
FROM ({_greedy_sql(500, 198)})""")
def budget_use(t: Tables) -> DataFrame:
    return aggregates.budget_use(ranking.greedy_recommendations(t.scores, 500, 198), 500)


_ZONE_SQL = f"""
WITH RECURSIVE {_CATALOGUE},
ranked AS (
  SELECT c_mktsegment AS zone, ward_id, heat_stress_score, flood_risk_score, {_WANTED} AS wanted,
         row_number() OVER (PARTITION BY c_mktsegment ORDER BY 0.6 * heat_stress_score + 0.4 * flood_risk_score DESC,
                            ward_id) AS pos
  FROM scores JOIN customer ON ward_id = c_custkey + 1),
walk AS (
  SELECT DISTINCT zone, 0::BIGINT AS pos, 0 AS spent, NULL::BIGINT AS ward_id, NULL::VARCHAR AS pick, 0.0::DOUBLE AS h,
         0.0::DOUBLE AS f FROM ranked
  UNION ALL
  SELECT w.zone, r.pos, w.spent + CASE WHEN w.spent + c.cost <= 40 THEN c.cost ELSE 2 END, r.ward_id,
         CASE WHEN w.spent + c.cost <= 40 THEN r.wanted ELSE 'tree_planting' END, r.heat_stress_score,
         r.flood_risk_score
  FROM walk w JOIN ranked r ON r.pos = w.pos + 1 AND r.zone = w.zone JOIN catalogue c ON c.intervention_type = r.wanted
  WHERE r.pos <= 15 AND w.spent < 40 AND (w.spent + c.cost <= 40 OR w.spent + 2 <= 40))
SELECT zone, CAST(pos AS INTEGER) AS priority_rank, ward_id, pick AS intervention_type,
       heat_red AS expected_heat_reduction, flood_red AS expected_flood_reduction, cost, h AS ward_heat_stress,
       f AS ward_flood_risk
FROM walk JOIN catalogue ON pick = intervention_type"""


@query("X5", "scores", _REC_DOUBLES, _ZONE_SQL)
def zone_recommendations(t: Tables) -> DataFrame:
    """One budgeted plan per market segment."""
    zones = t.scores.join(
        t.base("customer").select((F.col("c_custkey") + 1).alias("ward_id"), F.col("c_mktsegment").alias("zone")),
        "ward_id")
    return ranking.greedy_recommendations(zones, 40, 15, "zone")


_ACTIONS = """
actions(intervention_type, cost, ndvi_d, imp_d, lst_d, heat_d, flood_d) AS (VALUES
  ('tree_planting', 2, 0.08::DOUBLE, 0.0::DOUBLE, -1.5::DOUBLE, -6.0::DOUBLE, 0.0::DOUBLE),
  ('green_roof', 3, 0.04, -5.0, -0.8, -4.0, 0.0), ('permeable_pavement', 4, 0.0, -12.0, 0.0, 0.0, -15.0),
  ('urban_wetland', 6, 0.05, 0.0, 0.0, -3.0, -25.0), ('cool_pavement', 2, 0.0, 0.0, -1.0, -8.0, 0.0))"""
_OPTIONS = f"""
{_ACTIONS},
options AS (
  SELECT ward_id, intervention_type, cost, heat_stress_score AS h, flood_risk_score AS f,
         abs(heat_d + 2 * abs(lst_d)) AS hr, abs(flood_d) AS fr,
         0.6 * abs(heat_d) / 100.0 * heat_stress_score + 0.4 * abs(flood_d) / 100.0 * flood_risk_score AS benefit
  FROM scores, actions)"""


@query("X6 J15 P30", "scores", f"{_REC_DOUBLES} benefit_score", f"""
WITH {_OPTIONS}
SELECT CAST(row_number() OVER (ORDER BY benefit DESC, ward_id, intervention_type) AS INTEGER) AS priority_rank, ward_id,
       intervention_type, hr AS expected_heat_reduction, fr AS expected_flood_reduction, cost, benefit AS benefit_score,
       h AS ward_heat_stress, f AS ward_flood_risk
FROM (SELECT * FROM options WHERE cost <= 4 ORDER BY benefit DESC, ward_id, intervention_type LIMIT 30)""")
def benefit_recommendations(t: Tables) -> DataFrame:
    return iv.benefit_recommendations(t.scores, 4, 30)


@query("J15 P29 X26", "scores", "benefit effectiveness", f"""
WITH {_OPTIONS}
SELECT o.ward_id, o.intervention_type, o.benefit,
       0.6 * abs(heat_d) + 0.4 * abs(flood_d) + 20 * abs(ndvi_d) + 3 * abs(lst_d) AS effectiveness
FROM options o JOIN actions USING (intervention_type)""")
def ward_actions(t: Tables) -> DataFrame:
    options = iv.with_benefit(iv.actions(t.scores.select("ward_id", "heat_stress_score", "flood_risk_score")))
    catalogue = iv.catalogue(t.spark).select("intervention_type", "effectiveness")
    return options.join(catalogue, "intervention_type").select(
        "ward_id", "intervention_type", F.col("benefit_score").alias("benefit"), "effectiveness")


@query("U4 J11", "scores", "ward_heat_stress", f"""
WITH RECURSIVE first_list AS (
  SELECT ward_id, 'cool_pavement' AS intervention_type, 2 AS cost, heat_stress_score AS h,
         row_number() OVER (ORDER BY heat_stress_score DESC, ward_id) AS rank_ FROM scores
  ORDER BY heat_stress_score DESC, ward_id LIMIT 6),
rest AS (SELECT * FROM scores WHERE ward_id NOT IN (SELECT ward_id FROM first_list)),
{_greedy_sql(28, 14, 'rest').split('WITH RECURSIVE')[1].replace('SELECT CAST(pos', ', filled AS (SELECT CAST(pos')})
SELECT CAST(rank_ AS INTEGER) AS priority_rank, ward_id, intervention_type, cost, h AS ward_heat_stress FROM first_list
UNION ALL SELECT priority_rank + 6, ward_id, intervention_type, cost, ward_heat_stress FROM filled""")
def filled_recommendations(t: Tables) -> DataFrame:
    """Six hottest wards first (12 of a budget of 40), then the heuristic on what is left, 20 rows in all."""
    hottest = ranking.ranked_top(t.scores, F.col("heat_stress_score"), 6)
    primary = hottest.select(
        "priority_rank", "ward_id", F.lit("cool_pavement").alias("intervention_type"), F.lit(2).alias("cost"),
        F.col("heat_stress_score").alias("ward_heat_stress"))
    return iv.fill_recommendations(primary, t.scores, 40, 20)


@query("P31 J15", "scores", "ndvi impervious_pct heat_stress_score flood_risk_score reward", f"""
WITH {_ACTIONS},
after AS (
  SELECT ward_id, intervention_type, cost, heat_stress_score AS h0, flood_risk_score AS f0, ward_id % 3 AS n,
         least(greatest(ndvi + ndvi_d, 0.0), 1.0) AS ndvi,
         least(greatest(impervious_pct + imp_d, 0.0), 100.0) AS impervious_pct,
         least(greatest(heat_stress_score + heat_d - abs(lst_d) * 2, 0.0), 100.0) AS h1,
         least(greatest(flood_risk_score + flood_d, 0.0), 100.0) AS f1
  FROM scores, actions)
SELECT ward_id, intervention_type, ndvi, impervious_pct, h1 AS heat_stress_score, f1 AS flood_risk_score,
       greatest(0.0, h0 - h1) + greatest(0.0, f0 - f1) - cost * 0.001
         - CASE WHEN n > 0 THEN 0.5 * pow(n, 1.5) ELSE 0 END
         - CASE WHEN greatest(0.0, h0 - h1) + greatest(0.0, f0 - f1) < 1.0 THEN 0.3 ELSE 0 END AS reward
FROM after""")
def projected_effects(t: Tables) -> DataFrame:
    return iv.project_effects(iv.actions(t.scores), F.col("ward_id") % 3)


@query("X25 A17", "scores", "city_score improvement_bonus", f"""
WITH {_ACTIONS},
after AS (
  SELECT intervention_type, least(greatest(heat_stress_score + heat_d - abs(lst_d) * 2, 0.0), 100.0) AS h,
         least(greatest(flood_risk_score + flood_d, 0.0), 100.0) AS f FROM scores, actions
  UNION ALL SELECT 'none', heat_stress_score, flood_risk_score FROM scores)
SELECT intervention_type, 0.6 * avg(h) + 0.4 * avg(f) AS city_score,
       0.6 * greatest(0.0, 50 - avg(h)) * 0.1 + 0.4 * greatest(0.0, 40 - avg(f)) * 0.1 AS improvement_bonus
FROM after GROUP BY intervention_type""")
def city_scenarios(t: Tables) -> DataFrame:
    return iv.scenarios(t.scores)


@query("X17 J14 P33", "risks interventions", "composite_risk expected_heat_reduction expected_flood_reduction roi_score "
       "lon lat", """
WITH first_iv AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY ward_id ORDER BY id) AS rn FROM interventions) WHERE rn = 1)
SELECT r.ward_id, ward_name, 0.6 * heat_stress_score + 0.4 * flood_risk_score AS composite_risk, risk_level,
       intervention_type AS recommended_intervention, coalesce(expected_heat_reduction, 0.0) AS expected_heat_reduction,
       coalesce(expected_flood_reduction, 0.0) AS expected_flood_reduction, coalesce(nullif(cost - 1, 0), 1) AS cost,
       (coalesce(expected_heat_reduction, 0.0) + coalesce(expected_flood_reduction, 0.0))
         / coalesce(nullif(cost - 1, 0), 1) AS roi_score,
       round(77.35 + (77.82::DOUBLE - 77.35::DOUBLE) * (((r.ward_id - 1) % 14) / 13.0::DOUBLE), 5) AS lon,
       round(12.77 + (13.18::DOUBLE - 12.77::DOUBLE) * (((r.ward_id - 1) // 14) / 14.0::DOUBLE), 5) AS lat
FROM risks r LEFT JOIN first_iv USING (ward_id)""")
def roi_table(t: Tables) -> DataFrame:
    """Logged interventions as recommendations; a cost of zero occurs."""
    recommendations = t.interventions.withColumn("cost", F.col("cost") - 1).withColumn(
        "priority_rank", F.col("id"))
    return iv.roi_table(t.risks, recommendations).drop("heat_stress_score", "flood_risk_score")


@query("X15 F5", "scores", "heat_stress_score", """
SELECT ward_id, heat_stress_score, 'live_weather' AS data_source FROM scores
WHERE heat_stress_score >= 20 AND ward_id IN (SELECT s_suppkey + 1 FROM supplier)""")
def resolved_tier(t: Tables) -> DataFrame:
    """The stored tier has none of the wanted wards, so the live tier answers as a whole."""
    base = t.scores.select("ward_id", "heat_stress_score")
    tiers = [("postgresql_live", base.filter(F.col("heat_stress_score") < -1)),
             ("live_weather", base.filter(F.col("heat_stress_score") >= 20)), ("model_generated", base)]
    wanted = t.base("supplier").select((F.col("s_suppkey") + 1).alias("ward_id"))
    return jobs.resolve_tiers(tiers, wanted)


@query("P38", "scores", "", "SELECT 'postgresql_live' AS source, count(*) AS total FROM scores")
def freshness(t: Tables) -> DataFrame:
    rows = t.scores.withColumn("updated_at", F.when(F.col("ward_id") % 5 == 0, F.col("updated_at"))).withColumn(
        "data_source", F.lit("live_weather"))
    return jobs.freshness(rows)


def _payload(t: Tables) -> DataFrame:
    """One API response per ship date, built from the line items: 20 grid points, some fields and points absent."""
    i = F.pmod(F.col("l_orderkey"), F.lit(20)).cast("int")
    points = t.base("lineitem").groupBy(F.to_date("l_shipdate").alias("day"), i.alias("i")).agg(
        F.avg("l_quantity").alias("q"), F.sum("l_linenumber").cast("double").alias("s"))
    location = F.struct(
        F.struct(F.when(F.col("i") % 7 != 0, F.col("q")).alias("temperature_2m"),
                 (F.lit(40.0) + F.col("i")).alias("relative_humidity_2m"),
                 F.when(F.col("i") % 3 == 0, F.lit(1.0)).alias("precipitation")).alias("current"),
        F.struct(F.when(F.col("i") % 5 != 0, F.array(F.col("s"))).alias("precipitation_sum")).alias("daily"))
    # a response has at most twenty locations; an absent one keeps its place as an empty object
    slots = points.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("i", location.alias("l")))).alias("m"))
    body = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.try_element_at("m", k))
    return slots.select("day", F.to_json(F.transform(body, lambda l: F.coalesce(l, F.from_json(F.lit("{}"), (
        "current STRUCT<temperature_2m: DOUBLE, relative_humidity_2m: DOUBLE, precipitation: DOUBLE>, "
        "daily STRUCT<precipitation_sum: ARRAY<DOUBLE>>"))))).alias("value"))


_POINTS = """
points AS (
  SELECT CAST(l_shipdate AS DATE) AS day, CAST(l_orderkey % 20 AS INTEGER) AS i, avg(l_quantity) AS q,
         CAST(sum(l_linenumber) AS DOUBLE) AS s FROM lineitem GROUP BY ALL),
full_points AS (SELECT d.day, CAST(k AS INTEGER) AS i, p.i AS hit, q, s FROM (SELECT DISTINCT day FROM points) d, range(0, 20) r(k)
                LEFT JOIN points p ON p.day = d.day AND p.i = k)"""


@query("S9", "", "grid_lat grid_lon temperature_c humidity_pct current_precip rainfall_mm temp_max wind_speed", f"""
WITH {_POINTS}
SELECT day, {list(GRID_LATS)}[i // 4 + 1] AS grid_lat, {list(GRID_LONS)}[i % 4 + 1] AS grid_lon,
       coalesce(CASE WHEN i % 7 != 0 THEN q END, 30.0) AS temperature_c,
       CASE WHEN hit IS NULL THEN 60.0 ELSE 40.0 + i END AS humidity_pct,
       CASE WHEN hit IS NOT NULL AND i % 3 = 0 THEN 1.0 ELSE 0.0 END AS current_precip,
       coalesce(CASE WHEN i % 5 != 0 THEN s END, 0.0) AS rainfall_mm, 32.0 AS temp_max, 5.0 AS wind_speed
FROM full_points""")
def grid_weather_points(t: Tables) -> DataFrame:
    return grid_weather(_payload(t), keep=["day"]).drop("temp_min")


@query("J6", "wards", "grid_lat grid_lon", f"""
WITH pts AS (
  SELECT row_number() OVER () AS o, lat, lon FROM (
    SELECT unnest({list(GRID_LATS)}) AS lat), (SELECT unnest({list(GRID_LONS)}) AS lon)),
ordered AS (SELECT lat, lon, row_number() OVER (ORDER BY lat, lon) AS o FROM pts),
d AS (SELECT ward_id, lat, lon, row_number() OVER (PARTITION BY ward_id ORDER BY
        (lat - centroid_lat) * (lat - centroid_lat) + (lon - centroid_lon) * (lon - centroid_lon), o) AS rn
      FROM wards, ordered)
SELECT ward_id, lat AS grid_lat, lon AS grid_lon FROM d WHERE rn = 1""")
def nearest_weather_points(t: Tables) -> DataFrame:
    point = nearest_grid_point(F.col("centroid_lon"), F.col("centroid_lat"))
    return t.wards.select("ward_id", point.alias("g")).select("ward_id", "g.*")


@query("X13 J5 P15 P16", "wards ward_features", "lst_celsius uhi_offset rainfall_mm temperature_c humidity_pct ndvi", f"""
WITH {_POINTS},
grid AS (SELECT {list(GRID_LATS)}[i // 4 + 1] AS grid_lat, {list(GRID_LONS)}[i % 4 + 1] AS grid_lon,
       coalesce(CASE WHEN i % 7 != 0 THEN q END, 30.0) AS temperature_c,
       CASE WHEN hit IS NULL THEN 60.0 ELSE 40.0 + i END AS humidity_pct,
       CASE WHEN hit IS NOT NULL AND i % 3 = 0 THEN 1.0 ELSE 0.0 END AS current_precip,
       coalesce(CASE WHEN i % 5 != 0 THEN s END, 0.0) AS rainfall_mm
  FROM full_points WHERE day = (SELECT max(day) FROM points)),
near AS (SELECT * FROM (
  SELECT ward_id, ward_name, grid_lat, grid_lon, temperature_c, humidity_pct, current_precip, rainfall_mm,
         row_number() OVER (PARTITION BY ward_id ORDER BY (grid_lat - centroid_lat) * (grid_lat - centroid_lat)
           + (grid_lon - centroid_lon) * (grid_lon - centroid_lon), grid_lat, grid_lon) AS rn FROM wards, grid) WHERE rn = 1),
filled AS (SELECT n.*, coalesce(f.ndvi, 0.30) AS ndvi, coalesce(f.impervious_pct, 55.0) AS imp,
                  coalesce(f.industrial_weight, 0.2) AS ind
           FROM near n LEFT JOIN (SELECT * REPLACE (ward_id + 30 AS ward_id) FROM ward_features) f USING (ward_id))
SELECT ward_id, ward_name, temperature_c, humidity_pct, ndvi, 1.5 + imp / 100.0 * 4.5 + ind * 2.0 AS uhi_offset,
       temperature_c + (1.5 + imp / 100.0 * 4.5 + ind * 2.0) - ndvi * 3.0 AS lst_celsius,
       CASE WHEN current_precip > 0 THEN greatest(rainfall_mm, current_precip * 4.0) ELSE rainfall_mm END AS rainfall_mm
FROM filled""")
def live_ward_weather(t: Tables) -> DataFrame:
    """The newest payload on all wards; the first thirty wards have no static features."""
    payload = _payload(t)
    newest = payload.agg(F.max_by("value", "day").alias("value"))
    static = t.ward_features.withColumn("ward_id", F.col("ward_id") + 30)
    live = live_weather.live_ward_weather(grid_weather(newest), t.wards, static)
    return live.select("ward_id", "ward_name", "temperature_c", "humidity_pct", "ndvi", "uhi_offset", "lst_celsius",
                       "rainfall_mm")
