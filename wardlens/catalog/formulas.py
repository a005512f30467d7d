"""Scalar formulas, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geo, numeric, risk, spectral, text
from ..operators import filters, history, nested
from ..plans import satellite, wards
from .registry import query
from .views import Tables, level_sql


def _nd(a: str, b: str) -> str:
    return f"CASE WHEN {a} + {b} != 0 THEN ({a} - {b}) / ({a} + {b}) ELSE 0.0 END"


PIXEL_INDEX_SQL = f"""
SELECT *, least(greatest((ndbi + 1.0) / 2.0 * 100.0, 0.0), 100.0) AS impervious_pct FROM (
  SELECT *, {_nd('r5', 'r4')} AS ndvi, {_nd('r6', 'r5')} AS ndbi, {_nd('r3', 'r6')} AS mndwi,
         b10 * 0.00341802::DOUBLE + 149.0::DOUBLE - 273.15::DOUBLE AS lst_celsius
  FROM (SELECT *, b3 * 0.0000275::DOUBLE - 0.2::DOUBLE AS r3, b4 * 0.0000275::DOUBLE - 0.2::DOUBLE AS r4,
               b5 * 0.0000275::DOUBLE - 0.2::DOUBLE AS r5, b6 * 0.0000275::DOUBLE - 0.2::DOUBLE AS r6
        FROM pixels))"""


@query("P4 P5 P6 P7 P8 P9", "pixels", "ndvi ndbi mndwi impervious_pct lst_celsius",
       f'SELECT scene_id, "row", col, ndvi, ndbi, mndwi, impervious_pct, lst_celsius FROM ({PIXEL_INDEX_SQL})')
def pixel_indices(t: Tables) -> DataFrame:
    b3, b6 = spectral.reflectance(F.col("b3")), spectral.reflectance(F.col("b6"))
    return satellite.with_indices(t.pixels).withColumn("mndwi", spectral.mndwi(b3, b6)).select(
        "scene_id", "row", "col", "ndvi", "ndbi", "mndwi", "impervious_pct", "lst_celsius")


@query("P4 P5 P6 P7 P8 S11 X1", "pixels", "ndvi ndbi mndwi lst_celsius", f"""
SELECT ward_id, CASE WHEN ward_id % 4 = 0 THEN 0.2 ELSE ndvi END AS ndvi, ndbi, mndwi,
       CASE WHEN ward_id % 9 = 0 THEN 32.0 ELSE lst_celsius END AS lst_celsius
FROM (SELECT *, "row" * 256 + col AS ward_id FROM ({PIXEL_INDEX_SQL}))""")
def point_samples(t: Tables) -> DataFrame:
    """Samples of which some lack the red or the thermal band."""
    ward = F.col("row") * 256 + F.col("col")
    samples = t.pixels.withColumn("ward_id", ward).withColumn(
        "b4", F.when(ward % 4 != 0, F.col("b4"))).withColumn("b10", F.when(ward % 9 != 0, F.col("b10")))
    return satellite.point_samples(samples)


@query("P10 P11 P12", "weather", "heat_stress_score flood_risk_score", f"""
SELECT *, {level_sql('heat_stress_score', 'flood_risk_score')} AS risk_level FROM (
  SELECT id, least(100.0, least(greatest((temperature_2m - 28.0) / 14.0 * 100.0, 0.0), 100.0)
                        + least(greatest((humidity_pct - 30.0) / 70.0 * 15.0, 0.0), 15.0)) AS heat_stress_score,
         least(greatest(precipitation_mm / 20.0 * 100.0, 0.0), 100.0) AS flood_risk_score
  FROM weather)""")
def weather_scores(t: Tables) -> DataFrame:
    heat = risk.weather_heat_score(F.col("temperature_2m"), F.col("humidity_pct"))
    flood = risk.weather_flood_score(F.col("precipitation_mm"))
    return t.weather.select("id", heat.alias("heat_stress_score"), flood.alias("flood_risk_score"),
                            risk.risk_level(risk.combined_risk(heat, flood)).alias("risk_level"))


@query("P13 P14", "ward_features", "heat flood", """
SELECT ward_id,
  least(greatest((0.55 * (lst_celsius - 25.0) / 20.0 + 0.30 * (impervious_pct / 100.0) + 0.15 * (1.0 - ndvi)) * 100.0,
                 0.0), 100.0) AS heat,
  least(greatest((0.55 * least(1.0, rainfall_mm_24h / 60.0) + 0.30 * (impervious_pct / 100.0) + 0.15 * (1.0 - ndvi))
                 * 100.0, 0.0), 100.0) AS flood
FROM ward_features""")
def snapshot_scores(t: Tables) -> DataFrame:
    imp, ndvi = F.col("impervious_pct"), F.col("ndvi")
    return t.ward_features.select(
        "ward_id", risk.snapshot_heat_score(F.col("lst_celsius"), imp, ndvi).alias("heat"),
        risk.snapshot_flood_score(F.col("rainfall_mm_24h"), imp, ndvi).alias("flood"))


@query("P15 P16", "weather ward_features", "uhi_offset lst_celsius rainfall_mm", """
SELECT id, 1.5 + impervious_pct / 100.0 * 4.5 + industrial_weight * 2.0 AS uhi_offset,
       temperature_2m + (1.5 + impervious_pct / 100.0 * 4.5 + industrial_weight * 2.0) - ndvi * 3.0 AS lst_celsius,
       CASE WHEN id % 3 > 0 THEN greatest(precipitation_mm, id % 3 * 4.0) ELSE precipitation_mm END AS rainfall_mm
FROM weather JOIN ward_features USING (ward_id)""")
def heat_island(t: Tables) -> DataFrame:
    imp, ind = F.col("impervious_pct"), F.col("industrial_weight")
    joined = t.weather.join(t.ward_features.select("ward_id", "impervious_pct", "industrial_weight", "ndvi"), "ward_id")
    return joined.select(
        "id", risk.uhi_offset(imp, ind).alias("uhi_offset"),
        risk.uhi_surface_temperature(F.col("temperature_2m"), imp, ind, F.col("ndvi")).alias("lst_celsius"),
        risk.effective_rainfall(F.col("precipitation_mm"), (F.col("id") % 3).cast("double")).alias("rainfall_mm"))


_SEEDS_SQL = "[" + ", ".join(f"'{s}'" for s in geo.WARD_NAME_SEEDS) + "]"


@query("P17 P19 P20", "", "centroid_lon centroid_lat area_km2 industrial_weight", f"""
WITH ids AS (SELECT c_custkey + 1 AS ward_id FROM customer),
grid AS (SELECT ward_id, CAST((ward_id - 1) // 14 AS INTEGER) AS grid_row, CAST((ward_id - 1) % 14 AS INTEGER) AS grid_col,
                (77.78::DOUBLE - 77.45::DOUBLE) / 14 AS dx, (13.14::DOUBLE - 12.83::DOUBLE) / 15 AS dy FROM ids)
SELECT ward_id, grid_row, grid_col,
       'BBMP-' || CASE WHEN ward_id < 1000 THEN lpad(CAST(ward_id AS VARCHAR), 3, '0') ELSE CAST(ward_id AS VARCHAR) END
         AS ward_code,
       {_SEEDS_SQL}[CAST((ward_id - 1) % 34 + 1 AS INTEGER)]
         || CASE WHEN ward_id > 34 THEN ' ' || ((ward_id - 1) // 34 + 1) ELSE '' END AS ward_name,
       round(77.45 + (grid_col + 0.5) * dx, 6) AS centroid_lon, round(12.83 + (grid_row + 0.5) * dy, 6) AS centroid_lat,
       dy * 111.32 * (dx * (111.32 * cos(radians((12.83::DOUBLE + 13.14::DOUBLE) / 2)))) AS area_km2,
       least(1.0, 0.6 * exp(-((grid_row - 7)**2 + (grid_col - 7)**2) / 6.0)
                + 0.8 * exp(-((grid_row - 11)**2 + (grid_col - 2)**2) / 5.0)
                + 0.7 * exp(-((grid_row - 1)**2 + (grid_col - 11)**2) / 5.0)) AS industrial_weight
FROM grid""")
def ward_catalogue(t: Tables) -> DataFrame:
    ids = t.base("customer").select((F.col("c_custkey") + 1).alias("ward_id"))
    return wards.describe_wards(ids)


@query("P18", "", "lon lat", """
SELECT c_custkey + 1 AS ward_id, 77.35 + (77.82::DOUBLE - 77.35::DOUBLE) * ((c_custkey % 14) / 13.0::DOUBLE) AS lon,
       12.77 + (13.18::DOUBLE - 12.77::DOUBLE) * ((c_custkey // 14) / 14.0::DOUBLE) AS lat
FROM customer""")
def edge_to_edge_grid(t: Tables) -> DataFrame:
    ward = F.col("c_custkey") + 1
    lon, lat = geo.edge_to_edge(geo.grid_row(ward), geo.grid_col(ward), 15)
    return t.base("customer").select(ward.alias("ward_id"), lon.alias("lon"), lat.alias("lat"))


_FEATURES = ["impervious_norm", "lst_norm", "rainfall_log", "pm25_log", "pop_log", "area_norm", "industrial_weight",
             "lon_norm", "lat_norm", "heat_proxy", "ndvi", "ndbi", "heat_stress_score", "flood_risk_score"]


@query("P21 P22 P23 D4", "snapshots", " ".join(_FEATURES), """
SELECT ward_id, snapshot_ts, impervious_norm, lst_norm, rainfall_log, pm25_log, pop_log, 0.5 AS area_norm,
       industrial_weight, 0.5 AS lon_norm, 0.5 AS lat_norm, lst_norm AS heat_proxy, ndvi, ndbi,
       least(greatest(lst_norm * 100.0, 0.0), 100.0) AS heat_stress_score,
       least(greatest(rainfall_log * 30.0, 0.0), 100.0) AS flood_risk_score
FROM (SELECT *, least(greatest(impervious_pct, 0.0), 100.0) / 100.00000001::DOUBLE AS impervious_norm,
             (least(greatest(lst_celsius, 20.0), 50.0) - 20.0) / 30.00000001::DOUBLE AS lst_norm,
             ln(greatest(rainfall_mm_24h, 0.0) + 0.1) / 6.0 AS rainfall_log,
             ln(greatest(pm25_ugm3, 0.0) + 0.1) / 6.0 AS pm25_log,
             ln(greatest(population_density, 0.0) + 0.1) / 12.0 AS pop_log FROM snapshots)""")
def normalised_snapshots(t: Tables) -> DataFrame:
    return history.normalise_snapshot(t.snapshots).select("ward_id", "snapshot_ts", *_FEATURES)


@query("P24", "ward_features", "c0 c1 c2 c3 c4 c5 c6", """
SELECT ward_id, (ndvi + 1.0) / 2.00000001::DOUBLE AS c0, 1.0 / 2.00000001::DOUBLE AS c1,
       least(greatest(impervious_pct / 100.00000001::DOUBLE, 0.0), 1.0) AS c2,
       ln(greatest(rainfall_mm_24h, 0.0) + 0.1) / 6.0 AS c3, ln(greatest(coalesce(pm25_ugm3, 40.0), 0.0) + 0.1) / 6.0 AS c4,
       ln(greatest(population_density, 0.0) + 0.1) / 12.0 AS c5,
       least(greatest((lst_celsius - 20.0) / 30.00000001::DOUBLE, 0.0), 1.0) AS c6
FROM ward_features""")
def ward_channels(t: Tables) -> DataFrame:
    channels = history.ward_channels(t.ward_features)
    return channels.select("ward_id", *[F.get("channels", F.lit(i)).alias(f"c{i}") for i in range(7)])


@query("P25 P26", "wards", "haversine_km planar_km", """
SELECT ward_id,
       2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(12.97 - centroid_lat) / 2), 2)
         + cos(radians(centroid_lat)) * cos(radians(12.97)) * pow(sin(radians(77.59 - centroid_lon) / 2), 2))))
         AS haversine_km,
       sqrt(pow((centroid_lon - 77.59) * (111.0 * cos(radians((SELECT avg(centroid_lat) FROM wards)))), 2)
         + pow((centroid_lat - 12.97) * 111.0, 2)) AS planar_km
FROM wards""")
def distance_to_centre(t: Tables) -> DataFrame:
    mean = t.wards.agg(F.avg("centroid_lat")).scalar()
    lon, lat = F.col("centroid_lon"), F.col("centroid_lat")
    return t.wards.withColumn("mean_lat", mean).select(
        "ward_id", geo.haversine_km(lon, lat, F.lit(77.59), F.lit(12.97)).alias("haversine_km"),
        geo.planar_km(lon, lat, F.lit(77.59), F.lit(12.97), F.col("mean_lat")).alias("planar_km"))


@query("P27 P40 P36", "", "s", """
SELECT event_id, 1.0 / (1.0 + exp(-(value / 10.0 - 2.5))) AS s,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE round(CAST(event_id % 1000 AS DOUBLE), 2) END AS shown,
       CASE event_type WHEN 'error' THEN 'Urban Error' WHEN 'click' THEN 'Urban Click' WHEN 'view' THEN 'Urban View'
            WHEN 'signup' THEN 'Urban Signup' ELSE 'Urban Purchase' END AS title
FROM events""")
def presentation(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).otherwise((F.col("event_id") % 1000).cast("double"))
    return t.base("events").select(
        "event_id", numeric.sigmoid(F.col("value") / 10.0 - 2.5).alias("s"), numeric.present(raw, 2).alias("shown"),
        text.title_case(F.concat(F.lit("urban_"), F.col("event_type"))).alias("title"))


@query("P34 P35 P42 P43 P37", "risks", "heat_layer combined_layer", """
SELECT ward_id, 'CRITICAL: ' || ward_name AS annotation, 'Ward-' || ward_id AS fallback_name,
       'High heat stress in ' || ward_name || ': ' || CAST(round_even(heat_stress_score, 0) AS INTEGER) || '/100'
         AS message,
       CASE WHEN ndvi >= 0.75 THEN 'critical' ELSE 'high' END AS severity,
       CASE WHEN ward_id % 2 = 0 AND risk_level NOT IN ('high', 'low') THEN 'flood'
            WHEN ward_id % 2 = 0 AND risk_level = 'high' THEN 'waterlogging' ELSE risk_level END AS report_type,
       heat_stress_score / 100.0 AS heat_layer, (0.6 * heat_stress_score + 0.4 * flood_risk_score) / 100.0
         AS combined_layer
FROM (SELECT * REPLACE (CASE WHEN ward_id % 2 = 0 AND risk_level = 'low' THEN 'flood' ELSE risk_level END AS risk_level)
      FROM risks)""")
def labels_and_messages(t: Tables) -> DataFrame:
    heat, flood = F.col("heat_stress_score"), F.col("flood_risk_score")
    even = F.col("ward_id") % 2 == 0
    kind = F.when(even & (F.col("risk_level") == "low"), "flood").when(
        even & (F.col("risk_level") == "high"), "waterlogging").otherwise(F.col("risk_level"))
    return t.risks.select(
        "ward_id", text.critical_label(F.col("ward_name")).alias("annotation"),
        text.fallback_ward_name(F.lit(None).cast("string"), F.col("ward_id")).alias("fallback_name"),
        text.score_message("High heat stress", F.col("ward_name"), heat).alias("message"),
        risk.citizen_severity(F.col("ndvi")).alias("severity"),
        risk.effective_report_type(kind, even).alias("report_type"),
        risk.layer_score(heat, flood, "heat").alias("heat_layer"),
        risk.layer_score(heat, flood, "combined").alias("combined_layer"))


@query("P39 N6", "", "value", """
SELECT vec_id, i - 1 AS pos, embedding[i]::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding,
         lambda x: x::DOUBLE * x::DOUBLE))), 1e-12) AS value
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def normalised_vectors(t: Tables) -> DataFrame:
    unit = t.base("embeddings").select("vec_id", numeric.l2_normalise(F.col("embedding")).alias("v"))
    return nested.explode_vector(unit, "vec_id", "v").select("vec_id", F.col("pos").cast("bigint").alias("pos"), "value")


@query("F3 F4 F5 F6 F8", "scores", "heat_stress_score", """
SELECT ward_id, heat_stress_score, risk_level FROM scores
WHERE risk_level = 'high' AND heat_stress_score >= 40 AND impervious_pct BETWEEN 45 AND 90
  AND ward_id IN (SELECT c_custkey + 1 FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
  AND ward_id NOT IN (SELECT s_suppkey + 1 FROM supplier)""")
def filtered_wards(t: Tables) -> DataFrame:
    segment = filters.any_of(t.base("customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])
    chosen = segment.select((F.col("c_custkey") + 1).alias("ward_id"))
    excluded = t.base("supplier").select((F.col("s_suppkey") + 1).alias("ward_id"))
    rows = filters.at_least(filters.equals_if(t.scores, "risk_level", "high"), "heat_stress_score", 40.0)
    rows = filters.in_range(rows, "impervious_pct", 45, 90)
    rows = filters.without_ids(filters.only_ids(rows, chosen), excluded)
    return rows.select("ward_id", "heat_stress_score", "risk_level")


@query("F11", "runs", "metric_value", """
SELECT run_id, run_name, metric_name, metric_value, logged_at FROM runs
WHERE run_name LIKE 'st\\_gnn%' ESCAPE '\\' AND metric_name IN ('val_heat_rmse', 'val_flood_rmse')
  AND logged_at > TIMESTAMP '2001-08-01 00:00:00' - INTERVAL '700 days'""")
def training_curves(t: Tables) -> DataFrame:
    start = F.to_timestamp_ntz(F.lit("2001-08-01 00:00:00")) - F.expr("INTERVAL 700 days")
    curves = filters.metric_filter(t.runs, "st_gnn", ["val_heat_rmse", "val_flood_rmse"])
    return curves.filter(F.col("logged_at") > start).select(
        "run_id", "run_name", "metric_name", "metric_value", "logged_at")


@query("F7 S11 L8 U1", "", "cloud_cover", """
WITH scenes AS (
  SELECT 'LC08-' || o_orderkey AS scene_id, o_orderkey AS k, o_orderdate AS d, o_custkey AS c FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT 'LC09-' || o_orderkey, o_orderkey, o_orderdate, o_custkey FROM orders WHERE o_orderkey % 2 = 1),
found AS (
  SELECT scene_id, CAST(d AS DATE) AS acquired, CAST(k % 100 AS DOUBLE) AS cloud_cover FROM scenes
  WHERE 76.0 + (c % 30) * 0.1::DOUBLE <= 77.82 AND 77.0 + (c % 30) * 0.1::DOUBLE >= 77.35 AND k % 100 < 30)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY acquired ORDER BY cloud_cover, scene_id) AS rn FROM found)
WHERE rn = 1 AND acquired >= DATE '1996-01-01' AND acquired < DATE '2000-01-01'""")
def clearest_scenes(t: Tables) -> DataFrame:
    """Two collections united, searched by box, dates and cloud; the clearest scene of each day."""
    from ..operators.sets import union_tables
    from ..sources.rasters import least_cloudy, search_scenes

    def collection(prefix: str, parity: int) -> DataFrame:
        west = F.lit(76.0) + F.col("o_custkey") % 30 * 0.1
        return t.base("orders").filter(F.col("o_orderkey") % 2 == parity).select(
            F.concat(F.lit(prefix), F.col("o_orderkey").cast("string")).alias("scene_id"),
            F.to_date("o_orderdate").alias("acquired"), west.alias("west"),
            (F.lit(77.0) + F.col("o_custkey") % 30 * 0.1).alias("east"), F.lit(12.0).alias("south"),
            F.lit(14.0).alias("north"), (F.col("o_orderkey") % 100).cast("double").alias("cloud_cover"))

    found = search_scenes(union_tables(collection("LC08-", 0), collection("LC09-", 1)), geo.SERVICE_BBOX,
                          "1996-01-01", "2000-01-01")
    return least_cloudy(found, ["acquired"]).select("scene_id", "acquired", "cloud_cover", F.lit(1).cast("bigint").alias("rn"))


@query("F14", "runs", "metric_value", """
SELECT run_id, metric_value, CASE WHEN metric_name = 'ep_reward_mean' THEN metric_value > 50000
       ELSE metric_value < 50000 END AS passes FROM runs""")
def metric_gates(t: Tables) -> DataFrame:
    passes = risk.metric_passes(F.col("metric_value"), F.lit(50000.0), F.col("metric_name") == "ep_reward_mean")
    return t.runs.select("run_id", "metric_value", passes.alias("passes"))
