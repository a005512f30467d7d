"""Rasters, neighbours, polygons, graphs and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import graph, nested, sets, spatial
from ..plans import satellite, wards
from ..session import scratch_path
from ..sinks.rasters import write_bands
from ..sources.rasters import BANDS, bands_to_pixels, complete_scenes, read_band_files
from .formulas import PIXEL_INDEX_SQL
from .registry import query
from .views import Tables

_TILES = """
tiles AS (SELECT CAST(k + 1 AS INTEGER) AS ward_id, CAST(floor((k // 14) * (256 / 15.0::DOUBLE)) AS INTEGER) AS r0,
                 CAST(floor((k // 14 + 1) * (256 / 15.0::DOUBLE)) AS INTEGER) AS r1,
                 CAST(floor((k % 14) * (256 / 14.0::DOUBLE)) AS INTEGER) AS c0,
                 CAST(floor((k % 14 + 1) * (256 / 14.0::DOUBLE)) AS INTEGER) AS c1 FROM range(0, 198) r(k))"""


@query("X1 A2 J12 S7", "pixels", "ndvi ndbi impervious_pct lst_celsius", f"""
WITH {_TILES}
SELECT scene_id, ward_id, avg(ndvi) AS ndvi, avg(ndbi) AS ndbi, avg(impervious_pct) AS impervious_pct,
       avg(lst_celsius) AS lst_celsius, DATE '2024-01-01' AS scene_date
FROM ({PIXEL_INDEX_SQL}) p JOIN tiles ON "row" >= r0 AND "row" < r1 AND col >= c0 AND col < c1
GROUP BY scene_id, ward_id""")
def satellite_features(t: Tables) -> DataFrame:
    return satellite.satellite_features(
        t.pixels, F.lit("2024-01-01").cast("date"), F.lit(256), F.lit(256), keys=["scene_id"])


@query("S7 X1 A2 J12 U1", "pixels", "ndvi ndbi impervious_pct lst_celsius", f"""
WITH {_TILES},
raster AS (SELECT scene_id, "row", col, {", ".join(f"max({b}) AS {b}" for b in BANDS)} FROM pixels GROUP BY ALL)
SELECT scene_id, ward_id, avg(ndvi) AS ndvi, avg(ndbi) AS ndbi, avg(impervious_pct) AS impervious_pct,
       avg(lst_celsius) AS lst_celsius, DATE '2024-01-01' AS scene_date
FROM ({PIXEL_INDEX_SQL.replace("FROM pixels", "FROM raster")}) p
JOIN tiles ON "row" >= r0 AND "row" < r1 AND col >= c0 AND col < c1 GROUP BY scene_id, ward_id""")
def satellite_features_from_files(t: Tables) -> DataFrame:
    """Scenes written as one TIFF file per band, read back strip by strip, and reduced to ward features."""
    path = scratch_path(t.spark, "scenes")
    one_each = t.pixels.groupBy("scene_id", "row", "col").agg(*[F.max(b).alias(b) for b in BANDS])
    write_bands(one_each, path, 256, 256).write.format("noop").mode("overwrite").save()
    samples = read_band_files(t.spark, path)
    whole = samples.join(complete_scenes(samples).select("scene_id"), "scene_id", "left_semi")
    return satellite.satellite_features(
        bands_to_pixels(whole), F.lit("2024-01-01").cast("date"), F.lit(256), F.lit(256), keys=["scene_id"])


@query("J12", "pixels", "", f"""
WITH {_TILES}
SELECT ward_id, count(*) AS pixels FROM pixels JOIN tiles ON "row" >= r0 AND "row" < r1 AND col >= c0 AND col < c1
GROUP BY ward_id""")
def pixels_per_ward(t: Tables) -> DataFrame:
    placed = spatial.pixel_wards(t.pixels, F.lit(256), F.lit(256))
    return placed.groupBy("ward_id").agg(F.count(F.lit(1)).alias("pixels"))


# Brute force over all pairs is only the SQL side's job; the Spark side joins cells.
_KNN = """
knn AS (SELECT * FROM (
  SELECT a.ward_id AS src, b.ward_id AS dst,
         sqrt((b.centroid_lon - a.centroid_lon) * (b.centroid_lon - a.centroid_lon)
            + (b.centroid_lat - a.centroid_lat) * (b.centroid_lat - a.centroid_lat)) AS distance,
         CAST(row_number() OVER (PARTITION BY a.ward_id ORDER BY
            sqrt((b.centroid_lon - a.centroid_lon) * (b.centroid_lon - a.centroid_lon)
            + (b.centroid_lat - a.centroid_lat) * (b.centroid_lat - a.centroid_lat)), b.ward_id) AS INTEGER) AS rank
  FROM wards a JOIN wards b ON a.ward_id != b.ward_id AND abs(a.centroid_lon - b.centroid_lon) < 0.4
                            AND abs(a.centroid_lat - b.centroid_lat) < 0.4) WHERE rank <= 6)"""
_NEAR = """
near AS (SELECT * FROM (
  SELECT a.ward_id AS src, b.ward_id AS dst,
         sqrt(pow((a.centroid_lon - b.centroid_lon) * (111.0 * cos(radians((SELECT avg(centroid_lat) FROM wards)))), 2)
            + pow((a.centroid_lat - b.centroid_lat) * 111.0, 2)) AS km
  FROM wards a JOIN wards b ON a.ward_id < b.ward_id AND abs(a.centroid_lat - b.centroid_lat) < 0.04
                            AND abs(a.centroid_lon - b.centroid_lon) < 0.1) WHERE km <= 3.5)"""


@query("J7", "wards", "distance", f"WITH {_KNN} SELECT src, dst, distance, rank FROM knn")
def nearest_neighbours(t: Tables) -> DataFrame:
    return spatial.nearest_neighbours(t.nodes, 6)


@query("J7 P25", "wards", "distance", """
SELECT src, dst, distance, rank FROM (
  SELECT src, dst, distance, CAST(row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS INTEGER) AS rank FROM (
    SELECT a.ward_id AS src, b.ward_id AS dst,
           2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.centroid_lat - a.centroid_lat) / 2), 2)
             + cos(radians(a.centroid_lat)) * cos(radians(b.centroid_lat))
             * pow(sin(radians(b.centroid_lon - a.centroid_lon) / 2), 2)))) AS distance
    FROM wards a JOIN wards b ON a.ward_id != b.ward_id AND abs(a.centroid_lon - b.centroid_lon) < 0.4
                              AND abs(a.centroid_lat - b.centroid_lat) < 0.4)) WHERE rank <= 4""")
def great_circle_neighbours(t: Tables) -> DataFrame:
    return spatial.nearest_neighbours(t.nodes, 4, "haversine")


@query("J8", "wards", "km", f"WITH {_NEAR} SELECT src, dst, km FROM near")
def pairs_within(t: Tables) -> DataFrame:
    return spatial.pairs_within(t.nodes, 3.5)


@query("J9 P25", "wards", "distance km", f"""
WITH {_KNN}
SELECT src, dst, distance, rank,
       2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.centroid_lat - a.centroid_lat) / 2), 2)
         + cos(radians(a.centroid_lat)) * cos(radians(b.centroid_lat))
         * pow(sin(radians(b.centroid_lon - a.centroid_lon) / 2), 2)))) AS km
FROM knn JOIN wards a ON a.ward_id = src JOIN wards b ON b.ward_id = dst""")
def neighbour_distances(t: Tables) -> DataFrame:
    return spatial.pair_distances(spatial.nearest_neighbours(t.nodes, 6), t.nodes)


EDGES = f"""
{_KNN}, {_NEAR},
half AS (SELECT src, dst FROM knn UNION ALL SELECT src, dst FROM near),
edges AS (SELECT src, dst FROM half UNION SELECT dst, src FROM half),
weighted AS (
  SELECT src, dst, 1.0 / greatest(sqrt(
    pow((a.centroid_lon - b.centroid_lon) * (111.0 * cos(radians((SELECT avg(centroid_lat) FROM wards)))), 2)
    + pow((a.centroid_lat - b.centroid_lat) * 111.0, 2)), 0.01) AS w
  FROM edges JOIN wards a ON a.ward_id = src JOIN wards b ON b.ward_id = dst),
graph AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS weight FROM weighted)"""


@query("X10 U2 P26 W9", "wards", "weight", f"WITH {EDGES} SELECT src, dst, weight FROM graph")
def ward_graph(t: Tables) -> DataFrame:
    return graph.ward_graph(t.nodes)


@query("A18", "wards", "mean_degree", f"""
WITH {EDGES}, d AS (SELECT src, count(*) AS degree FROM graph GROUP BY src)
SELECT count(*) AS nodes, CAST(sum(degree) AS BIGINT) AS edges, min(degree) AS min_degree, max(degree) AS max_degree,
       avg(degree) AS mean_degree, quantile_disc(degree, 0.5) AS median_degree FROM d""")
def degree_stats(t: Tables) -> DataFrame:
    return graph.degree_stats(graph.build_edges(t.nodes))


@query("J17", "wards scores", "heat_stress_score flood_risk_score", f"""
WITH {EDGES},
g AS (SELECT dst, sum(weight * heat_stress_score) / count(*) AS h, sum(weight * flood_risk_score) / count(*) AS f
      FROM graph JOIN scores ON ward_id = src GROUP BY dst)
SELECT ward_id, coalesce(h, 0.0) + s.heat_stress_score AS heat_stress_score,
       coalesce(f, 0.0) + s.flood_risk_score AS flood_risk_score
FROM scores s LEFT JOIN g ON dst = ward_id""")
def neighbour_means(t: Tables) -> DataFrame:
    return graph.neighbour_mean(graph.ward_graph(t.nodes), t.scores, ["heat_stress_score", "flood_risk_score"],
                                residual=True)


@query("X11 J17", "wards scores", "heat_stress_score", f"""
WITH {EDGES},
one AS (SELECT dst AS ward_id, sum(weight * heat_stress_score) / count(*) AS h FROM graph JOIN scores ON ward_id = src GROUP BY 1),
two AS (SELECT dst AS ward_id, sum(weight * h) / count(*) AS h FROM graph JOIN one ON ward_id = src GROUP BY 1)
SELECT s.ward_id, coalesce(h, 0.0) AS heat_stress_score FROM scores s LEFT JOIN two USING (ward_id)""")
def propagated_features(t: Tables) -> DataFrame:
    return graph.propagate(graph.ward_graph(t.nodes), t.scores, ["heat_stress_score"], 2)


@query("U2", "", "", """
WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)
SELECT src, dst FROM e UNION SELECT dst, src FROM e UNION SELECT c_custkey + 1, c_custkey + 1 FROM customer""")
def symmetric_edges(t: Tables) -> DataFrame:
    edges = t.base("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return sets.symmetric_edges(edges, t.wards)


def _cells(t: Tables) -> DataFrame:
    """A diamond polygon around every ward site, large enough to overlap its neighbours."""
    lon, lat, r = F.col("centroid_lon"), F.col("centroid_lat"), F.lit(0.0151237)
    ring = F.array(F.array(lon - r, lat), F.array(lon, lat - r), F.array(lon + r, lat), F.array(lon, lat + r),
                   F.array(lon - r, lat))
    return t.wards.select(
        F.col("ward_id").alias("feature_order"), "ward_id", ring.alias("ring"))


@query("J13", "wards reports", "", """
WITH p AS (SELECT id, latitude + (id % 700) * 0.0003::DOUBLE AS lat, longitude + (id % 1300) * 0.0011::DOUBLE AS lon FROM reports),
poly AS (SELECT ward_id, centroid_lon AS x, centroid_lat AS y FROM wards)
SELECT p.id, min(poly.ward_id) AS ward_id FROM p LEFT JOIN poly
  ON abs(p.lon - poly.x) + abs(p.lat - poly.y) < 0.0151237::DOUBLE GROUP BY p.id""")
def located_reports(t: Tables) -> DataFrame:
    """Reports spread over the sites and located in overlapping diamonds (inside: |dx| + |dy| < r)."""
    points = t.reports.select(
        "id", (F.col("latitude") + F.col("id") % 700 * 0.0003).alias("lat"),
        (F.col("longitude") + F.col("id") % 1300 * 0.0011).alias("lon"))
    return spatial.locate_points(points, _cells(t), "id").select("id", "ward_id")


@query("N3 P17", "", "west south east north", """
SELECT ward_id, 5 AS vertices, 77.45 + c * dx AS west, 12.83 + r * dy AS south, 77.45 + c * dx + dx AS east,
       12.83 + r * dy + dy AS north
FROM (SELECT c_custkey + 1 AS ward_id, c_custkey // 14 AS r, c_custkey % 14 AS c,
             (77.78::DOUBLE - 77.45::DOUBLE) / 14 AS dx, (13.14::DOUBLE - 12.83::DOUBLE) / 15 AS dy FROM customer)""")
def ward_cells(t: Tables) -> DataFrame:
    ids = t.base("customer").select((F.col("c_custkey") + 1).alias("ward_id"))
    ring = wards.ward_cells(wards.describe_wards(ids))
    return ring.select(
        "ward_id", F.size("ring").alias("vertices"), F.col("ring")[0][0].alias("west"), F.col("ring")[0][1].alias("south"),
        F.col("ring")[2][0].alias("east"), F.col("ring")[2][1].alias("north"))


@query("N4 X18 N3", "risks", "", """
SELECT ward_id, CASE WHEN ward_id = (SELECT min(ward_id) FROM risks) THEN '' ELSE ',' END
  || '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (ward_id % 180) || '.5,' || (ward_id % 90)
  || '.25]},"properties":{"ward_id":' || ward_id || ',"ward_name":"' || ward_name || '","risk_level":"' || risk_level
  || '"}}' AS line FROM risks""")
def feature_lines(t: Tables) -> DataFrame:
    """The feature lines of the GeoJSON export."""
    point = nested.point_geometry((F.col("ward_id") % 180 + 0.5).cast("double"), (F.col("ward_id") % 90 + 0.25).cast("double"))
    rows = t.risks.select("ward_id", "ward_name", "risk_level").withColumn("geometry", point)
    lines = nested.feature_collection_lines(rows, "geometry", "ward_id")
    return lines.filter(F.col("part") == 1).select(F.col("pos").alias("ward_id"), "line")


@query("X18 N3 N4", "risks", "west south east north", """
SELECT ward_id, 'Polygon' AS kind, round(lon - 0.009, 5) AS west, round(lat - 0.009, 5) AS south,
       round(lon + 0.009, 5) AS east, round(lat + 0.009, 5) AS north
FROM (SELECT ward_id, 77.35 + (77.82::DOUBLE - 77.35::DOUBLE) * (((ward_id - 1) % 14) / 13.0::DOUBLE) AS lon,
             12.77 + (13.18::DOUBLE - 12.77::DOUBLE) * (((ward_id - 1) // 14) / 14.0::DOUBLE) AS lat FROM risks)""")
def live_ward_boxes(t: Tables) -> DataFrame:
    ring = F.get("geometry.coordinates", F.lit(0))
    return wards.live_ward_boxes(t.risks).select(
        "ward_id", F.col("geometry.type").alias("kind"), ring[0][0].alias("west"), ring[0][1].alias("south"),
        ring[2][0].alias("east"), ring[2][1].alias("north"))
