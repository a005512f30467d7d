"""Pixel tables, scene catalogue search and ward geometry files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geo import BBox
from .tiff import read_pixels, read_samples

# The bands a scene needs.
BANDS = ("b2", "b3", "b4", "b5", "b6", "b7", "b10")


def bands_to_pixels(samples: DataFrame) -> DataFrame:
    """Long samples (scene_id, row, col, band, dn) to one row per pixel with a column per band."""
    return samples.groupBy("scene_id", "row", "col").pivot("band", list(BANDS)).agg(F.first("dn"))


def read_band_files(spark: SparkSession, path: str, group_bytes: int = 4 << 20) -> DataFrame:
    """Long samples (scene_id, row, col, band, dn) of ``<scene>_<BAND>.tif`` files; 0 is no data and left out."""
    named = F.regexp_extract("file", r"(?i)^(.+)_(B[0-9]+)\.tiff?$", 1)
    band = F.lower(F.regexp_extract("file", r"(?i)^(.+)_(B[0-9]+)\.tiff?$", 2))
    return read_samples(spark, path, group_bytes).filter("value <> 0").select(
        named.alias("scene_id"), "row", "col", band.alias("band"), F.col("value").cast("int").alias("dn")).filter("band <> ''")


def read_image_files(spark: SparkSession, path: str, group_bytes: int = 4 << 20) -> DataFrame:
    """Pixels (image_id, x, y, r, g, b, height, width) of RGB TIFF files; image_id is the file's name without its end."""
    image = F.regexp_extract("file", r"(?i)^(.+)\.tiff?$", 1)
    place = [image.alias("image_id"), F.col("col").alias("x"), F.col("row").alias("y")]
    colours = [F.get("samples", F.lit(k)).cast("int").alias(c) for k, c in enumerate("rgb")]
    single, shared = (
        read_pixels(spark, path, names, group_bytes).select(*place, *colours, "height", "width") for names in ("single", "shared"))
    # the pixels of files in several folders that share their name are one image's
    met = shared.groupBy("image_id", "x", "y", "height", "width").agg(*[F.max(c).alias(c) for c in "rgb"])
    return single.unionByName(met)


def complete_scenes(samples: DataFrame) -> DataFrame:
    """Scenes that have every band (long samples)."""
    known = samples.filter(F.col("band").isin(*BANDS))
    # distinct bands per scene are a 7-bit set, so the state stays tiny however many pixels a scene has
    return (
        known.groupBy("scene_id")
        .agg(*[F.max((F.col("band") == b).cast("int")).alias(b) for b in BANDS])
        .select("scene_id", sum((F.col(b) for b in BANDS[1:]), F.col(BANDS[0])).alias("band_count"))
        .filter(F.col("band_count") == len(BANDS))
    )


def search_scenes(
    catalogue: DataFrame, box: BBox, start, end, max_cloud: float = 30.0
) -> DataFrame:
    """Scenes whose box meets ``box``, acquired in [start, end), with less cloud than ``max_cloud``."""
    overlaps = (
        (F.col("west") <= box.east) & (F.col("east") >= box.west)
        & (F.col("south") <= box.north) & (F.col("north") >= box.south)
    )
    return catalogue.filter(
        overlaps & (F.col("acquired") >= F.lit(start)) & (F.col("acquired") < F.lit(end))
        & (F.col("cloud_cover") < max_cloud)
    )


def least_cloudy(scenes: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The clearest scene (per group when given); scene_id breaks ties."""
    best = F.min_by(F.struct(*scenes.columns), F.struct("cloud_cover", "scene_id")).alias("best")
    return scenes.groupBy(*(group or [])).agg(best).filter(F.col("best").isNotNull()).select("best.*")


FEATURE_DDL = (
    "STRUCT<type: STRING, geometry: STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>, "
    "properties: STRUCT<ward_id: INT, ward_code: STRING, ward_name: STRING, centroid_lon: DOUBLE, "
    "centroid_lat: DOUBLE>>"
)
FEATURE_COLLECTION_DDL = f"features ARRAY<{FEATURE_DDL}>"


def read_ward_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of a FeatureCollection: position, id, names, centroid and outer ring."""
    doc = spark.read.schema(FEATURE_COLLECTION_DDL).option("multiLine", True).json(path)
    return doc.select(F.posexplode("features").alias("feature_order", "f")).select(
        "feature_order",
        "f.properties.*",
        F.col("f.geometry.type").alias("geometry_type"),
        F.get(F.col("f.geometry.coordinates"), F.lit(0)).alias("ring"),
    )


def read_ward_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features of a document that ``sinks.files.export`` wrote line by line; any number of tasks reads it."""
    feature = F.from_json(F.regexp_replace("value", "^,", ""), FEATURE_DDL)
    return spark.read.text(path).select(feature.alias("f")).filter(F.col("f.type") == "Feature").select(
        "f.properties.*",
        F.col("f.geometry.type").alias("geometry_type"),
        F.get(F.col("f.geometry.coordinates"), F.lit(0)).alias("ring"),
    )


def ward_coordinates(features: DataFrame) -> DataFrame:
    return features.select("ward_id", F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat"))
