"""Ward catalogue, geometry and live GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo, risk
from ..operators.nested import box_around, polygon_geometry, rectangle


def ward_catalogue(spark: SparkSession, count: int = geo.WARD_COUNT, columns: int = geo.GRID_COLUMNS) -> DataFrame:
    return describe_wards(spark.range(1, count + 1).select(F.col("id").cast("int").alias("ward_id")), count, columns)


def describe_wards(ids: DataFrame, count: int = geo.WARD_COUNT, columns: int = geo.GRID_COLUMNS) -> DataFrame:
    """Code, name, grid cell, centroid, area and industrial weight derived from the ward id."""
    rows = geo.grid_rows(count, columns)
    placed = ids.withColumn("grid_row", geo.grid_row(F.col("ward_id"), columns)).withColumn(
        "grid_col", geo.grid_col(F.col("ward_id"), columns))
    lon, lat = geo.cell_centre(F.col("grid_row"), F.col("grid_col"), rows, columns)
    return placed.select(
        "*", geo.ward_code(F.col("ward_id")).alias("ward_code"), geo.ward_name(F.col("ward_id")).alias("ward_name"),
        lon.alias("centroid_lon"), lat.alias("centroid_lat"), geo.cell_area_km2(rows, columns).alias("area_km2"),
        risk.industrial_weight(F.col("grid_row"), F.col("grid_col")).alias("industrial_weight"),
    )


def ward_cells(wards: DataFrame, count: int = geo.WARD_COUNT, columns: int = geo.GRID_COLUMNS) -> DataFrame:
    """Cell polygon per ward of the catalogue grid."""
    box = geo.CITY_BBOX
    dx, dy = (box.east - box.west) / columns, (box.north - box.south) / geo.grid_rows(count, columns)
    west = F.lit(box.west) + F.col("grid_col") * dx
    south = F.lit(box.south) + F.col("grid_row") * dy
    return wards.withColumn("ring", rectangle(west, south, west + dx, south + dy)).withColumn(
        "geometry", polygon_geometry(F.col("ring")))


def live_ward_boxes(risks: DataFrame, ward_count: int = geo.WARD_COUNT) -> DataFrame:
    """Ward risks with a box polygon around the edge-to-edge grid position."""
    lon, lat = geo.edge_to_edge(
        geo.grid_row(F.col("ward_id")), geo.grid_col(F.col("ward_id")), geo.grid_rows(ward_count))
    return risks.withColumn("geometry", polygon_geometry(box_around(lon, lat)))
