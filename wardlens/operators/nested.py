"""Nested records, vectors and GeoJSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


# Spark's default JSON timestamps stop at milliseconds.
JSON_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def to_record(df: DataFrame, name: str = "value") -> DataFrame:
    return df.select(F.to_json(F.struct("*"), JSON_TIMES).alias(name))


def from_record(df: DataFrame, ddl: str, name: str = "value") -> DataFrame:
    return df.select(F.from_json(name, ddl, JSON_TIMES).alias("r")).select("r.*")


def explode_vector(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(key, F.posexplode(vector).alias("pos", "value"))


def assemble_vector(df: DataFrame, key: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """Inverse of ``explode_vector``; a vector's length bounds the list."""
    cells = F.array_sort(F.collect_list(F.struct(pos, value)))
    return df.groupBy(key).agg(F.transform(cells, lambda c: c[value]).alias("vector"))


def wide_snapshot(df: DataFrame, index: str, ward_ids: list[int], value: str) -> DataFrame:
    """One row per snapshot with a column per ward, for a stated (hence bounded) list of wards."""
    return df.filter(F.col("ward_id").isin(ward_ids)).groupBy(index).pivot("ward_id", ward_ids).agg(F.first(value))


def rectangle(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Closed ring of a box, counter-clockwise from the south-west corner."""
    corners = ((west, south), (east, south), (east, north), (west, north), (west, south))
    return F.array(*[F.array(lon, lat) for lon, lat in corners])


def box_around(lon: Column, lat: Column, half: float = 0.009) -> Column:
    return rectangle(
        F.round(lon - half, 5), F.round(lat - half, 5), F.round(lon + half, 5), F.round(lat + half, 5)
    )


def point_geometry(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def polygon_geometry(ring: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))


def feature(geometry: Column, properties: list[str]) -> Column:
    return F.struct(
        F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")
    )


def feature_collection_lines(df: DataFrame, geometry: str, order: str) -> DataFrame:
    """A FeatureCollection as ordered lines (part, pos, line), so that no task holds the whole document.

    Lines in (part, pos) order concatenate to one valid document: an opening line, one line per feature, a closing line.
    Every feature but the first starts with its separating comma. ``order`` must be unique.
    """
    first = df.agg(F.min(order)).scalar()
    properties = [c for c in df.columns if c != geometry]
    body = F.to_json(feature(F.col(geometry), properties), {"ignoreNullFields": "false"})
    comma = F.when(F.col(order) == first, F.lit("")).otherwise(F.lit(","))
    features = df.select(
        F.lit(1).alias("part"), F.col(order).cast("bigint").alias("pos"), F.concat(comma, body).alias("line")
    )
    frame = df.sparkSession.createDataFrame(
        [(0, 0, '{"type":"FeatureCollection","features":['), (2, 0, "]}")], "part INT, pos BIGINT, line STRING"
    )
    return frame.unionByName(features)
