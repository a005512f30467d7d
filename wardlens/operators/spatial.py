"""Distance joins, point-in-polygon and raster tiles; nearest neighbours are in ``neighbours``.

Every spatial join here is an equi-join on grid cells followed by an exact test.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import GRID_COLUMNS, PLANAR_KM_PER_DEGREE, haversine_km, planar_km
from .cover import inside_cell, polygon_cells
from .neighbours import nearest_neighbours  # noqa: F401 - part of this module's interface



def _neighbour_cells(cells: dict[str, Column]) -> Column:
    """The cell and all that touch it, one struct each."""
    return F.explode(F.array(*[
        F.struct(*[(c + d).alias(name) for (name, c), d in zip(cells.items(), shift)])
        for shift in product((-1, 0, 1), repeat=len(cells))
    ]))


def _used_levels(rows: DataFrame) -> Column:
    """The levels that occur, as an array of a one-row aggregate (a few dozen integers at most)."""
    return rows.agg(F.sort_array(F.collect_set("level"))).scalar()


def pairs_within(nodes: DataFrame, max_km: float = 3.5) -> DataFrame:
    """Pairs src < dst whose planar distance is at most ``max_km``.

    The plane has one longitude scale, that of the mean latitude, and ends at the date line: it is meant for nodes of
    one region. Cells are as wide as the threshold, so candidates stay within a constant factor of the result; AQE
    splits a hot cell. The join is by shuffled cells even where the nodes are few bytes: a node has many pairs, and the
    tasks of a broadcast join would be as few as the files that hold the nodes.
    """
    place = nodes.select(F.col("ward_id").cast("long").alias("id"), "lon", "lat")
    mean_lat = place.agg(F.avg("lat")).scalar()
    lat_size = F.lit(max_km / PLANAR_KM_PER_DEGREE * (1 + 1e-9))
    gridded = place.withColumn("_mean", mean_lat).withColumn("_lon_size", lat_size / F.cos(F.radians("_mean")))
    gridded = gridded.withColumn("x", F.floor(F.col("lon") / F.col("_lon_size"))).withColumn(
        "y", F.floor(F.col("lat") / lat_size))
    left = gridded.select(
        F.col("id").alias("src"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), "_mean",
        _neighbour_cells({"x": F.col("x"), "y": F.col("y")}).alias("c"),
    ).select("src", "lon1", "lat1", "_mean", "c.x", "c.y")
    right = gridded.select(F.col("id").alias("dst"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), "x", "y")
    distance = planar_km(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"), F.col("_mean"))
    near = left.join(right.hint("merge"), ["x", "y"]).filter(F.col("src") < F.col("dst")).withColumn("km", distance)
    return near.filter(F.col("km") <= max_km).select("src", "dst", "km")


def pair_distances(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Great-circle distance of given (src, dst) pairs; no matrix of all pairs is ever formed."""
    a = nodes.select(F.col("ward_id").cast("long").alias("src"), F.col("lon").alias("_o1"), F.col("lat").alias("_a1"))
    b = nodes.select(F.col("ward_id").cast("long").alias("dst"), F.col("lon").alias("_o2"), F.col("lat").alias("_a2"))
    km = haversine_km(F.col("_o1"), F.col("_a1"), F.col("_o2"), F.col("_a2"))
    return pairs.join(a, "src").join(b, "dst").withColumn("km", km).drop("_o1", "_a1", "_o2", "_a2")


def locate_points(points: DataFrame, polygons: DataFrame, point_key: str) -> DataFrame:
    """First polygon (by feature_order) that contains each point: ``points`` + ward_id, null where none does.

    ``points`` has lon, lat and a unique key; ``polygons`` has feature_order, ward_id and ring. Polygons become quadtree
    covers (``cover.polygon_cells``) and points meet them by equality of cells at the few levels that occur. A point in
    an inner cell is inside without any test; in a border cell it is compared with the ring's box, then tested against
    the at most 16 edges that pass the cell, whatever the ring's size.
    """
    cells = polygon_cells(polygons)
    placed = points.withColumn("level", F.explode(_used_levels(cells)))
    size = F.pow(F.lit(2.0), F.col("level"))
    placed = placed.withColumn("x", F.floor(F.col("lon") / size)).withColumn("y", F.floor(F.col("lat") / size))
    # the planner knows the size of the polygons' file at most, not that of their cells
    hits = placed.join(cells.hint("merge"), ["level", "x", "y"]).filter(inside_cell(F.col("lon"), F.col("lat")))
    first = hits.groupBy(point_key).agg(F.min_by("ward", "feature_order").alias("ward_id"))
    kind = polygons.schema["ward_id"].dataType
    return points.join(first.withColumn("ward_id", F.col("ward_id").cast(kind)), point_key, "left")


def pixel_wards(
    pixels: DataFrame, height: Column, width: Column, ward_count: int = 198, columns: int = GRID_COLUMNS
) -> DataFrame:
    """Ward of each pixel by arithmetic on the ward grid; pixels of grid cells beyond the last ward drop out.

    Tile t covers [int(t*d), int((t+1)*d)), d = extent / tiles, so a pixel's tile is the last t with t*d < position + 1.
    The quotient decides that except where t*d is a whole number up to rounding; there the product itself is compared.
    """
    rows = -(-ward_count // columns)
    sized = pixels.withColumns({"_dr": height / F.lit(float(rows)), "_dc": width / F.lit(float(columns))})
    guessed = sized.withColumns({
        "_r": F.floor((F.col("row") + 1) / F.col("_dr") + 1e-9), "_c": F.floor((F.col("col") + 1) / F.col("_dc") + 1e-9),
    })
    r = F.col("_r") - (F.col("_r") * F.col("_dr") >= F.col("row") + 1).cast("int")
    c = F.col("_c") - (F.col("_c") * F.col("_dc") >= F.col("col") + 1).cast("int")
    placed = guessed.withColumn("ward_id", (r * columns + c + 1).cast("int")).drop("_dr", "_dc", "_r", "_c")
    return placed.filter(F.col("ward_id").between(1, ward_count))


def zonal_means(pixels: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean per zone ignoring NaN and null; map-side partials keep the shuffle at one row per zone and task."""
    means = [F.avg(F.nanvl(F.col(v), F.lit(None).cast("double"))).alias(v) for v in values]
    return pixels.groupBy(*keys).agg(*means)
