"""Distances and the two ward-grid conventions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0
PLANAR_KM_PER_DEGREE = 111.0
AREA_KM_PER_DEGREE = 111.32


@dataclass(frozen=True)
class BBox:
    west: float
    south: float
    east: float
    north: float


# The city's catalogue box (cell centres) and the wider service box (edge-to-edge grid, validation).
CITY_BBOX = BBox(77.45, 12.83, 77.78, 13.14)
SERVICE_BBOX = BBox(77.35, 12.77, 77.82, 13.18)
GRID_COLUMNS = 14
WARD_COUNT = 198

# The 34 ward name seeds, reused in cycles.
WARD_NAME_SEEDS = (
    "Kempegowda", "Chickpet", "Shivajinagar", "Ulsoor", "Malleshwaram", "Rajajinagar", "Basavanagudi", "Jayanagar",
    "BTM Layout", "Koramangala", "HSR Layout", "Bommanahalli", "Bellandur", "Marathahalli", "Whitefield", "KR Puram",
    "Hebbal", "Yelahanka", "Sahakar Nagar", "Vidyaranyapura", "Peenya", "Mahalakshmipuram", "Vijayanagar",
    "Govindraj Nagar", "Nagarbhavi", "Kengeri", "RR Nagar", "Padmanabhanagar", "Banashankari", "JP Nagar",
    "Hongasandra", "Begur", "Singasandra", "Bilekahalli",
)


def grid_row(ward_id: Column, columns: int = GRID_COLUMNS) -> Column:
    return F.floor((ward_id - 1) / columns).cast("int")


def grid_col(ward_id: Column, columns: int = GRID_COLUMNS) -> Column:
    return F.pmod(ward_id - 1, F.lit(columns)).cast("int")


def grid_rows(count: int, columns: int = GRID_COLUMNS) -> int:
    return -(-count // columns)


def ward_code(ward_id: Column) -> Column:
    """Three digits at least; longer ids are kept whole."""
    text = ward_id.cast("string")
    return F.concat(F.lit("BBMP-"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))


def ward_name(ward_id: Column) -> Column:
    seeds = F.array(*[F.lit(s) for s in WARD_NAME_SEEDS])
    position = F.pmod(ward_id - 1, F.lit(len(WARD_NAME_SEEDS))).cast("int") + 1
    cycle = F.floor((ward_id - 1) / len(WARD_NAME_SEEDS)).cast("int") + 1
    seed = F.element_at(seeds, position)
    return F.when(cycle == 1, seed).otherwise(F.concat_ws(" ", seed, cycle.cast("string")))


def cell_centre(row: Column, col: Column, rows: int, columns: int = GRID_COLUMNS, box: BBox = CITY_BBOX):
    """(lon, lat) of the centre of a grid cell, 6 decimals."""
    dx = (box.east - box.west) / columns
    dy = (box.north - box.south) / rows
    lon = F.round(F.lit(box.west) + (col + 0.5) * F.lit(dx), 6)
    lat = F.round(F.lit(box.south) + (row + 0.5) * F.lit(dy), 6)
    return lon, lat


def edge_to_edge(row: Column, col: Column, rows: int, columns: int = GRID_COLUMNS, box: BBox = SERVICE_BBOX):
    """(lon, lat) with the first and last grid line on the box edges."""
    lat = F.lit(box.south) + F.lit(box.north - box.south) * (row / max(rows - 1, 1))
    lon = F.lit(box.west) + F.lit(box.east - box.west) * (col / max(columns - 1, 1))
    return lon, lat


def cell_area_km2(rows: int, columns: int = GRID_COLUMNS, box: BBox = CITY_BBOX) -> Column:
    dy = (box.north - box.south) / rows
    dx = (box.east - box.west) / columns
    mid = F.radians(F.lit((box.south + box.north) / 2.0))
    return (F.lit(dy) * AREA_KM_PER_DEGREE) * (F.lit(dx) * (F.lit(AREA_KM_PER_DEGREE) * F.cos(mid)))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lon = F.radians(lon2 - lon1) / 2.0
    half_lat = F.radians(lat2 - lat1) / 2.0
    sin_lat, sin_lon = F.sin(half_lat), F.sin(half_lon)
    a = sin_lat * sin_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * sin_lon * sin_lon
    return F.lit(EARTH_RADIUS_KM * 2.0) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def planar_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, mean_lat: Column) -> Column:
    """Equirectangular distance with one longitude scale for the whole node set."""
    dx = (lon1 - lon2) * (F.lit(PLANAR_KM_PER_DEGREE) * F.cos(F.radians(mean_lat)))
    dy = (lat1 - lat2) * F.lit(PLANAR_KM_PER_DEGREE)
    return F.sqrt(dx * dx + dy * dy)


def inside_bbox(lon: Column, lat: Column, box: BBox = SERVICE_BBOX) -> Column:
    return lon.between(box.west, box.east) & lat.between(box.south, box.north)


def ring_edges(ring: Column) -> Column:
    """Edges of a ring of (lon, lat) vertices as struct(x, y, top, slope): each vertex with its predecessor.

    ``x``/``y`` is the vertex, ``top`` the predecessor's latitude, ``slope`` the change of longitude per latitude (null
    for a horizontal edge, which a ray never crosses). Computed once per polygon, not per tested point.
    """
    size = F.size(ring)

    def edge(vertex: Column, i: Column) -> Column:
        before = F.get(ring, F.when(i == 0, size - 1).otherwise(i - 1))
        dlat = F.nullif(before[1] - vertex[1], F.lit(0.0))
        return F.struct(vertex[0].alias("x"), vertex[1].alias("y"), before[1].alias("top"),
                        ((before[0] - vertex[0]) / dlat).alias("slope"))

    return F.transform(ring, edge)


def inside_edges(lon: Column, lat: Column, edges: Column) -> Column:
    """Even-odd ray casting: inside when an odd number of edges lies to the east at the point's latitude."""

    def crossed(e: Column) -> Column:
        return ((e["y"] > lat) != (e["top"] > lat)) & (lon < e["slope"] * (lat - e["y"]) + e["x"])

    return F.pmod(F.size(F.filter(edges, crossed)), F.lit(2)) == 1


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    return inside_edges(lon, lat, ring_edges(ring))
