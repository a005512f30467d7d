"""Polygons as quadtree covers: inner cells need no test, border cells hold the few edges that pass them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

# Cells are 2^level degrees wide; levels are multiples of _STEP, so a split makes 8 x 8 cells and few levels occur.
_STEP = 3
_SIDE = 1 << _STEP
_EDGES = 16  # a cell with more edges is split, at most _SPLITS times below the cell as wide as the ring
_SPLITS = 6
_LEAST_DEGREES = 1e-9  # rings count as this wide at least

_EDGE = pa.struct([(n, pa.float64()) for n in ("x", "y", "top", "slope")])
_CELL = pa.schema([
    ("level", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("feature_order", pa.int64()), ("ward", pa.int64()),
    ("low_lon", pa.float64()), ("low_lat", pa.float64()), ("high_lon", pa.float64()), ("high_lat", pa.float64()),
    ("east", pa.float64()), ("odd", pa.bool_()), ("sides", pa.list_(pa.float64())), ("edges", pa.list_(_EDGE))])
_CELL_SQL = (
    "level int, x long, y long, feature_order long, ward long, low_lon double, low_lat double, high_lon double, "
    "high_lat double, east double, odd boolean, sides array<double>, "
    "edges array<struct<x: double, y: double, top: double, slope: double>>")


def _edges(ring: list) -> np.ndarray:
    """(x, y, x before, y before) of every vertex and its predecessor."""
    points = np.array(ring, float).reshape(-1, 2)
    return np.hstack([points, np.roll(points, 1, axis=0)])


def _crossings(edges: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """(latitudes x edges): the longitude where each edge meets each latitude, NaN where it does not."""
    x, y, before, top = edges.T
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (before - x) / (top - y)
        at = slope * (lat[:, None] - y) + x
    return np.where((y > lat[:, None]) != (top > lat[:, None]), at, np.nan)


def _sides(edges: np.ndarray, east: float, south: float, north: float) -> np.ndarray:
    """Latitudes where the edges cross a cell's eastern side."""
    x, y, before, top = edges.T
    cut = (x > east) != (before > east)
    at = y[cut] + (east - x[cut]) * (top[cut] - y[cut]) / (before[cut] - x[cut])
    return at[(at >= south) & (at < north)]


class _Cell:
    """A cell with the edges that pass it and whether its north-eastern corner is inside (``odd``)."""

    def __init__(self, level: int, x: int, y: int, edges: np.ndarray, odd: bool) -> None:
        self.level, self.x, self.y, self.edges, self.odd = level, x, y, edges, odd
        size = 2.0**level
        self.west, self.south, self.east, self.north = x * size, y * size, (x + 1) * size, (y + 1) * size
        self.sides = _sides(edges, self.east, self.south, self.north)

    def inside(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """Parity of points in the cell: along the latitude to the eastern side, then along that to the corner."""
        at = _crossings(self.edges, lat)
        with np.errstate(invalid="ignore"):
            met = ((at > lon[:, None]) & (at <= self.east)).sum(axis=1) + (self.sides > lat[:, None]).sum(axis=1)
        return (met + self.odd) % 2 == 1

    def split(self) -> Iterator[_Cell]:
        """The 8 x 8 cells inside, each with the edges that pass it."""
        level, size = self.level - _STEP, 2.0 ** (self.level - _STEP)
        x, y, before, top = self.edges.T
        low, high = np.minimum(y, top), np.maximum(y, top)
        east = self.west + size * np.arange(1, _SIDE + 1)
        for row in range(_SIDE):
            south = self.south + row * size
            north = south + size
            # the corners of the row, just below its northern line where that is the cell's own
            lat = np.full(_SIDE, north if row < _SIDE - 1 else np.nextafter(north, south))
            odd = self.inside(np.where(east < self.east, east, np.nextafter(self.east, self.west)), lat)
            touched = np.flatnonzero((high >= south) & (low <= north))
            with np.errstate(divide="ignore", invalid="ignore"):
                share = [np.clip((v - y[touched]) / (top[touched] - y[touched]), 0.0, 1.0) for v in (south, north)]
            flat = y[touched] == top[touched]
            ends = [np.where(flat, k, s) for k, s in enumerate(share)]
            at = [x[touched] + e * (before[touched] - x[touched]) for e in ends]
            first = np.floor((np.minimum(*at) - self.west) / size - 1e-6)
            last = np.floor((np.maximum(*at) - self.west) / size + 1e-6)
            for column in range(_SIDE):
                own = touched[(first <= column) & (last >= column)]
                yield _Cell(level, self.x * _SIDE + column, self.y * _SIDE + row, self.edges[own], bool(odd[column]))


def _parity(edges: np.ndarray, lon: float, lat: float) -> bool:
    at = _crossings(edges, np.array([lat]))[0]
    return int(np.nansum(at > lon)) % 2 == 1


def cells_of(ring: list | None) -> Iterator[_Cell]:
    """The cells of a ring's cover. Cells without edges are wholly inside; cells outside are left out."""
    if not ring:
        return
    edges = _edges(ring)
    if len(edges) < 3 or not np.isfinite(edges).all():
        return
    low, high = edges[:, :2].min(axis=0), edges[:, :2].max(axis=0)
    top = _STEP * int(np.ceil(np.log2(max(*(high - low), _LEAST_DEGREES)) / _STEP))
    size = 2.0**top
    todo: list[_Cell] = []
    for x in range(int(np.floor(low[0] / size)), int(np.floor(high[0] / size)) + 1):
        for y in range(int(np.floor(low[1] / size)), int(np.floor(high[1] / size)) + 1):
            todo.append(_Cell(top, x, y, edges, _parity(edges, (x + 1) * size, (y + 1) * size)))
    while todo:
        cell = todo.pop()
        if len(cell.edges) > _EDGES and cell.level > top - _SPLITS * _STEP:
            todo += [c for c in cell.split() if len(c.edges) or c.odd]
        elif len(cell.edges) or cell.odd:
            yield cell


def _box(ring: list) -> list[float]:
    """West, south, east and north ends of a ring, with room for the rounding of a crossing's longitude."""
    points = np.array(ring, float).reshape(-1, 2)
    low, high = points.min(axis=0), points.max(axis=0)
    room = 1e-9 * np.maximum(np.abs(low), np.abs(high))
    return [*(low - room).tolist(), *(high + room).tolist()]


def polygon_cells(polygons: DataFrame) -> DataFrame:
    """The covers of all ``polygons`` (feature_order, ward_id, ring), one row a cell, stored.

    A ring is covered where it lies: cells start as wide as the ring and are split where more than 16 edges pass, so
    the inside of a ring of many vertices is a few large cells and its border many small ones. Each has the ring's box.
    Rings are dealt to tasks anew, since few bytes of a file may hold many.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in held], f.type) for k, f in enumerate(list(_CELL)[:-1])]
            edges = np.concatenate([r[-1] for r in held])
            with np.errstate(divide="ignore", invalid="ignore"):
                slope = (edges[:, 2] - edges[:, 0]) / (edges[:, 3] - edges[:, 1])
            flat = pa.StructArray.from_arrays(
                [pa.array(v) for v in (edges[:, 0], edges[:, 1], edges[:, 3])]
                + [pa.array(slope, mask=edges[:, 3] == edges[:, 1])], fields=list(_EDGE))
            offsets = np.r_[0, np.cumsum([len(r[-1]) for r in held])]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], schema=_CELL)

        for batch in batches:
            for order, ward, ring in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                box: list[float] = []
                for c in cells_of(ring):
                    box = box or _box(ring)
                    held.append((c.level, c.x, c.y, order, ward, *box, c.east, c.odd, c.sides.tolist(), c.edges))
                    if len(held) == 4096:
                        yield flush()
                        held.clear()
        if held:
            yield flush()

    narrow = polygons.select(
        F.col("feature_order").cast("long").alias("feature_order"), F.col("ward_id").cast("long").alias("ward"),
        F.col("ring").cast("array<array<double>>").alias("ring"))
    return cut_lineage(narrow.repartition(*narrow.columns).mapInArrow(run, _CELL_SQL))


def inside_cell(lon: Column, lat: Column) -> Column:
    """Even-odd test of a point against the cell it lies in: only the cell's own edges and side crossings count.

    Most points of a cell lie outside the ring's box, which is compared before any edge is looked at.
    """
    boxed = lon.between(F.col("low_lon"), F.col("high_lon")) & lat.between(F.col("low_lat"), F.col("high_lat"))

    def crossed(e: Column) -> Column:
        at = e["slope"] * (lat - e["y"]) + e["x"]
        return ((e["y"] > lat) != (e["top"] > lat)) & (lon < at) & (at <= F.col("east"))

    met = F.size(F.filter("edges", crossed)) + F.size(F.filter("sides", lambda y: y > lat)) + F.col("odd").cast("int")
    return boxed & ((F.size("edges") == 0) | (F.pmod(met, F.lit(2)) == 1))
