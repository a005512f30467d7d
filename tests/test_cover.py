"""Quadtree covers of polygons against plain ray casting."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from wardlens.operators import cover, spatial


def plain(ring, lon, lat):
    odd = False
    for k, (x, y) in enumerate(ring):
        before, top = ring[k - 1]
        if (y > lat) != (top > lat) and lon < (before - x) / (top - y) * (lat - y) + x:
            odd = not odd
    return odd


def star(rng, n, rough, centre=(0.3, -0.2), radius=1.0):
    def at(k):
        reach = radius * (1 + rough * rng.uniform(-1, 1))
        return [centre[0] + math.cos(2 * math.pi * k / n) * reach, centre[1] + math.sin(2 * math.pi * k / n) * reach]

    return [at(k) for k in range(n)]


RNG = random.Random(7)
RINGS = {
    "pentagon": star(RNG, 5, 0.4), "star": star(RNG, 60, 0.9), "rough": star(RNG, 1500, 0.4), "round": star(RNG, 4000, 0.001),
    "crossing itself": [[RNG.random(), RNG.random()] for _ in range(80)],
    "closed square": [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]], "u": [[0, 0], [4, 0], [4, 4], [3, 4], [3, 1], [1, 1], [1, 4], [0, 4]],
    "comb": [[0.0, 0.0], *[[k / 200 + (k % 2) * 1e-4, 1.0 if k % 2 else 0.1] for k in range(200)], [1.0, 0.0]],
}


@pytest.mark.parametrize("name", RINGS)
def test_covers_agree_with_ray_casting(name):
    ring, rng = RINGS[name], random.Random(1)
    levels: dict[int, dict] = {}
    for c in cover.cells_of(ring):
        levels.setdefault(c.level, {})[c.x, c.y] = c
    low, high = np.min(ring, axis=0), np.max(ring, axis=0)
    tests = 0
    for _ in range(1500):
        lon, lat = (rng.uniform(a - 0.1, b + 0.1) for a, b in zip(low, high))
        met = [c for level, cells in levels.items() if (c := cells.get((math.floor(lon / 2.0**level), math.floor(lat / 2.0**level))))]
        assert len(met) <= 1
        tests += sum(len(c.edges) for c in met)
        found = any(not len(c.edges) or c.inside(np.array([lon]), np.array([lat]))[0] for c in met)
        assert found == plain(ring, lon, lat)
    assert tests / 1500 < 12


def test_odd_rings_have_no_cells():
    for ring in (None, [], [[1.0, 1.0]], [[0.0, 0.0], [1.0, 1.0]], [[0.0, float("nan")], [1.0, 1.0], [2.0, 0.0]]):
        assert list(cover.cells_of(ring)) == []
    for c in cover.cells_of([[1.0, 1.0]] * 4):  # a point has no inside, whatever its cells
        assert len(c.edges) and not c.inside(np.array([0.999]), np.array([0.999]))[0]


def test_points_in_one_large_ring_among_small_ones(spark):
    rng = random.Random(3)
    large = star(rng, 5000, 0.05)
    polygons = [(1, 100, large), (2, 7, [[5.0, 5.0], [6.0, 5.0], [6.0, 6.0], [5.0, 6.0]]), (3, 8, star(rng, 6, 0.2, (0.3, -0.2), 0.1)), (0, 9, None)]
    frame = spark.createDataFrame(polygons, "feature_order int, ward_id int, ring array<array<double>>")
    points = [(k, rng.uniform(-1.2, 1.8), rng.uniform(-1.6, 1.2)) for k in range(2000)] + [(5000, 5.5, 5.5), (5001, None, 1.0), (5002, float("nan"), 1.0)]
    located = spatial.locate_points(spark.createDataFrame(points, "id long, lon double, lat double"), frame, "id")
    assert dict(located.dtypes)["ward_id"] == "int"
    found = {r[0]: r[1] for r in rows(located.select("id", "ward_id"))}
    for k, lon, lat in points[:2000]:
        inside = [w for _, w, ring in polygons[:3] if plain(ring, lon, lat)]
        assert found[k] == (inside[0] if inside else None)
    assert (found[5000], found[5001], found[5002]) == (7, None, None)


def test_cells_have_their_rings_box_and_rings_are_dealt_anew(spark, monkeypatch):
    rng = random.Random(4)
    rings = [(k, k, [[x * 9.0 + 70.0, y * 9.0 + 10.0] for x, y in star(rng, 5 + k, 0.4)]) for k in range(20)]
    polygons = spark.createDataFrame(rings, "feature_order long, ward_id long, ring array<array<double>>").coalesce(1)
    cells = cover.polygon_cells(polygons)
    found = rows(cells.select("ward", "low_lon", "low_lat", "high_lon", "high_lat").distinct(), "ward")
    assert len(found) == 20
    for ward, *box in found:
        lon, lat = zip(*rings[ward][2])
        assert box == pytest.approx([min(lon), min(lat), max(lon), max(lat)], abs=1e-6)
        assert box[0] < min(lon) and box[1] < min(lat) and box[2] > max(lon) and box[3] > max(lat)
    monkeypatch.setattr(cover, "cut_lineage", lambda df: df)
    assert "REPARTITION_BY_COL" in cover.polygon_cells(polygons)._jdf.queryExecution().executedPlan().toString()
