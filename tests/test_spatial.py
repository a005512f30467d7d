"""Neighbour search, distance joins, tiles and graphs against brute force."""

from __future__ import annotations

import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wardlens.operators import graph, sets, spatial
from wardlens.plans import wards


def nodes(spark, points):
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "ward_id BIGINT, lon DOUBLE, lat DOUBLE")


def haversine(a, b):
    half = math.radians
    h = (math.sin(half(b[1] - a[1]) / 2) ** 2
         + math.cos(half(a[1])) * math.cos(half(b[1])) * math.sin(half(b[0] - a[0]) / 2) ** 2)
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def brute(points, k, distance):
    out = {}
    for i, p in enumerate(points):
        near = sorted((distance(p, q), j) for j, q in enumerate(points) if j != i)[:k]
        out[i] = [j for _, j in near]
    return out


def scattered(n, seed):
    rng = random.Random(seed)
    return [(77 + rng.random(), 12 + rng.random()) for _ in range(n)]


def clustered(n, seed):
    """A third at one spot, a third in a tiny cluster, the rest spread out and a few far away."""
    rng = random.Random(seed)
    spot = [(77.5, 12.5)] * (n // 3)
    cluster = [(77.6 + rng.random() * 1e-5, 12.6 + rng.random() * 1e-5) for _ in range(n // 3)]
    wide = [(77 + rng.random() * 3, 12 + rng.random() * 3) for _ in range(n - 2 * (n // 3) - 3)]
    return spot + cluster + wide + [(60.0, 1.0), (60.1, 1.0), (100.0, 40.0)]


@pytest.mark.parametrize("points", [scattered(250, 1), clustered(210, 2), [(77.0, 12.0), (77.1, 12.0), (77.0, 12.2)]],
                         ids=["scattered", "clustered", "three"])
@pytest.mark.parametrize("metric", ["degrees", "haversine"])
def test_nearest_neighbours_equal_brute_force(spark, points, metric):
    k = 6
    measure = haversine if metric == "haversine" else (
        lambda a, b: math.sqrt((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2))
    found: dict[int, list[int]] = {i: [] for i in range(len(points))}
    for src, dst, distance, rank in rows(spatial.nearest_neighbours(nodes(spark, points), k, metric), "src", "rank"):
        assert distance == pytest.approx(measure(points[src], points[dst]), abs=1e-9)
        found[src].append(dst)
    expected = brute(points, k, measure)
    for i in found:
        assert [round(measure(points[i], points[j]), 9) for j in found[i]] == [
            round(measure(points[i], points[j]), 9) for j in expected[i]]
    if metric == "degrees":
        assert found == expected


@pytest.mark.parametrize("metric", ["degrees", "haversine"])
def test_neighbours_across_ranges_of_the_curve(spark, metric):
    """Eight ranges, each searched alone first: borders, piles, strays and ranges with too few nodes of their own."""
    rng = random.Random(12)
    points = clustered(400, 4) + scattered(300, 5) + [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(60)]
    points += [(77.25, 12.25)] * 15 + [(180.0, 0.0), (-180.0, 0.0), (0.0, 90.0), (120.0, 90.0)]
    rng.shuffle(points)
    measure = haversine if metric == "haversine" else (
        lambda a, b: math.sqrt((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        placed = nodes(spark, points).unionByName(spark.createDataFrame([(9999, None, 1.0)], "ward_id long, lon double, lat double"))
        answers = rows(spatial.nearest_neighbours(placed, 5, metric), "src", "rank")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    found: dict[int, list] = {i: [] for i in range(len(points))}
    for src, dst, distance, rank in answers:
        assert distance == pytest.approx(measure(points[src], points[dst]), abs=1e-9) and rank == len(found[src]) + 1
        found[src].append((distance, dst))
    for i, p in enumerate(points):
        expected = sorted((measure(p, q), j) for j, q in enumerate(points) if j != i)[:5]
        assert [d for d, _ in found[i]] == pytest.approx([d for d, _ in expected], abs=1e-9)
        if metric == "degrees":
            assert [j for _, j in found[i]] == [j for _, j in expected]


def test_pairs_within_equal_brute_force(spark):
    points = scattered(150, 3)
    mean = sum(y for _, y in points) / len(points)
    scale = 111.0 * math.cos(math.radians(mean))
    expected = sorted(
        (i, j) for i, a in enumerate(points) for j, b in enumerate(points)
        if i < j and math.hypot((a[0] - b[0]) * scale, (a[1] - b[1]) * 111.0) <= 9.0)
    assert [(s, d) for s, d, _ in rows(spatial.pairs_within(nodes(spark, points), 9.0), "src", "dst")] == expected


@pytest.mark.parametrize(("height", "width", "count"), [(256, 256, 198), (100, 37, 198), (15, 14, 198), (9, 5, 198), (64, 64, 10)])
def test_tiles_follow_truncated_limits(spark, height, width, count):
    pixels = spark.range(height * width).select(
        (F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    got = {(r, c): w for r, c, w in rows(spatial.pixel_wards(pixels, F.lit(height), F.lit(width), count))}
    grid = -(-count // 14)
    dy, dx = height / grid, width / 14
    expected = {}
    for ward in range(count):
        r, c = divmod(ward, 14)
        for y in range(int(r * dy), int((r + 1) * dy)):
            for x in range(int(c * dx), int((c + 1) * dx)):
                expected[(y, x)] = ward + 1
    assert got == expected


def test_first_containing_polygon_wins(spark):
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    polygons = spark.createDataFrame(
        [(2, 20, square(0.0, 0.0, 10.0)), (1, 10, square(2.0, 2.0, 1.0)), (3, 30, square(20.0, 20.0, 0.5))],
        "feature_order INT, ward_id INT, ring ARRAY<ARRAY<DOUBLE>>")
    points = spark.createDataFrame([(1, 2.5, 2.5), (2, 5.0, 5.0), (3, 20.2, 20.2), (4, -1.0, 0.0)], "id INT, lon DOUBLE, lat DOUBLE")
    assert rows(spatial.locate_points(points, polygons, "id").select("id", "ward_id"), "id") == [
        (1, 10), (2, 20), (3, 30), (4, None)]


def test_ward_graph_properties(spark):
    edges = graph.ward_graph(wards.ward_catalogue(spark).select(
        "ward_id", F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat"))).cache()
    pairs = {(s, d) for s, d, _ in rows(edges)}
    assert pairs == {(d, s) for s, d in pairs} and all(s != d for s, d in pairs)
    totals = edges.groupBy("src").agg(F.sum("weight").alias("w")).collect()
    assert len(totals) == 198 and all(r["w"] == pytest.approx(1.0) for r in totals)
    stats = graph.degree_stats(edges).first()
    assert stats["edges"] == len(pairs) and stats["min_degree"] >= 3
    edges.unpersist()


def test_self_loops_and_isolated_nodes(spark):
    few = nodes(spark, [(77.0, 12.0), (77.01, 12.0)])
    looped = graph.ward_graph(few, k=1, self_loops=True)
    assert {(s, d) for s, d, _ in rows(looped)} == {(0, 0), (1, 1), (0, 1), (1, 0)}
    edges = spark.createDataFrame([(1, 2, 0.5)], "src BIGINT, dst BIGINT, weight DOUBLE")
    features = spark.createDataFrame([(1, 10.0), (2, 4.0)], "ward_id BIGINT, x DOUBLE")
    assert rows(graph.neighbour_mean(edges, features, ["x"]), "ward_id") == [(1, 0.0), (2, 5.0)]
    assert rows(graph.neighbour_mean(edges, features, ["x"], residual=True), "ward_id") == [(1, 10.0), (2, 9.0)]


def test_great_circle_neighbours_cross_date_line_and_poles(spark):
    points = [(179.99, 0.0), (-179.99, 0.0), (179.0, 0.0), (-179.0, 0.0), (10.0, 89.9), (-170.0, 89.9), (10.0, 88.0)]
    found: dict[int, list[int]] = {}
    for src, dst, _, _ in rows(spatial.nearest_neighbours(nodes(spark, points), 1, "haversine"), "src", "rank"):
        found.setdefault(src, []).append(dst)
    assert found == brute(points, 1, haversine)
    assert found[0] == [1] and found[1] == [0] and found[4] == [5]


@pytest.mark.parametrize("metric", ["degrees", "haversine"])
def test_a_stray_point_does_not_coarsen_the_cells(spark, metric):
    city = [(77 + x * 1e-5, 12 + y * 1e-5) for x, y in scattered(1500, 8)]
    points = [*city, (-179.0, -89.0)]
    measure = haversine if metric == "haversine" else (
        lambda a, b: math.sqrt((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2))
    found: dict[int, list[float]] = {}
    for src, _, distance, _ in rows(spatial.nearest_neighbours(nodes(spark, points), 3, metric), "src", "rank"):
        found.setdefault(src, []).append(distance)
    for i in (0, 700, 1499, 1500):
        expected = sorted(measure(points[i], q) for j, q in enumerate(points) if j != i)[:3]
        assert found[i] == pytest.approx(expected, rel=1e-6)
    assert len(found) == len(points)


def test_one_large_polygon_among_small_ones(spark):
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    small = [(i + 2, i + 2, square(i % 60 * 0.01, i // 60 * 0.01, 0.001)) for i in range(3000)]
    polygons = spark.createDataFrame(
        [(5000, 1, square(-5.0, -5.0, 10.0)), (6000, 7, []), *small], "feature_order INT, ward_id INT, ring ARRAY<ARRAY<DOUBLE>>")
    points = spark.createDataFrame(
        [(1, 0.0105, 0.0005), (2, 0.005, 0.005), (3, 4.9, -4.9), (4, 6.0, 0.0), (5, None, 0.0)], "id INT, lon DOUBLE, lat DOUBLE")
    assert rows(spatial.locate_points(points, polygons, "id").select("id", "ward_id"), "id") == [
        (1, 3), (2, 1), (3, 1), (4, None), (5, None)]
    assert rows(spatial.locate_points(points, polygons.limit(0), "id").select("id", "ward_id"), "id")[0] == (1, None)


def test_pairs_of_few_bytes_of_nodes_are_not_joined_by_broadcast(spark, tmp_path):
    nodes(spark, scattered(50, 9)).write.parquet(str(tmp_path / "nodes"))
    plan = spatial.pairs_within(spark.read.parquet(str(tmp_path / "nodes")), 9.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_edges_lose_duplicates_before_they_are_doubled(spark):
    given = [(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (4, None), (None, None), (7, 5)]
    edges = sets.symmetric_edges(spark.createDataFrame(given, "src long, dst long"), spark.createDataFrame([(3,), (8,)], "ward_id long"))
    expected = {(1, 2), (2, 1), (3, 3), (None, 4), (4, None), (None, None), (7, 5), (5, 7), (8, 8)}
    found = rows(edges)
    assert len(found) == len(expected) and set(found) == expected
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # the edges are doubled above the aggregate
