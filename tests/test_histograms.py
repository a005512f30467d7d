"""Histograms with doubling bins: exact merging, and stability against a plain count."""

from __future__ import annotations

import math
import random

import pytest
from conftest import rows

from wardlens.operators import histograms


def frame(spark, data):
    return spark.createDataFrame([(m, v) for m, values in data.items() for v in values], "metric string, value double").repartition(3)


def plain(values, bins):
    """(level, {place: n}) at the least level that fits, searched from below."""
    low, high = min(values), max(values)
    level = -900
    while math.floor(high / 2.0**level) - math.floor(low / 2.0**level) >= bins:
        level += 1
    counts = {}
    for v in values:
        counts[math.floor(v / 2.0**level)] = counts.get(math.floor(v / 2.0**level), 0) + 1
    return level, counts


def taken(df):
    out = {}
    for metric, level, place, n in rows(df.select("metric", "level", "place", "n")):
        out.setdefault(metric, (level, {}))[1][place] = n
        assert out[metric][0] == level
    return out


@pytest.mark.parametrize("bins", [4, 10, 64])
def test_sketches_and_their_merges_are_exact(spark, bins):
    rng = random.Random(bins)
    parts = [{
        "wide": [rng.gauss(0, 10.0**k) for _ in range(200)], "far": [1e6 * k + rng.random() for _ in range(50)],
        "small": [rng.uniform(-1, 1) * 1e-200 for _ in range(20)], f"only{k}": [rng.random() for _ in range(9)],
    } for k in range(4)]
    sketches = [histograms.sketch(frame(spark, p), bins=bins) for p in parts]
    for part, s in zip(parts, sketches):
        assert taken(s) == {m: plain(v, bins) for m, v in part.items()}
    union = sketches[0]
    for s in sketches[1:]:
        union = union.unionByName(s)
    together = {}
    for part in parts:
        for m, v in part.items():
            together.setdefault(m, []).extend(v)
    assert taken(histograms.merged(union, bins)) == {m: plain(v, bins) for m, v in together.items()}


def test_odd_values(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("a", float("inf")), ("a", 3.0), ("a", 3.0), ("z", 0.0)], "metric string, value double")
    found = taken(histograms.sketch(df))
    assert [sum(c.values()) for _, c in (found["a"], found["z"])] == [2, 1]
    assert histograms.sketch(df.limit(0)).collect() == []
    assert taken(histograms.merged(histograms.sketch(df).unionByName(histograms.sketch(df))))["a"][1].popitem()[1] == 4


def test_stability_matches_a_plain_count(spark):
    rng = random.Random(3)
    a, b = [rng.gauss(50, 10) for _ in range(500)], [rng.gauss(60, 15) for _ in range(400)] + [400.0]
    found = rows(histograms.stability(histograms.sketch(frame(spark, {"m": a, "x": [1.0]})), histograms.sketch(frame(spark, {"m": b}))))
    level, _ = plain(a + b, 10)
    places = [math.floor(v / 2.0**level) for v in (min(a + b), max(a + b))]
    psi = 0.0
    for place in range(places[0], places[1] + 1):
        e, s = (max(sum(math.floor(v / 2.0**level) == place for v in side) / (len(side) + 1e-8), 1e-6) for side in (a, b))
        psi += (s - e) * math.log(s / e)
    assert found == [("m", pytest.approx(psi, rel=1e-9))]
