"""k nearest neighbours on a space-filling curve: ranges of the curve are searched alone, then across their borders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import EARTH_RADIUS_KM
from ..session import cut_lineage

_LEAF = 64  # candidates of one box inside a range
_BLOCK = 64  # ranges of one box of boxes
_SLACK = 1e-9

# Masks that spread a number's bits to every second (31 bits) or third (20 bits) place, with their shifts.
_SPREAD = {
    2: ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333),
        (1, 0x5555555555555555)),
    3: ((32, 0x001F00000000FFFF), (16, 0x001F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3),
        (2, 0x1249249249249249)),
}
_AXIS_BITS = {2: 31, 3: 20}

_NEAR = pa.list_(pa.struct([("distance", pa.float64()), ("id", pa.int64())]))
_FOUND = pa.schema([
    ("part", pa.int32()), ("code", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()),
    ("ids", pa.list_(pa.int64())), ("near", _NEAR), ("radius", pa.float64())])
_FOUND_SQL = "part int, code long, lon double, lat double, ids array<long>, near array<struct<distance: double, id: long>>, radius double"
_MORE = pa.schema([("lon", pa.float64()), ("lat", pa.float64()), ("near", _NEAR)])
_MORE_SQL = "lon double, lat double, near array<struct<distance: double, id: long>>"


def curve(axes: list[Column], box: Column) -> Column:
    """Position on the Z-order curve through the box of all points (a struct of ``low0``.. and ``span``)."""
    n = len(axes)
    top = 2 ** _AXIS_BITS[n] - 1
    code = F.lit(0).cast("long")
    for k, axis in enumerate(axes):
        v = F.floor((axis - box[f"low{k}"]) / box["span"] * float(top))
        v = F.greatest(F.lit(0), F.least(v, F.lit(top))).cast("long")
        for shift, mask in _SPREAD[n]:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        code = code.bitwiseOR(F.shiftleft(v, k))
    return code


def _planar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = b[None, :, :] - a[:, None, :]
    return np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1])


def _great_circle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    half = np.radians(b[None, :, :] - a[:, None, :]) / 2.0
    sin = np.sin(half)
    h = sin[..., 1] * sin[..., 1] + np.outer(np.cos(np.radians(a[:, 1])), np.cos(np.radians(b[:, 1]))) * sin[..., 0] * sin[..., 0]
    return 2.0 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _space(place: np.ndarray, sphere: bool) -> np.ndarray:
    """The coordinates boxes are made of: degrees, or the unit vector, whose straight distance orders like the arc."""
    if not sphere:
        return place
    lon, lat = np.radians(place[:, 0]), np.radians(place[:, 1])
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def _reach(distance: np.ndarray | float, sphere: bool) -> np.ndarray | float:
    """Width in ``_space`` that surely covers a distance."""
    if not sphere:
        return distance * (1 + _SLACK)
    angle = np.minimum(np.asarray(distance, float) / (2.0 * EARTH_RADIUS_KM), np.pi / 2)
    return np.where(np.isinf(distance), np.inf, 2.0 * np.sin(angle) * (1 + _SLACK) + 4e-15)


def _first(distance: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n least (distance, id) of every row, in order."""
    if distance.shape[1] > n:
        at = np.argpartition(distance, n - 1, axis=1)[:, :n]
        last = np.take_along_axis(distance, at, 1).max(axis=1)
        for row in np.flatnonzero((distance <= last[:, None]).sum(axis=1) > n):  # ties at the end go by id
            held = np.flatnonzero(distance[row] <= last[row])
            at[row] = held[np.lexsort((ids[row, held], distance[row, held]))[:n]]
        distance, ids = np.take_along_axis(distance, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, distance), axis=1)
    return np.take_along_axis(distance, order, 1), np.take_along_axis(ids, order, 1)


class Leaves:
    """Candidates of one range in curve order, in boxes of ``_LEAF``."""

    def __init__(self, place: np.ndarray, ids: np.ndarray, sphere: bool) -> None:
        self.place, self.ids, self.sphere = place, ids, sphere
        self.distance: Callable[[np.ndarray, np.ndarray], np.ndarray] = _great_circle if sphere else _planar
        space = _space(place, sphere)
        starts = np.arange(0, len(place), _LEAF)
        self.low, self.high = np.minimum.reduceat(space, starts), np.maximum.reduceat(space, starts)

    def nearest(self, place: np.ndarray, n: int, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the n nearest candidates of every place, filled up with infinity.

        Candidates farther than ``within`` may be left out. Places that follow each other should lie near each other: a
        leaf's worth of them looks into boxes together, nearest first, until no box can hold a better candidate.
        """
        distances, found = np.full((len(place), n), np.inf), np.full((len(place), n), -1, np.int64)
        space = _space(place, self.sphere)
        for start in range(0, len(place), _LEAF):
            own = slice(start, start + _LEAF)
            low, high = space[own].min(axis=0), space[own].max(axis=0)
            gap = np.maximum(0.0, np.maximum(self.low - high, low - self.high))
            least = np.sqrt((gap * gap).sum(axis=1))
            d, i = distances[own], found[own]
            order = np.flatnonzero(least <= _reach(within[own].max(), self.sphere))
            order = order[np.argsort(least[order], kind="stable")]
            steps, at, take = least[order], 0, 8
            while True:
                limit = _reach(min(d[:, -1].max(), within[own].max()), self.sphere)
                boxes = order[at : min(at + take, int(np.searchsorted(steps, limit, "right")))]
                if not len(boxes):
                    break
                rows = (boxes[:, None] * _LEAF + np.arange(_LEAF)).ravel()
                rows = rows[rows < len(self.place)]
                more = self.distance(place[own], self.place[rows])
                d, i = _first(np.hstack([d, more]), np.hstack([i, np.broadcast_to(self.ids[rows], more.shape)]), n)
                at, take = at + len(boxes), 16
            distances[own], found[own] = d, i
        return distances, found


def _near(distances: np.ndarray, ids: np.ndarray, within: np.ndarray | None = None) -> pa.Array:
    good = np.isfinite(distances) if within is None else distances <= within[:, None]
    offsets = np.r_[0, np.cumsum(good.sum(axis=1))]
    flat = pa.StructArray.from_arrays([pa.array(distances[good]), pa.array(ids[good])], ["distance", "id"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def _candidates(table: pa.Table, sphere: bool) -> Leaves:
    ids = table.column("ids").combine_chunks()
    sizes = np.diff(ids.offsets.to_numpy())
    place = np.stack([table.column(c).to_numpy() for c in ("lon", "lat")], axis=1)
    return Leaves(np.repeat(place, sizes, axis=0), ids.flatten().to_numpy(), sphere)


def nearest_neighbours(nodes: DataFrame, k: int = 6, metric: str = "degrees") -> DataFrame:
    """The k nearest other nodes of every node: (src, dst, distance, rank). Exact; ties go to the smaller id.

    ``nodes`` has ward_id, lon, lat; a node without a place has no neighbours. ``metric`` is "degrees" (planar: both
    sides of the date line are far apart) or "haversine" (km on the sphere, across the date line and the poles).

    1. Nodes that share a location are one query, and at most k+1 of them (smallest ids) are candidates, which is all
       any answer can use. A pile of copies at one spot therefore stays one row.
    2. Locations are dealt by ranges of a Z-order curve, so a range is compact and dense areas get more ranges. Each
       range finds its locations' k+1 nearest candidates of its own, which bounds the true answer.
    3. A location whose bound reaches the box of another range asks that range too. Only those at a border do; the boxes
       are a constant of one row per range, looked up through boxes of boxes.

    A location is stored once, and once more for every range across a border that may hold a nearer candidate.
    """
    sphere = metric == "haversine"
    place = nodes.select(F.col("ward_id").cast("long").alias("id"), F.col("lon").cast("double").alias("lon"),
                         F.col("lat").cast("double").alias("lat")).filter(
        F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat"))
    if sphere:
        lon, lat = F.radians("lon"), F.radians("lat")
        axes = [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]
    else:
        axes = [F.col("lon"), F.col("lat")]
    box = place.agg(F.struct(
        *[F.min(v).alias(f"low{i}") for i, v in enumerate(axes)],
        F.greatest(*[F.max(v) - F.min(v) for v in axes], F.lit(1e-9)).alias("span"))).scalar()
    by_id = Window.partitionBy("lon", "lat").orderBy("id")
    spots = (
        place.withColumn("_n", F.row_number().over(by_id)).filter(F.col("_n") <= k + 1)
        .groupBy("lon", "lat").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("_box", box).select(curve(axes, F.col("_box")).alias("code"), "lon", "lat", "ids"))

    def search_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        at = np.stack([table.column(c).to_numpy() for c in ("lon", "lat")], axis=1)
        far = np.full(len(at), np.inf)
        distances, ids = _candidates(table, sphere).nearest(at, k + 1, far)
        out = pa.Table.from_arrays([
            pa.array(np.full(len(at), TaskContext.get().partitionId(), np.int32)),
            *[table.column(c) for c in ("code", "lon", "lat", "ids")], _near(distances, ids),
            pa.array(distances[:, -1])], schema=_FOUND)
        yield from out.to_batches(10_000)

    order = ["code", "lon", "lat"]
    found = cut_lineage(
        spots.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(search_own, _FOUND_SQL))

    def answered(near: DataFrame) -> DataFrame:
        """Every copy of a location gets its answer, without itself."""
        back = place.join(near, ["lon", "lat"])
        rest = F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k)
        return back.select(F.col("id").alias("src"), F.posexplode(rest).alias("pos", "n")).select(
            "src", F.col("n.id").alias("dst"), F.col("n.distance").alias("distance"), (F.col("pos") + 1).alias("rank"))

    if found.select("part").distinct().limit(2).count() < 2:  # one range has no borders
        return answered(found.select("lon", "lat", "near"))

    # the boxes of the ranges, in boxes of boxes
    def limits(source: list[Column]) -> list[Column]:
        return [f(v).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i, v in enumerate(source)]

    names = [f"{n}{i}" for n in ("low", "high") for i in range(len(axes))]
    ranges = found.groupBy("part").agg(*limits(axes)).withColumn("block", F.floor(F.col("part") / _BLOCK))
    blocks = ranges.groupBy("block").agg(
        *[(F.min if n.startswith("low") else F.max)(n).alias(n) for n in names],
        F.collect_list(F.struct("part", *names)).alias("ranges"))
    boxes = blocks.agg(F.collect_list(F.struct(*names, "ranges"))).scalar()
    radius = F.col("radius")
    reach = radius * (1 + _SLACK)
    if sphere:
        angle = F.least(radius / (2.0 * EARTH_RADIUS_KM), F.lit(np.pi / 2))
        reach = 2.0 * F.sin(angle) * (1 + _SLACK) + 4e-15

    def meets(b: Column) -> Column:
        gaps = [F.greatest(b[f"low{i}"] - F.col(f"_a{i}"), F.col(f"_a{i}") - b[f"high{i}"], F.lit(0.0)) for i in range(len(axes))]
        square = gaps[0] * gaps[0]
        for gap in gaps[1:]:
            square = square + gap * gap
        return square <= F.col("_reach") * F.col("_reach")

    others = F.filter(
        F.flatten(F.transform(F.filter(F.col("_boxes"), meets), lambda b: F.filter(b["ranges"], meets))),
        lambda b: b["part"] != F.col("part"))
    asked = found.withColumns({f"_a{i}": v for i, v in enumerate(axes)}).withColumn("_reach", F.when(
        radius == float("inf"), float("inf")).otherwise(reach)).withColumn("_boxes", boxes).withColumn(
        "target", F.explode(F.transform(others, lambda b: b["part"]))).select(
        "target", *[F.col(c).alias(f"q_{c}") for c in ("code", "lon", "lat", "radius")])
    asked = cut_lineage(asked)

    def search_other(asking: pa.Table, own: pa.Table) -> pa.Table:
        if not asking.num_rows or not own.num_rows:
            return _MORE.empty_table()
        asking, own = asking.sort_by("q_code"), own.sort_by([(c, "ascending") for c in order])
        at = np.stack([asking.column(c).to_numpy() for c in ("q_lon", "q_lat")], axis=1)
        within = asking.column("q_radius").to_numpy()
        distances, ids = _candidates(own, sphere).nearest(at, k + 1, within)
        return pa.Table.from_arrays([asking.column("q_lon"), asking.column("q_lat"), _near(distances, ids, np.where(
            np.isinf(within), np.finfo(float).max, within))], schema=_MORE)

    holders = found.select("part", *order, "ids").join(asked.select(F.col("target").alias("part")).distinct(), "part", "left_semi")
    more = asked.groupBy("target").cogroup(holders.groupBy("part")).applyInArrow(search_other, _MORE_SQL)
    answers = found.select("lon", "lat", "near").unionByName(more).groupBy("lon", "lat").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))

    return answered(answers)
