"""Near-duplicate vectors by int8 tile products with error bounds and exact recomputation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .store import stored

# Rows of a tile. A pair of tiles holds two tiles' vectors and one strip of products in memory.
TILE = 1024
STRIP = 256
SEED = 77


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes int8, scale, error, length) of unit rows: row = scale * codes + rest, error >= |rest|, length >= |scale * codes|.

    Both norms are computed in double precision and rounded up by more than the rounding of that computation.
    """
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-300) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(unit - back, axis=1) + 1e-12, np.linalg.norm(back, axis=1) + 1e-12


def tile_links(
    a: np.ndarray, b: np.ndarray, same: bool, threshold: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of unit rows with a[i] . b[j] >= threshold; with ``same`` only i < j.

    x . y differs from the product of the quantised rows by at most |x - x'| * |y| + |x'| * |y - y'|, where |y| <= 1 up
    to rounding. Pairs whose product plus bound stays below the threshold are ruled out; all others are recomputed in
    double precision. The products of codes are whole numbers below 2^24 up to 1,040 components, so float32 holds them
    exactly; beyond that double precision is used.
    """
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    qa, sa, ea, la = quantise(a)
    qb, sb, eb, _ = quantise(b)
    right = qb.T.astype(kind)
    for start in range(0, len(a), STRIP):
        part = slice(start, start + STRIP)
        product = (qa[part].astype(kind) @ right).astype(np.float64) * sa[part, None] * sb[None, :]
        product += ea[part, None] * (1 + 1e-9) + la[part, None] * eb[None, :] + 1e-9
        i, j = np.nonzero(product >= threshold)
        i += start
        if same:
            i, j = i[i < j], j[i < j]
        for cut in range(0, len(i), 65_536):
            x, y = i[cut : cut + 65_536], j[cut : cut + 65_536]
            hit = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
            yield x[hit], y[hit]


def _forest(a: np.ndarray, b: np.ndarray, parent: dict) -> list[tuple[int, int]]:
    """The links that join two trees so far, so that a tile pair reports at most one link per vector."""

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _unit_rows(batch: pa.RecordBatch, column: int) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for a null, empty or zero vector or one with a null or non-finite part."""
    out: list[np.ndarray | None] = []
    for value in batch.column(column):
        row = value.as_py()
        if not row or any(x is None for x in row):
            out.append(None)
            continue
        vector = np.asarray(row, np.float64)
        top = np.abs(vector).max()
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        vector = vector / top
        out.append(vector / np.sqrt(vector @ vector))
    return out


def _coarse(vectors: DataFrame, bits: int, seed: int) -> DataFrame:
    """(vec_id, label, size, unit, bucket): unit vectors as bytes and their signs along ``bits`` seeded directions.

    Vectors close in angle mostly share the signs, so tiles cut along them are compact and distant tiles rule out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes, units, buckets = [], [], []
            for unit in _unit_rows(batch, 2):
                if unit is None:
                    sizes.append(0), units.append(None), buckets.append(None)
                    continue
                n = len(unit)
                if n not in axes:
                    axes[n] = np.random.default_rng(seed + n).standard_normal((bits, n))
                signs = axes[n] @ unit > 0
                sizes.append(n)
                units.append(unit.tobytes())
                buckets.append(int(np.packbits(signs, bitorder="big").view(">u2")[0]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(units, pa.binary()),
                 pa.array(buckets, pa.int32())], ["vec_id", "label", "size", "unit", "bucket"])

    return vectors.mapInArrow(run, "vec_id long, label string, size int, unit binary, bucket int")


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One row for a tile: ids, copies and unit vectors, with a centre and the widest angle to it."""
    matrix = np.stack([np.frombuffer(x) for x in rows["unit"]])
    centre = matrix.mean(axis=0)
    norm = np.linalg.norm(centre)
    centre = centre / norm if norm > 1e-9 else matrix[0]
    angle = float(np.arccos(np.clip((matrix @ centre).min(), -1, 1))) + 1e-6
    return pd.DataFrame({
        "label": [rows["label"].iloc[0]], "size": [int(key[1])], "tile": [int(key[2])],
        "ids": [rows["rep"].to_numpy(np.int64).tobytes()], "copies": [rows["copies"].to_numpy(np.int64).tobytes()],
        "matrix": [matrix.tobytes()], "centre": [centre.tolist()], "angle": [angle],
    })


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, tile: int = TILE, seed: int = SEED
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and their cosine in double precision reaches ``threshold``. Vectors of equal
    direction bits under a label are one representative with a number of copies. Representatives are cut into tiles;
    each pair of tiles of a label whose centres and widths do not rule out the threshold is one task row, and reports
    a number of links per vector and a spanning forest of its links, never the links themselves.

    A row links with nothing (n_links 0, component_id = vec_id, kept) when its label is null or its vector is null,
    empty, zero or holds a null or non-finite component; vectors of different lengths do not link. Each row counts as a
    vector, also when it repeats another or shares its vec_id. A row without vec_id links with nothing: its component
    is null and it is kept. An empty table gives an empty result.
    """
    narrow = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"))
    coded = stored(_coarse(narrow, 16, seed), "vectors")
    valid = coded.filter("vec_id is not null and label is not null and unit is not null").withColumn(
        "vector_key", F.sha2("unit", 256))
    classes = stored(
        valid.groupBy("label", "size", "bucket", "vector_key")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")

    # Buckets are ranges of the sign bits, as fine as the label is large; a bucket above a tile's size is cut by hash.
    totals = classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("_n"))
    bits = F.least(F.lit(16), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / tile)))).cast("int")
    placed = classes.join(totals, ["label", "size"]).withColumn(
        "_cell", F.floor(F.col("bucket") / F.pow(F.lit(2.0), 16 - bits)).cast("long"))
    cells = placed.groupBy("label", "size", "_cell").agg(F.count(F.lit(1)).alias("_m"))
    placed = placed.join(cells, ["label", "size", "_cell"]).withColumn(
        "tile", F.col("_cell") * F.lit(1 << 32)
        + F.pmod(F.xxhash64("vector_key"), F.ceil(F.col("_m") / tile).cast("long")))
    rows = placed.select("label", "size", "tile", "rep", "copies", "vector_key").join(
        valid.select("label", "vector_key", F.col("vec_id").alias("rep"), "unit").dropDuplicates(
            ["label", "vector_key", "rep"]), ["label", "vector_key", "rep"])
    packed = stored(rows.groupBy("label", "size", "tile").applyInPandas(
        _pack, "label string, size int, tile long, ids binary, copies binary, matrix binary, centre array<double>, "
        "angle double"), "tiles")

    cosine = F.aggregate(F.zip_with("centre", "_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    reach = float(np.arccos(threshold)) + 1e-6
    heads = packed.select("label", "size", "tile", "centre", "angle")
    tails = heads.select(
        "label", "size", F.col("tile").alias("_tile"), F.col("centre").alias("_centre"), F.col("angle").alias("_angle"))
    pairs = stored(
        heads.join(tails, ["label", "size"]).filter("tile <= _tile")
        .filter(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))) <= F.col("angle") + F.col("_angle") + reach)
        .select("label", "size", "tile", "_tile"), "tile-pairs")
    sides = packed.select("label", "size", "tile", "ids", "copies", "matrix")
    joined = pairs.join(sides, ["label", "size", "tile"]).join(
        sides.select("label", "size", F.col("tile").alias("_tile"), F.col("ids").alias("_ids"),
                     F.col("copies").alias("_copies"), F.col("matrix").alias("_matrix")), ["label", "size", "_tile"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(whole.num_rows):
                line = {k: v[0] for k, v in whole.slice(row, 1).to_pydict().items()}
                ids, others = (np.frombuffer(line[k], np.int64) for k in ("ids", "_ids"))
                copies, more = (np.frombuffer(line[k], np.int64) for k in ("copies", "_copies"))
                a = np.frombuffer(line["matrix"]).reshape(-1, line["size"])
                b = np.frombuffer(line["_matrix"]).reshape(-1, line["size"])
                counts, reverse = np.zeros(len(ids), np.int64), np.zeros(len(others), np.int64)
                parent: dict = {}
                tree: list[tuple[int, int]] = []
                same = line["tile"] == line["_tile"]
                for i, j in tile_links(a, b, same, threshold):
                    np.add.at(counts, i, more[j])
                    np.add.at(counts if same else reverse, j, copies[i])
                    tree += _forest(ids[i], others[j], parent)
                node = np.concatenate([ids, ids[:0] if same else others])
                n = np.concatenate([counts, reverse[:0] if same else reverse])
                keys = [line["label"]] * int((n > 0).sum()) + [None] * len(tree)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.string()),
                    pa.array(node[n > 0].tolist() + [x for x, _ in tree], pa.int64()),
                    pa.array([None] * int((n > 0).sum()) + [y for _, y in tree], pa.int64()),
                    pa.array(n[n > 0].tolist() + [0] * len(tree), pa.int64()),
                ], ["label", "a", "b", "n"])

    reports = stored(joined.mapInArrow(compare, "label string, a long, b long, n long"), "reports")
    counts = reports.filter("label is not null").groupBy("label", F.col("a").alias("rep")).agg(F.sum("n").alias("_others"))
    found = components(reports.filter("label is null"))
    summary = (
        classes.select("label", "vector_key", "rep", "copies").join(counts, ["label", "rep"], "left")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "vector_key", (F.col("copies") - 1 + F.coalesce("_others", F.lit(0))).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id"))
    )
    linked = valid.select("vec_id", "label", "vector_key").join(summary, ["label", "vector_key"]).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = coded.filter("not (vec_id is not null and label is not null and unit is not null)").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
