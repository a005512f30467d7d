"""Near-duplicate documents by circulant MinHash, banding and exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .store import among, stored
from .words import forget_words, shingle_hashes, shingle_set, words_of

UNIVERSE_BITS = 20
# 40 bands of 6: a pair at Jaccard 0.8 shares no band with probability (1 - 0.8^6)^40 < 6e-6; pairs below 0.3 seldom do.
BANDS, ROWS = 40, 6
SEED = 20_241
STAR_ROUNDS = 1
# Bounds of a tile of members whose sets are compared in one step.
TILE_MEMBERS, TILE_SHINGLES = 256, 1 << 20


@lru_cache(maxsize=2)
def _windows(seed: int, width: int) -> np.ndarray:
    """All circular shifts of the second permutation that one position needs, as overlapping slices."""
    permuted = np.random.default_rng(seed).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
    ring = np.concatenate([permuted, permuted[: width - 1]])
    return np.lib.stride_tricks.sliding_window_view(ring, width)


def signature(hashes: np.ndarray, width: int, seed: int = SEED) -> np.ndarray:
    """``width`` coordinates: the k-th is the least value of the second permutation, shifted k places around.

    The first permutation scatters shingles over the universe (the hash itself); the second is one table. A position's
    values under all shifts are one contiguous slice, so the coordinates are a running minimum over slices.
    """
    windows = _windows(seed, width)
    places = (hashes >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    least = np.full(width, np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(places), 2048):
        np.minimum(least, windows[places[start : start + 2048]].min(axis=0), out=least)
    return least


def band_hashes(coordinates: np.ndarray, bands: int) -> np.ndarray:
    """One signed 64-bit hash per band, different for the same values in another band."""
    from .words import mix

    cells = coordinates.reshape(bands, -1).astype(np.uint64)
    total = np.arange(1, bands + 1, dtype=np.uint64)
    for column in cells.T:
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + column)
    return total.view(np.int64)


def signatures(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_shingles, fingerprint, bands) per row; a text without words has neither fingerprint nor bands."""
    schema = "doc_id long, n_shingles long, fingerprint binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for whole in batches:
                for start in range(0, whole.num_rows, 1024):
                    batch = whole.slice(start, 1024)
                    counts, prints, found = [], [], []
                    for text in batch.column(1):
                        hashes = shingle_hashes(words_of(text.as_py()), size)
                        counts.append(len(hashes))
                        if len(hashes):
                            prints.append(blake2b(hashes.tobytes(), digest_size=16).digest())
                            found.append(band_hashes(signature(hashes, bands * rows, seed), bands))
                        else:
                            prints.append(None)
                            found.append(None)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()),
                         pa.array(found, pa.list_(pa.int64()))],
                        ["doc_id", "n_shingles", "fingerprint", "bands"])
        finally:
            forget_words()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the similarity: 100 * |intersection| >= percent * |union|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2), batch.column(3)):
                left = one.as_py()
                if left != last[0]:
                    last = (left, shingle_set(words_of(left), size))
                right = shingle_set(words_of(other.as_py()), size)
                shared = len(last[1] & right)
                keep.append(shared > 0 and 100 * shared >= percent * (len(last[1]) + len(right) - shared))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("_ta"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("_tb"))
    return (
        pairs.select("a", "b").join(first, "a").join(second, "b")
        .select("a", "b", "_ta", "_tb").mapInArrow(run, "a long, b long")
    )


def _links_of_tiles(a: dict, b: dict | None, percent: int) -> list[tuple[int, int]]:
    """Links between members of different components of two tiles (or inside one), one per pair of trees at most.

    Every such pair whose sizes allow the similarity is compared on its full sets.
    """
    other = a if b is None else b
    ids, place = np.unique(
        np.concatenate([a["hashes"], other["hashes"]]), return_inverse=True)
    left, right = place[: len(a["hashes"])], place[len(a["hashes"]) :]
    starts = np.concatenate([[0], np.cumsum(other["sizes"])[:-1]])
    begin = np.concatenate([[0], np.cumsum(a["sizes"])])
    mark = np.zeros(len(ids), bool)
    tree: dict[int, int] = {}

    def root(x: int) -> int:
        while tree.setdefault(x, x) != x:
            tree[x] = x = tree[tree[x]]
        return x

    found = []
    for k, (node, component, n) in enumerate(zip(a["nodes"].tolist(), a["components"].tolist(), a["sizes"].tolist())):
        own = left[begin[k] : begin[k + 1]]
        mark[own] = True
        shared = np.add.reduceat(mark[right], starts, dtype=np.int64)
        mark[own] = False
        fits = (100 * shared >= percent * (n + other["sizes"] - shared)) & (other["components"] != component)
        for j in np.flatnonzero(fits):
            p, q = root(component), root(int(other["components"][j]))
            if p != q:
                tree[max(p, q)] = min(p, q)
                found.append((node, int(other["nodes"][j])))
    return found


def across_components(open_: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between members of different components that share a bucket, without listing their pairs.

    ``open_`` has h, node, n, c, low: the members of buckets that span several components. A member goes to a tile of
    the least component it meets, tiles hold a bounded number of members and shingles, and each pair of tiles that meet
    in a bucket is compared in one step on the members' full sets (64-bit hashes of all shingles).
    """
    homes = open_.groupBy("node", "n", "c").agg(F.min("low").alias("home"))
    parts = homes.groupBy("home").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / TILE_MEMBERS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("long").alias("_parts"))
    tiled = stored(homes.join(parts, "home").select(
        "node", "c", F.col("home"), F.pmod(F.xxhash64("node"), F.col("_parts")).alias("part")), "tiled")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                found = [shingle_hashes(words_of(t.as_py()), size) for t in batch.column(4)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:4], pa.array([len(x) for x in found], pa.int64()),
                     pa.array([x.tobytes() for x in found], pa.binary())], ["home", "part", "node", "c", "n", "hashes"])
        finally:
            forget_words()

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "home": rows["home"].iloc[:1], "part": rows["part"].iloc[:1],
            "nodes": [rows["node"].to_numpy(np.int64).tobytes()], "components": [rows["c"].to_numpy(np.int64).tobytes()],
            "sizes": [rows["n"].to_numpy(np.int64).tobytes()], "hashes": [b"".join(rows["hashes"])]})

    tiles = stored(
        tiled.join(texts.select(F.col("doc_id").alias("node"), "text"), "node")
        .select("home", "part", "node", "c", "text")
        .mapInArrow(sets, "home long, part long, node long, c long, n long, hashes binary")
        .groupBy("home", "part").applyInPandas(
            pack, "home long, part long, nodes binary, components binary, sizes binary, hashes binary"), "tiles")
    spots = open_.select("h", "node").join(tiled.select("node", "home", "part"), "node").select("h", "home", "part").distinct()
    spots = stored(spots, "spots")
    meet = stored(
        spots.join(spots.select("h", F.col("home").alias("_home"), F.col("part").alias("_part")), "h")
        .filter("home < _home or (home = _home and part <= _part)").select("home", "part", "_home", "_part").distinct(), "meets")
    joined = meet.join(tiles, ["home", "part"]).join(
        tiles.select(*[F.col(c).alias(f"_{c}") for c in tiles.columns]), ["_home", "_part"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tile(line: dict, mark: str) -> dict:
            kinds = {"nodes": np.int64, "components": np.int64, "sizes": np.int64, "hashes": np.uint64}
            return {k: np.frombuffer(line[mark + k], kind) for k, kind in kinds.items()}

        for whole in batches:
            for k in range(whole.num_rows):
                line = {name: v[0] for name, v in whole.slice(k, 1).to_pydict().items()}
                same = (line["home"], line["part"]) == (line["_home"], line["_part"])
                found = _links_of_tiles(tile(line, ""), None if same else tile(line, "_"), percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return joined.mapInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, seed: int = SEED,
    numbered: bool = False,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Rows with equal shingle sets form a class with the smallest doc_id as its representative; only representatives are
    banded. Buckets do not emit all their pairs: every member is first compared with the least member of its buckets,
    and where a bucket still spans several components, with the least member of its least component. What is left is
    compared tile by tile: all pairs of different components, of which only links come out. A pair whose set sizes
    already rule out the similarity is left out. Every link is confirmed on the full sets of the whole texts. No bucket
    or class is gathered in one task.

    Null, empty and blank texts have n_shingles 0 and stand alone (component_id = doc_id, kept). Repeated rows are
    copies of each other; rows that share a doc_id take the component of their own text. A row without doc_id is kept
    only if no row with a doc_id has its set. An empty table gives an empty result.

    ``numbered`` says that doc_id is a stored monotonically_increasing_id(): then texts do not move to be chosen.
    """
    sketched = stored(signatures(docs, size, bands, rows, seed), "signatures")
    sets = sketched.filter("fingerprint is not null")
    classes = stored(sets.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "classes")
    banded = (
        sets.select("fingerprint", "doc_id", "n_shingles", "bands").join(classes, "fingerprint")
        .filter(F.col("doc_id") == F.col("rep"))
        .select(F.explode("bands").alias("h"), F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"))
    )
    shared = banded.groupBy("h").agg(F.min("node").alias("hub"), F.max("node").alias("_last")).filter("hub <> _last")
    members = stored(banded.join(shared.select("h", "hub"), "h").select("h", "node", "n", "hub"), "buckets")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    meeting = members.select(F.col("node").alias("doc_id"))
    texts = stored(
        among(every, "doc_id", meeting) if numbered else every.join(meeting.distinct(), "doc_id", "left_semi"),
        "texts", "zstd")

    links = stored(confirmed(
        stored(members.filter("hub < node").groupBy("node").agg(F.min("hub").alias("hub"))
               .select(F.col("hub").alias("a"), F.col("node").alias("b")), "pairs"),
        texts, size, percent), "links")
    for turn in range(STAR_ROUNDS + 1):
        found = components(links)
        placed = (
            members.select("h", "node", "n")
            .join(found.withColumnRenamed("component", "_c"), "node", "left")
            .select("h", "node", "n", F.coalesce("_c", "node").alias("c"))
        )
        spans = placed.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high")
        open_ = stored(placed.join(spans, "h"), "open")
        if open_.isEmpty():
            break
        if turn < STAR_ROUNDS:
            # the members outside a bucket's least component against that component's least member
            hubs = open_.filter("c = low").groupBy("h").agg(F.min(F.struct("node", "n")).alias("_hub"))
            fits = 100 * F.least("_hub.n", "n") >= percent * F.greatest("_hub.n", "n")
            pairs = stored(open_.filter("c <> low").join(hubs, "h").filter(fits).select(
                F.least("_hub.node", "node").alias("a"), F.greatest("_hub.node", "node").alias("b")).distinct(), "pairs")
            links = links.union(stored(confirmed(pairs, texts, size, percent), "links"))
        else:
            links = links.union(stored(across_components(open_, texts, size, percent), "links"))
            found = components(links)
    reps = classes.join(found, classes["rep"] == found["node"], "left").select(
        "fingerprint", F.coalesce("component", "rep").alias("_component"))
    grouped = (
        sketched.filter("fingerprint is not null").select("doc_id", "n_shingles", "fingerprint").join(reps, "fingerprint")
        .select("doc_id", "n_shingles", F.col("_component").alias("component_id"),
                F.col("doc_id").eqNullSafe(F.col("_component")).alias("kept"))
    )
    blank = sketched.filter("fingerprint is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return grouped.union(blank)


def one_of_each_group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``docs`` (doc_id, text and any others).

    Of a group the row with the smallest doc_id stays, a null doc_id being larger than any, and of rows that share it
    the one whose text has the least hash. Rows are told apart by a number of their own, so different texts that share a doc_id, or have
    none, each get their verdict. Null, empty and blank texts are near nothing and all stay. An empty table stays empty.
    """
    rows = stored(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("key")), "rows", "zstd")
    found = near_duplicates(
        rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), size, percent, numbered=True)
    named = found.select(F.col("doc_id").alias("key"), "component_id").join(
        rows.select("key", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("hash")), "key")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "key")
    kept = named.groupBy("component_id").agg(F.min_by("key", order).alias("key")).select("key")
    return among(rows, "key", kept).select("row.*")
