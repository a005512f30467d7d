"""TIFF rasters as a Spark data source: files or byte ranges of files are dealt to tasks, which parse and read them."""

from __future__ import annotations

import os
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SAMPLES = "file string, sample int, row int, col int, height int, width int, value double"
_SCHEMA = pa.schema([
    ("file", pa.string()), ("sample", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("height", pa.int32()),
    ("width", pa.int32()), ("value", pa.float64())])
PIXELS = "file string, row int, col int, height int, width int, samples array<double>"
_PIXELS = pa.schema([*list(_SCHEMA)[:1], *list(_SCHEMA)[2:6], ("samples", pa.list_(pa.float64()))])
# A file counts as so many bytes more than it has, for the time that it takes to open.
_OPEN_BYTES = 16 << 10

# Tags, and the sizes and codes of the field types that they use.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, PER_PIXEL, PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FORMAT = 284, 317, 322, 323, 324, 325, 339
_TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}
_NONE, _DEFLATE, _OLD_DEFLATE = 1, 8, 32946
_KINDS = {1: "u", 2: "i", 3: "f"}
_END = 2**63


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Layout:
    """What the first directory of a TIFF file says: sizes, sample type, and the byte ranges of its strips or tiles."""

    height: int
    width: int
    samples: int
    dtype: str
    compression: int
    predictor: int
    planar: bool
    block: tuple[int, int]
    ranges: list[tuple[int, int]]

    def per_plane(self) -> int:
        """Strips or tiles that cover the raster once."""
        return -(-self.width // self.block[1]) * -(-self.height // self.block[0])


def layout(read: pa.NativeFile) -> Layout:
    """Parse the header and the first directory of a classic or big TIFF file of either byte order."""
    head = read.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack_from(order + "H", head, 2)[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]
    count_kind, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    n = struct.unpack(order + count_kind, read.read_at(struct.calcsize(count_kind), at))[0]
    table = read.read_at(n * entry, at + struct.calcsize(count_kind))
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind = struct.unpack_from(order + "HH", table, k * entry)
        length = struct.unpack_from(order + word, table, k * entry + 4)[0]
        if kind not in _TYPES:
            continue
        shape = f"{order}{length}{_TYPES[kind]}"
        size, place = struct.calcsize(shape), k * entry + (12 if big else 8)
        room = 8 if big else 4
        data = table[place : place + size] if size <= room else read.read_at(
            size, struct.unpack_from(order + word, table, place)[0])
        tags[tag] = struct.unpack(shape, data)

    def first(tag: int, default: int) -> int:
        return tags.get(tag, (default,))[0]

    if len(set(tags.get(BITS, (1,)))) > 1 or first(BITS, 1) not in (8, 16, 32, 64):
        raise ValueError("samples must have 8, 16, 32 or 64 bits")
    if first(COMPRESSION, _NONE) not in (_NONE, _DEFLATE, _OLD_DEFLATE) or first(PREDICTOR, 1) not in (1, 2):
        raise ValueError("only plain or deflated samples, with or without differences, are read")
    tiled = TILE_OFFSETS in tags
    height, width = first(HEIGHT, 0), first(WIDTH, 0)
    block = (first(TILE_HEIGHT, 0), first(TILE_WIDTH, 0)) if tiled else (min(first(PER_STRIP, height), height), width)
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    return Layout(
        height, width, first(PER_PIXEL, 1), f"{order}{_KINDS[first(FORMAT, 1)]}{first(BITS, 1) // 8}", first(COMPRESSION, _NONE),
        first(PREDICTOR, 1), first(PLANAR, 1) == 2, block, list(zip(offsets, sizes)))


@dataclass
class Files(InputPartition):
    """Ranges of files: (path, first byte, byte after the last one); a strip or tile belongs to the range it starts in."""

    ranges: list[tuple[str, int, int]]

    def __init__(self, ranges: list[tuple[str, int, int]]) -> None:
        super().__init__(None)
        self.ranges = ranges


def _decoded(data: bytes, shape: Layout, samples: int) -> np.ndarray:
    if shape.compression != _NONE:
        data = zlib.decompress(data)
    values = np.frombuffer(data, shape.dtype)[: shape.block[0] * shape.block[1] * samples]
    values = values[: len(values) // (shape.block[1] * samples) * shape.block[1] * samples].reshape(-1, shape.block[1], samples)
    if shape.predictor == 2:  # differences wrap around in the samples' own width
        values = np.cumsum(values, axis=1, dtype=values.dtype.newbyteorder("="))
    return values


def _stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


class TiffReader(DataSourceReader):
    """One partition per about ``groupBytes`` stored bytes (an option, 4 MB by default): part of a file, or many files.

    The option ``form`` is samples, a row for each sample of a pixel, or pixels, a row with all of them. With ``names``
    being single or shared only files are read whose names without their ends occur once, or more often.
    """

    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.path = options["path"]
        self.group = int(options.get("groupbytes", str(4 << 20)))
        self.pixels = options.get("form", "samples") == "pixels"
        self.names = options.get("names", "all")

    def partitions(self) -> list[Files]:
        system, root = opened(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".tif", ".tiff")))
        if files:  # one is looked into at once, the others by the tasks that read them
            with system.open_input_file(files[0][0]) as read:
                layout(read)
        if self.names != "all":
            uses = Counter(_stem(path) for path, _ in files)
            files = [f for f in files if (uses[_stem(f[0])] > 1) == (self.names == "shared")]
        groups, held, size = [], [], 0
        for path, length in files:
            if length > self.group:
                parts = -(-length // self.group)
                groups += [Files([(path, k * self.group, (k + 1) * self.group if k < parts - 1 else _END)]) for k in range(parts)]
                continue
            if held and size + length + _OPEN_BYTES > self.group:
                groups.append(Files(held))
                held, size = [], 0
            held.append((path, 0, _END))
            size += length + _OPEN_BYTES
        return groups + [Files(held)] if held else groups

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        for path, first, end in partition.ranges if partition else []:  # without files Spark asks for one part of none
            with system.open_input_file(path) as read:
                yield from (self._pixels if self.pixels else self._samples)(read, os.path.basename(path), first, end)

    def _samples(self, read: pa.NativeFile, name: str, first: int, end: int) -> Iterator[pa.RecordBatch]:
        shape = layout(read)
        plane, samples = shape.per_plane(), 1 if shape.planar else shape.samples
        for k, (offset, length) in enumerate(shape.ranges):
            if first <= offset < end:
                values, top, left = _block(read, shape, k % plane, offset, length, samples)
                row, col, sample = (x.ravel() for x in np.indices(values.shape, np.int32))
                places = _places(name, shape, row + np.int32(top), col + np.int32(left))
                yield pa.RecordBatch.from_arrays([
                    places[0], pa.array(sample + np.int32(k // plane if shape.planar else 0)), *places[1:],
                    pa.array(values.ravel().astype(np.float64))], schema=_SCHEMA)

    def _pixels(self, read: pa.NativeFile, name: str, first: int, end: int) -> Iterator[pa.RecordBatch]:
        """A pixel's samples in other planes are read where that of the first plane is."""
        shape = layout(read)
        plane, samples = shape.per_plane(), 1 if shape.planar else shape.samples
        for k, (offset, _) in enumerate(shape.ranges[:plane]):
            if first <= offset < end:
                found = [_block(read, shape, k, *r, samples) for r in shape.ranges[k::plane]]
                top, left = found[0][1:]
                values = np.concatenate([v for v, _, _ in found], axis=2)
                row, col = (x.ravel() for x in np.indices(values.shape[:2], np.int32))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(row) + 1, dtype=np.int32) * np.int32(values.shape[2])), pa.array(values.ravel().astype(np.float64)))
                yield pa.RecordBatch.from_arrays(
                    [*_places(name, shape, row + np.int32(top), col + np.int32(left)), lists], schema=_PIXELS)


def _block(read: pa.NativeFile, shape: Layout, k: int, offset: int, length: int, samples: int) -> tuple[np.ndarray, int, int]:
    """The values of a strip or tile inside the raster, and the row and column where it begins."""
    high, wide = shape.block
    across = -(-shape.width // wide)
    top, left = k // across * high, k % across * wide
    return _decoded(read.read_at(length, offset), shape, samples)[: shape.height - top, : shape.width - left], top, left


def _places(name: str, shape: Layout, row: np.ndarray, col: np.ndarray) -> list[pa.Array]:
    n = len(row)
    return [
        pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), [name]).cast(pa.string()), pa.array(row), pa.array(col),
        pa.array(np.full(n, shape.height, np.int32)), pa.array(np.full(n, shape.width, np.int32))]


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wardlens_tiff"

    def schema(self) -> str:
        return PIXELS if self.options.get("form") == "pixels" else SAMPLES

    def reader(self, schema: object) -> TiffReader:
        return TiffReader(dict(self.options))


def read_samples(spark: SparkSession, path: str, group_bytes: int = 4 << 20) -> DataFrame:
    """(file, sample, row, col, height, width, value) of every sample of the TIFF files below ``path``.

    Plain and deflated files in strips or tiles are read, chunky or planar, with integer or float samples of either byte
    order. A file of another kind is an error. No task holds more than a strip or tile of samples at once.
    """
    spark.dataSource.register(TiffSource)
    return spark.read.format(TiffSource.name()).option("groupBytes", group_bytes).load(path)


def read_pixels(spark: SparkSession, path: str, names: str, group_bytes: int = 4 << 20) -> DataFrame:
    """(file, row, col, height, width, samples) of every pixel, as ``read_samples`` reads them, with all its samples.

    ``names`` is single or shared: only files whose names without their ends occur once, or more often, below ``path``.
    """
    spark.dataSource.register(TiffSource)
    return spark.read.format(TiffSource.name()).option("groupBytes", group_bytes).option("form", "pixels").option("names", names).load(path)
