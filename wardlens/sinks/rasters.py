"""Rasters as TIFF files: one file per scene and band, or per image."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources import tiff
from ..sources.rasters import BANDS


def tiff_bytes(values: np.ndarray, rows_per_strip: int = 16) -> bytes:
    """A deflated little-endian TIFF file of a (rows, columns, samples) array, each strip with differences."""
    height, width, samples = values.shape
    values = values.astype(values.dtype.newbyteorder("<"))
    steps = values.copy()
    steps[:, 1:] -= values[:, :-1]
    strips = [zlib.compress(steps[k : k + rows_per_strip].tobytes()) for k in range(0, height, rows_per_strip)]
    body, offsets, at = b"".join(strips), [], 8
    for strip in strips:
        offsets.append(at)
        at += len(strip)
    bits = [8 * values.dtype.itemsize] * samples
    entries = [
        (tiff.WIDTH, "I", [width]), (tiff.HEIGHT, "I", [height]), (tiff.BITS, "H", bits), (tiff.COMPRESSION, "H", [8]),
        (262, "H", [2 if samples == 3 else 1]), (tiff.STRIP_OFFSETS, "I", offsets), (tiff.PER_PIXEL, "H", [samples]),
        (tiff.PER_STRIP, "I", [rows_per_strip]), (tiff.STRIP_BYTES, "I", [len(s) for s in strips]), (tiff.PREDICTOR, "H", [2]),
        (tiff.FORMAT, "H", [1] * samples)]
    body += b"\0" * (at % 2)
    directory = 8 + len(body)
    extra_at, extra, table = directory + 2 + 12 * len(entries) + 4, b"", b""
    for tag, kind, numbers in entries:
        data = struct.pack(f"<{len(numbers)}{kind}", *numbers)
        place = data.ljust(4, b"\0")
        if len(data) > 4:
            place = struct.pack("<I", extra_at + len(extra))
            extra += data
        table += struct.pack("<HHI", tag, {"H": 3, "I": 4}[kind], len(numbers)) + place
    return b"II*\0" + struct.pack("<I", directory) + body + struct.pack("<H", len(entries)) + table + struct.pack("<I", 0) + extra


def _store(path: str, name: str, data: bytes) -> str:
    """Write beside the place and rename, so a repeated task never leaves half a file."""
    system, root = tiff.opened(path)
    system.create_dir(root, recursive=True)
    partial = f"{root}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(partial) as out:
        out.write(data)
    system.move(partial, f"{root}/{name}")
    return f"{root}/{name}"


def _raster(rows: pd.DataFrame, values: list[str], height: int, width: int, dtype: str) -> np.ndarray:
    raster = np.zeros((height, width, len(values)), dtype)
    raster[rows["row"], rows["col"]] = rows[values].to_numpy(dtype)
    return raster


def write_bands(pixels: DataFrame, path: str, height: int, width: int) -> DataFrame:
    """(file) per scene and band: 16-bit ``<scene>_<BAND>.tif`` below ``path``; a pixel without a row is 0.

    ``pixels`` has scene_id, row, col and the bands, one row a pixel. A task holds one band of one scene, which is one
    file.
    """
    long = pixels.select("scene_id", "row", "col", F.explode(F.array(*[
        F.struct(F.lit(b.upper()).alias("band"), F.col(b).cast("int").alias("dn")) for b in BANDS])).alias("e")).select(
        "scene_id", "row", "col", "e.*")

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        data = tiff_bytes(_raster(rows, ["dn"], height, width, "uint16"))
        return pd.DataFrame({"file": [_store(path, f"{key[0]}_{key[1]}.tif", data)]})

    return long.groupBy("scene_id", "band").applyInPandas(write, "file string")


def write_images(pixels: DataFrame, path: str, height: int, width: int) -> DataFrame:
    """(file) per image: 8-bit RGB ``<image>.tif`` below ``path``, from (image_id, x, y, r, g, b)."""
    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        data = tiff_bytes(_raster(rows.rename(columns={"y": "row", "x": "col"}), ["r", "g", "b"], height, width, "uint8"))
        return pd.DataFrame({"file": [_store(path, f"{key[0]}.tif", data)]})

    return pixels.select("image_id", "x", "y", "r", "g", "b").groupBy("image_id").applyInPandas(write, "file string")
