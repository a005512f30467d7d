"""TIFF files against arrays: own files, foreign layouts, strip groups, broken files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.errors import PySparkException

from wardlens.sinks import rasters as out
from wardlens.sources import rasters, tiff


def foreign(values, order=">", tile=None, compress=False, planar=False, big=False):
    """A TIFF file as other programs lay them out: any byte order, tiles, planes, 64-bit offsets."""
    height, width, samples = values.shape
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    values = values.astype(values.dtype.newbyteorder(order))
    high, wide = tile or (5, width)
    planes = [values[:, :, k : k + 1] for k in range(samples)] if planar else [values]
    blocks = []
    for plane in planes:
        for r in range(0, height, high):
            for c in range(0, width, wide):
                part = plane[r : r + high, c : c + wide]
                if tile:
                    padded = np.zeros((high, wide, plane.shape[2]), values.dtype)
                    padded[: part.shape[0], : part.shape[1]] = part
                    part = padded
                blocks.append(zlib.compress(part.tobytes()) if compress else part.tobytes())
    head = 16 if big else 8
    offsets = np.cumsum([head, *map(len, blocks)])[:-1].tolist()
    body = b"".join(blocks)
    entries = [(256, "I", [width]), (257, "I", [height]), (258, "H", [8 * values.dtype.itemsize] * samples),
               (259, "H", [8 if compress else 1]), (277, "H", [samples]), (284, "H", [2 if planar else 1]), (339, "H", [kind] * samples)]
    entries += [(322, "I", [wide]), (323, "I", [high]), (324, "I", offsets), (325, "I", list(map(len, blocks)))] if tile else [
        (273, "I", offsets), (278, "I", [high]), (279, "I", list(map(len, blocks)))]
    entries.sort()
    word, room, width_of = ("Q", 8, 20) if big else ("I", 4, 12)
    directory = head + len(body)
    extra_at = directory + (8 if big else 2) + width_of * len(entries) + room
    table, extra = b"", b""
    for tag, code, numbers in entries:
        data = struct.pack(f"{order}{len(numbers)}{code}", *numbers)
        place = data.ljust(room, b"\0")
        if len(data) > room:
            place, extra = struct.pack(order + word, extra_at + len(extra)), extra + data
        table += struct.pack(f"{order}HH{word}", tag, {"H": 3, "I": 4}[code], len(numbers)) + place
    mark = b"II" if order == "<" else b"MM"
    start = mark + (struct.pack(order + "HHHQ", 43, 8, 0, directory) if big else struct.pack(order + "HI", 42, directory))
    return start + body + struct.pack(order + ("Q" if big else "H"), len(entries)) + table + b"\0" * room + extra


def samples_of(path, group=4 << 20):
    reader = tiff.TiffReader({"path": str(path), "groupBytes": str(group)})
    found = {}
    parts = reader.partitions()
    for part in parts:
        for batch in reader.read(part):
            for file, sample, row, col, _, _, value in zip(*[c.to_pylist() for c in batch.columns]):
                assert (file, row, col, sample) not in found
                found[file, row, col, sample] = value
    return found, len(parts)


def plain(name, values):
    return {(name, r, c, s): float(v) for (r, c, s), v in np.ndenumerate(values)}


@pytest.mark.parametrize("options", [
    {}, {"order": "<"}, {"tile": (16, 16)}, {"compress": True, "tile": (16, 32)}, {"planar": True}, {"planar": True, "tile": (16, 16)},
    {"big": True}, {"big": True, "order": "<", "compress": True}])
@pytest.mark.parametrize("dtype", ["uint8", "int16", "float32", "float64"])
def test_foreign_layouts(tmp_path, options, dtype):
    values = (np.random.default_rng(1).random((37, 41, 3)) * 200 - (0 if dtype == "uint8" else 90)).astype(dtype)
    (tmp_path / "a.tif").write_bytes(foreign(values, **options))
    whole, one = samples_of(tmp_path)
    assert whole == plain("a.tif", values) and one == 1
    parts, many = samples_of(tmp_path, 500)
    assert parts == whole and many > 1


def test_own_files_and_folders(tmp_path):
    rng = np.random.default_rng(2)
    scenes = {f"deep/s{k}_B4.tif": rng.integers(0, 65_536, (50 + k, 33, 1)).astype("uint16") for k in range(3)}
    (tmp_path / "deep").mkdir()
    for name, values in scenes.items():
        (tmp_path / name).write_bytes(out.tiff_bytes(values))
    (tmp_path / "note.txt").write_text("no raster")
    found, parts = samples_of(tmp_path, 2000)
    assert found == {k: v for name, values in scenes.items() for k, v in plain(name.split("/")[1], values).items()} and parts > 3


def test_broken_files_are_errors(tmp_path, spark):
    for name, data in (("a.tif", b"GIF89a" + b"\0" * 20), ("b.tif", b"II*\0" + b"\0" * 3), ("c.tif", b"")):
        folder = tmp_path / name[0]
        folder.mkdir()
        (folder / name).write_bytes(data)
        with pytest.raises((ValueError, struct.error, pa.ArrowInvalid, OSError)):
            tiff.TiffReader({"path": str(folder)}).partitions()
    with pytest.raises(PySparkException):
        tiff.read_samples(spark, str(tmp_path / "a")).collect()


def test_bands_and_images_round_trip(spark, tmp_path):
    pixels = [(f"s{s}", r, c, *[1 + (s * 7 + r * 11 + c * b) % 60_000 for b in range(7)]) for s in range(2) for r in range(20) for c in range(0, 30, 3)]
    frame = spark.createDataFrame(pixels, "scene_id string, row int, col int, " + ", ".join(f"{b} int" for b in rasters.BANDS))
    assert out.write_bands(frame, str(tmp_path / "scenes"), 20, 30).count() == 14
    samples = rasters.read_band_files(spark, str(tmp_path / "scenes"), 200)
    back = rasters.bands_to_pixels(samples).select(*frame.columns)
    assert sorted(rows(back)) == sorted(pixels)
    assert rasters.complete_scenes(samples).count() == 2
    image = [("img", x, y, x * 8, y * 10, (x + y) % 256) for x in range(16) for y in range(20)]
    out.write_images(spark.createDataFrame(image, "image_id string, x int, y int, r int, g int, b int"), str(tmp_path / "images"), 20, 16).collect()
    got = rasters.read_image_files(spark, str(tmp_path / "images"))
    assert sorted(rows(got)) == sorted((*p, 20, 16) for p in image)


@pytest.mark.parametrize("options", [{}, {"tile": (16, 16)}, {"planar": True}, {"planar": True, "tile": (16, 16), "compress": True}])
def test_pixels_have_all_samples(tmp_path, options):
    values = np.random.default_rng(3).integers(0, 200, (37, 41, 3)).astype("uint8")
    (tmp_path / "a.tif").write_bytes(foreign(values, **options))
    for group in (1 << 20, 500):
        reader = tiff.TiffReader({"path": str(tmp_path), "groupBytes": str(group), "form": "pixels"})
        found = [(r, c, s) for part in reader.partitions() for batch in reader.read(part)
                 for r, c, s in zip(*[batch.column(k).to_pylist() for k in (1, 2, 5)])]
        assert sorted(found) == [(r, c, values[r, c].astype(float).tolist()) for r in range(37) for c in range(41)]


def test_small_files_share_a_task(tmp_path):
    for k in range(600):
        (tmp_path / f"{k}.tif").write_bytes(out.tiff_bytes(np.full((4, 5, 3), k % 256, "uint8")))
    found, parts = samples_of(tmp_path)
    assert parts < 6 and len(found) == 600 * 60


def test_images_of_one_name_in_two_folders(spark, tmp_path):
    for folder, low in (("p", 0), ("q", 100)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "both.tif").write_bytes(out.tiff_bytes(np.full((2, 2, 3), low + 7, "uint8")))
    (tmp_path / "p" / "one.tif").write_bytes(out.tiff_bytes(np.full((2, 2, 3), 5, "uint8")))
    got = rasters.read_image_files(spark, str(tmp_path))
    assert sorted(rows(got.select("image_id", "r", "g", "b"))) == [("both", 107, 107, 107)] * 4 + [("one", 5, 5, 5)] * 4
    single = rasters.read_image_files(spark, str(tmp_path / "p"))
    assert single.filter("image_id = 'both'").count() == 4 and single.count() == 8
