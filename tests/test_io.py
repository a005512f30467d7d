"""Readers, writers and message formats."""

from __future__ import annotations

import glob
import json
import os
import struct

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wardlens import schemas
from wardlens.operators import images as image_ops, nested
from wardlens.plans import live_weather, wards
from wardlens.sinks import files as file_sinks, messages as message_sinks
from wardlens.sources import files, images, messages, rasters, weather


def parts(path: str, pattern: str = "part-*") -> list[str]:
    return sorted(glob.glob(os.path.join(path, pattern)))


def test_csv_reader_tolerates_bad_numbers(spark, tmp_path):
    path = tmp_path / "iot.csv"
    path.write_text("ward_id,sensor_id,timestamp,lat,lon,temperature_c,humidity_pct,pm25,rainfall_mm\n"
                    "12,S1,2026-04-09T13:33:02.170822Z,12.9,77.6,31.6,33.7,39.4,0.05\n"
                    "12,S1,never,12.9,77.6,n/a,33.7,,0.05\n")
    got = files.sensor_readings_from_csv(spark, str(path)).collect()
    assert got[0]["temperature_c"] == 31.6 and str(got[0]["ts"]) == "2026-04-09 13:33:02.170822"
    assert got[1]["temperature_c"] == 0.0 and got[1]["pm25"] == 0.0 and got[1]["ts"] is None


def test_features_reader_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 12.0, 77.0)], schemas.WARDS)
    file_sinks.write_snapshot(df, str(tmp_path / "w.csv"), str(tmp_path / "w.parquet"))
    for suffix in ("csv", "parquet"):
        assert rows(files.read_features(spark, str(tmp_path / f"w.{suffix}"), schemas.WARDS)) == [(1, "a", 12.0, 77.0)]
    with pytest.raises(ValueError):
        files.read_features(spark, "w.xlsx", schemas.WARDS)


def test_append_and_overwrite(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(3)
    file_sinks.append_table(df, path)
    file_sinks.append_table(df, path)
    assert spark.read.parquet(path).count() == 6
    file_sinks.overwrite_table(df, path)
    assert spark.read.parquet(path).count() == 3


def test_geojson_parts_form_one_document(spark, tmp_path):
    cells = wards.ward_cells(wards.ward_catalogue(spark)).select(
        "ward_id", "ward_code", "ward_name", "centroid_lon", "centroid_lat", "geometry")
    path = str(tmp_path / "wards.geojson")
    file_sinks.export(cells, path, "geojson", "geometry")
    document = json.loads("".join(open(p).read() for p in parts(path)))
    assert document["type"] == "FeatureCollection" and len(document["features"]) == 198
    assert [f["properties"]["ward_id"] for f in document["features"]] == list(range(1, 199))
    single = tmp_path / "one.geojson"
    single.write_text(json.dumps(document))
    features = rasters.read_ward_geojson(spark, str(single))
    coordinates = rasters.ward_coordinates(features)
    assert coordinates.count() == 198
    first = features.filter("ward_id = 1").first()
    assert first["ward_name"] == "Kempegowda" and len(first["ring"]) == 5


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "ward_id INT, v STRING")
    file_sinks.export(df, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    file_sinks.export(df, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    with pytest.raises(ValueError):
        file_sinks.export(df, str(tmp_path / "x"), "xml")


def test_empty_collection_is_a_document(spark):
    empty = spark.createDataFrame([], "ward_id INT, geometry STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>")
    lines = nested.feature_collection_lines(empty, "geometry", "ward_id").orderBy("part", "pos")
    assert json.loads("".join(r["line"] for r in lines.collect())) == {"type": "FeatureCollection", "features": []}


def test_messages_round_trip_and_rejects(spark, tmp_path):
    good = spark.createDataFrame(
        [(1, "S", "2024-05-01T10:00:00Z", 12.0, 77.0, 30.0, 40.0, 50.0, 0.5)], schemas.RAW_IOT)
    message_sinks.write_message_files(message_sinks.to_messages(good, F.col("sensor_id")), str(tmp_path / "m"))
    stored = spark.read.json(str(tmp_path / "m"))
    assert stored.first()["key"] == "S"
    text = stored.select("value").unionByName(spark.createDataFrame(
        [("{broken",), ('{"ward_id": 3, "temperature_2m": 30}',), ('{"ward_id": 2, "temperature_c": "hot"}',)], "value STRING"))
    accepted, rejected = messages.parse_sensor_messages(text)
    assert [str(r["ts"]) for r in accepted.collect()] == ["2024-05-01 10:00:00"]
    assert rejected.count() == 3
    assert messages.valid_json(text).count() == 3


def test_landed_text_messages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"ward_id": 1}\n')
    got = messages.file_messages(spark, str(tmp_path / "in"), streaming=False).first()
    assert got["value"] == '{"ward_id": 1}' and got["ingest_ts"] is not None


def test_control_event(spark):
    at = F.lit("2024-05-01 06:00:00").cast("timestamp")
    event = message_sinks.control_event(spark.range(198), "run-7", "2024-05-01", at).first()
    assert event["key"] == "control"
    assert json.loads(event["value"]) == {
        "event_type": "ward_features_updated", "pipeline_run": "run-7", "ds": "2024-05-01",
        "timestamp": "2024-05-01T06:00:00Z", "ward_count": 198}


def test_weather_payload_defaults_and_single_location(spark, tmp_path):
    full = [{"current": {"temperature_2m": 20.0 + i, "precipitation": 1.0}, "daily": {"precipitation_sum": [2.0]}}
            for i in range(20)]
    full[5] = {}
    (tmp_path / "many.json").write_text(json.dumps(full))
    points = weather.grid_weather(weather.read_payloads(spark, str(tmp_path / "many.json")))
    got = {(r["grid_lat"], r["grid_lon"]): r for r in points.collect()}
    assert len(got) == 20
    assert got[(12.913, 77.563)]["temperature_c"] == 30.0 and got[(12.913, 77.563)]["humidity_pct"] == 60.0
    assert got[(13.13, 77.768)]["temperature_c"] == 39.0 and got[(13.13, 77.768)]["temp_max"] == 32.0
    (tmp_path / "one.json").write_text(json.dumps(full[0]))
    assert weather.grid_weather(weather.read_payloads(spark, str(tmp_path / "one.json"))).count() == 1
    static = spark.createDataFrame([(1, 0.3, 50.0, 0.2, 40.0, 9000.0)], "ward_id INT, ndvi DOUBLE, impervious_pct DOUBLE, "
                                   "industrial_weight DOUBLE, pm25_ugm3 DOUBLE, population_density DOUBLE")
    catalogue = wards.ward_catalogue(spark).select("ward_id", "ward_name", "centroid_lon", "centroid_lat")
    live = live_weather.live_ward_weather(points, catalogue, static)
    assert live.count() == 198
    first = live.filter("ward_id = 1").first()
    assert first["lst_celsius"] == pytest.approx(20.0 + 4.15 - 0.9) and first["rainfall_mm"] == 4.0


def bitmap(pixels: list[list[tuple[int, int, int]]]) -> bytes:
    """A 24-bit BMP; rows are stored from the bottom up and padded to four bytes."""
    height, width = len(pixels), len(pixels[0])
    pad = b"\0" * (-(width * 3) % 4)
    body = b"".join(b"".join(bytes((b, g, r)) for r, g, b in row) + pad for row in reversed(pixels))
    header = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    return header + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def test_image_files_to_verdicts(spark, tmp_path):
    top, water = (10, 200, 10), (20, 60, 120)
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.bmp").write_bytes(bitmap([[top] * 5] * 4 + [[water] * 5] * 6))
    pixels = images.image_pixels(images.read_images(spark, str(tmp_path / "img")), rows_per_batch=7)
    assert pixels.count() == 50
    assert rows(pixels.filter("y = 9 AND x = 4").select("r", "g", "b")) == [(20, 60, 120)]
    assert rows(pixels.filter("y = 0").select("r", "g", "b").distinct()) == [(10, 200, 10)]
    verdict = image_ops.score_images(pixels).first()
    assert verdict["water"] == 1.0 and verdict["green"] == 0.0 and verdict["is_flood"]


def test_band_samples_to_pixels(spark):
    samples = spark.createDataFrame(
        [("s", 0, 0, b, i) for i, b in enumerate(rasters.BANDS)] + [("t", 0, 0, "b2", 1)],
        "scene_id STRING, row INT, col INT, band STRING, dn INT")
    wide = rasters.bands_to_pixels(samples)
    assert rows(wide.filter("scene_id = 's'").select(*rasters.BANDS)) == [tuple(range(7))]
    assert [r["scene_id"] for r in rasters.complete_scenes(samples).collect()] == ["s"]


def test_report_file(spark, tmp_path):
    report = spark.range(1).select(F.struct(F.lit(1).alias("a")).alias("nested"))
    file_sinks.write_report(report, str(tmp_path / "r"))
    assert json.loads(open(parts(str(tmp_path / "r"))[0]).read()) == {"nested": {"a": 1}}
