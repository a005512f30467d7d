"""Streaming: lateness, restarts, two outputs, parity with batch."""

from __future__ import annotations

import datetime as dt
import json
import os

from conftest import rows
from pyspark.sql import functions as F

from wardlens import schemas
from wardlens.operators import aggregates
from wardlens.sources import files, messages
from wardlens.streaming import alerts, windows

DAY = dt.datetime(2024, 4, 9)
COLUMNS = ["ward_id", "sensor_id", "timestamp", "lat", "lon", "temperature_c", "humidity_pct", "pm25", "rainfall_mm"]


def line(ward, minute, temperature=30.0, rain=0.0):
    stamp = (DAY + dt.timedelta(minutes=minute)).isoformat() + "Z"
    return json.dumps(dict(zip(COLUMNS, (ward, "S", stamp, 12.9, 77.6, temperature, 50.0, 30.0, rain))))


def drop(folder, name, *lines):
    """Write a file elsewhere and rename it in, so that the stream never sees half a file."""
    partial = folder.parent / f".{name}"
    partial.write_text("\n".join(lines) + "\n")
    os.replace(partial, folder / name)


def finish(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


def stream(spark, folder):
    accepted, _ = messages.parse_sensor_messages(messages.file_messages(spark, str(folder)))
    return windows.windowed_stream(accepted)


def test_late_rows_and_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        return finish(windows.append_stream(stream(spark, folder), out, state, once=True))

    drop(folder, "a.txt", line(1, 1), line(1, 14, 50.0), line(2, 3, rain=25.0), "{broken")
    run()
    assert spark.read.schema(stream(spark, folder).schema).parquet(out).count() == 0  # nothing has closed
    drop(folder, "b.txt", line(1, 40))
    run()  # a restart from the checkpoint: the first windows close
    drop(folder, "c.txt", line(1, 2, 99.0), line(1, 90))  # the first row is late by now
    query = run()
    assert windows.dropped_late_rows(query) == 1
    got = rows(spark.read.parquet(out).select("ward_id", "window_start", "avg_temperature_c", "reading_count", "has_anomaly"),
               "window_start", "ward_id")
    quarter = DAY + dt.timedelta(minutes=30)
    assert got == [(1, DAY, 40.0, 2, 0), (2, DAY, 30.0, 1, 1), (1, quarter, 30.0, 1, 0)]


def test_two_outputs_equal_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [line(i % 3, i * 2, 30.0 + i % 20, i % 7) for i in range(60)] + [line(9, 400)]
    drop(folder, "a.txt", *lines[:30])
    drop(folder, "b.txt", *lines[30:])
    features, found = str(tmp_path / "features"), str(tmp_path / "alerts")
    finish(windows.publish_windows(stream(spark, folder), features, found, str(tmp_path / "state"), once=True))
    batch, _ = messages.parse_sensor_messages(messages.file_messages(spark, str(folder), streaming=False))
    expected = aggregates.ward_windows(batch).filter("ward_id != 9")
    key = ("ward_id", "window_start")

    def read(path):
        return spark.read.option("recursiveFileLookup", True).parquet(path).select(expected.columns)

    assert rows(read(features), *key) == rows(expected, *key)
    assert rows(read(found), *key) == rows(aggregates.anomalies(expected), *key)


def test_csv_folder_is_followed(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for name in ("a", "b"):
        drop(folder, f"{name}.csv", ",".join(COLUMNS), f"1,S,2024-04-09T00:00:00Z,1,1,1,1,1,{1 if name == 'a' else 2}")
        finish(windows.append_stream(files.follow_csv(spark, str(folder), schemas.RAW_IOT), out, state, once=True))
    assert sorted(r["rainfall_mm"] for r in spark.read.parquet(out).collect()) == [1.0, 2.0]


def test_alert_stream_dedupe_relay_and_newest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    alert = lambda ward, second, kind="heat_wave": json.dumps(
        {"ward_id": ward, "alert_type": kind, "timestamp": (DAY + dt.timedelta(seconds=second)).isoformat() + "Z"})
    drop(folder, "a.txt", alert(1, 0), alert(1, 0), alert(1, 0, "flood_warning"), alert(2, 5), "{broken")
    relayed = alerts.relay(messages.file_messages(spark, str(folder)))
    parsed = relayed.select(F.from_json("value", "ward_id INT, alert_type STRING, timestamp TIMESTAMP").alias("a")).select("a.*")
    out = str(tmp_path / "out")
    finish(windows.append_stream(alerts.dedupe_stream(parsed), out, str(tmp_path / "s1"), once=True))
    assert spark.read.parquet(out).count() == 2
    typed = str(tmp_path / "typed")
    finish(windows.append_stream(alerts.dedupe_stream(parsed, by_type=True), typed, str(tmp_path / "s2"), once=True))
    assert spark.read.parquet(typed).count() == 3
    newest = str(tmp_path / "newest")
    finish(alerts.publish_newest(parsed, newest, str(tmp_path / "s3"), keep=1, once=True))
    assert [r["ward_id"] for r in spark.read.option("recursiveFileLookup", True).parquet(newest).collect()] == [2]
