"""Nothing is lost silently: long lists, broken images, null features, many alerts, odd payloads, several models."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from wardlens.operators import filters
from wardlens.plans import quality, training
from wardlens.sources import images, weather
from wardlens.streaming import alerts


def test_a_long_list_of_ids(spark):
    frame = spark.range(3000).withColumnRenamed("id", "ward_id")
    assert filters.only_ids(frame, list(range(1001))).count() == 1001


def test_broken_images_are_listed(spark, tmp_path):
    (tmp_path / "broken.png").write_bytes(b"no image")
    assert images.read_images(spark, str(tmp_path)).count() == 0
    assert [r.image_id.rsplit("/", 1)[1] for r in images.rejected_images(spark, str(tmp_path)).collect()] == ["broken.png"]


def test_a_null_feature_is_an_error(spark):
    rows = [(1.0, 2.0, "train"), (None, 3.0, "train"), (2.0, 4.0, "train")]
    with pytest.raises(Exception, match="[Nn]ull|assemble"):
        training.fit_baseline(spark.createDataFrame(rows, "x double, y double, split string"), ["x"], "y")


def test_all_alerts_are_kept(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(60).select(F.col("id").cast("int").alias("ward_id"), F.timestamp_seconds("id").alias("timestamp")) \
        .coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("ward_id INT, timestamp TIMESTAMP").parquet(source)
    path = str(tmp_path / "newest")
    run = alerts.publish_newest(stream, path, str(tmp_path / "state"), once=True)
    run.awaitTermination()
    assert (spark.read.parquet(path).count(), spark.read.parquet(path + ".all").count()) == (50, 60)


def test_payloads_of_another_grid_are_listed(spark):
    def payload(n):
        return "[" + ",".join('{"current":{"temperature_2m":20}}' for _ in range(n)) + "]"

    frame = spark.createDataFrame([(payload(20),), (payload(21),)], "value string")
    assert weather.grid_weather(frame).count() == 20
    assert weather.rejected_payloads(frame).count() == 1


def test_each_model_has_its_own_baseline(spark, tmp_path):
    path = str(tmp_path / "baselines")

    def values(start):
        return spark.range(start, start + 10).select(F.lit("m").alias("metric"), F.col("id").cast("double").alias("value"))

    assert quality.check_drift(values(0), "a", path).collect() == []
    assert quality.check_drift(values(0), "b", path).collect() == []
    assert quality.check_drift(values(100), "b", path).first().level == "CRITICAL"
    assert quality.check_drift(values(0), "a", path).first().level == "OK"
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        quality.check_drift(values(0), "a", str(broken))
    assert (broken / "part-0.parquet").read_bytes() == b"not parquet"
