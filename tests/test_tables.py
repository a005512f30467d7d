"""Upserts, change logs, validation and set operations."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wardlens import schemas
from wardlens.operators import filters, ranking, sets, tables
from wardlens.plans import registry as models

DAY = dt.datetime(2024, 5, 1)


def table(spark, data):
    return spark.createDataFrame(data, "k INT, v STRING")


def test_upsert_is_idempotent_and_checks_its_source(spark):
    target, source = table(spark, [(1, "a"), (2, "b")]), table(spark, [(2, "B"), (3, "C")])
    once = tables.merge_upsert(target, source, ["k"])
    assert rows(once, "k") == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(tables.merge_upsert(once, source, ["k"]), "k") == rows(once, "k")
    with pytest.raises(ValueError):
        tables.merge_upsert(target, table(spark, [(2, "x"), (2, "y")]), ["k"])


def test_partial_upsert_keeps_other_columns(spark):
    target = spark.createDataFrame([(1, "a", 0.1), (2, "b", 0.2)], "k INT, v STRING, ndvi DOUBLE")
    source = table(spark, [(2, None), (3, "c")])
    merged = tables.merge_columns(target, source, "k", ["v"])
    # a null in the source overwrites: the key is present
    assert rows(merged, "k") == [(1, "a", 0.1), (2, None, 0.2), (3, "c", None)]


def test_bucketed_upsert_rewrites_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    base = table(spark, [(i, "old") for i in range(40)]).withColumn("bucket", F.pmod(F.hash("k"), F.lit(4)))
    base.write.partitionBy("bucket").parquet(path)
    tables.merge_partition_path(path, table(spark, [(3, "new"), (100, "added")]), ["k"], 4)
    stored = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert len(stored) == 41 and stored[3] == "new" and stored[100] == "added" and stored[4] == "old"


def change_log(spark):
    return spark.createDataFrame(
        [(1, "a", 0, "U", DAY), (2, "b", 0, "U", DAY), (1, "a2", 1, "U", DAY + dt.timedelta(days=1)),
         (2, None, 2, "D", DAY + dt.timedelta(days=10)), (3, "c", 3, "U", DAY + dt.timedelta(days=11))],
        "k INT, v STRING, version INT, op STRING, committed_at TIMESTAMP")


def test_time_travel_and_history(spark):
    log = change_log(spark)
    assert rows(tables.as_of_version(log, ["k"], 0), "k") == [(1, "a"), (2, "b")]
    assert rows(tables.as_of_version(log, ["k"], 1), "k") == [(1, "a2"), (2, "b")]
    assert rows(tables.as_of_version(log, ["k"]), "k") == [(1, "a2"), (3, "c")]
    assert [r["version"] for r in tables.history(log, 2).collect()] == [3, 2]


def test_compaction_keeps_recent_reads(spark):
    log = change_log(spark)
    kept = tables.compact(log, ["k"], F.lit(DAY + dt.timedelta(days=12)))
    assert kept.count() == 4  # image 0 of key 1 is gone
    for version in (1, 2, 3):
        assert rows(tables.as_of_version(kept, ["k"], version), "k") == rows(tables.as_of_version(log, ["k"], version), "k")


def test_append_changes(spark):
    log = tables.append_changes(None, table(spark, [(1, "a")]), 0, F.lit(DAY))
    log = tables.append_changes(log, table(spark, [(1, None)]), 1, F.lit(DAY), "D")
    assert tables.as_of_version(log, ["k"]).isEmpty()


def test_conform(spark):
    df = spark.createDataFrame([("7", "x")], "ward_id STRING, ward_name STRING")
    assert rows(schemas.conform(df, schemas.WARDS)) == [(7, "x", None, None)]
    with pytest.raises(ValueError):
        schemas.conform(df.drop("ward_id"), schemas.WARDS)
    with pytest.raises(Exception, match="ward_id"):
        schemas.conform(spark.createDataFrame([(None, "x")], "ward_id INT, ward_name STRING"), schemas.WARDS).collect()
    for name, schema in schemas.TABLES.items():
        assert schemas.empty_table(spark, schema).columns == schema.fieldNames(), name


def test_validation_names_the_broken_rules(spark):
    df = spark.createDataFrame(
        [(1, 1, 12.9, 77.5, "flood", 3), (2, 199, 12.9, 77.5, "flood", 6), (3, None, 0.0, 77.5, None, 1)],
        "id INT, ward_id INT, latitude DOUBLE, longitude DOUBLE, report_type STRING, severity INT")
    df = df.withColumn("description", F.lit("x" * 10)).withColumn("image_url", F.lit(None).cast("string"))
    accepted, rejected = filters.validate(df, filters.report_rules())
    assert [r["id"] for r in accepted.collect()] == [1]
    assert {r["id"]: r["broken_rules"] for r in rejected.collect()} == {
        2: ["ward_id", "severity"], 3: ["ward_id", "location", "report_type"]}
    images = spark.createDataFrame([("image/png", 10), ("text/html", 10), ("image/png", 11 * 1024 * 1024)],
                                   "content_type STRING, length BIGINT")
    assert filters.validate(images, filters.image_rules())[0].count() == 1


def test_id_lists_of_any_length_are_kept_whole(spark):
    df = spark.range(5).withColumnRenamed("id", "ward_id")
    assert filters.only_ids(df, [1, 2]).count() == 2
    assert filters.only_ids(df, []).count() == 5
    many = spark.range(3000).withColumnRenamed("id", "ward_id")
    assert filters.only_ids(many, list(range(2000))).count() == 2000


def test_alert_merge_key(spark):
    data = [(1, "heat_wave", 80.0, DAY), (1, "flood_warning", 75.0, DAY), (2, "heat_wave", 61.0, DAY)]
    alerts = spark.createDataFrame(data, "ward_id INT, alert_type STRING, value DOUBLE, timestamp TIMESTAMP")
    assert sets.merge_alerts(alerts.limit(0), alerts).count() == 2
    assert sets.merge_alerts(alerts.limit(0), alerts, by_type=True).count() == 3
    assert sets.merge_alerts(alerts, alerts, keep=1).count() == 1
    assert sets.distinct_alerts(alerts).count() == 2


def test_feedback_clear_only_removes(spark):
    now = spark.createDataFrame([(1, "fake"), (2, "real")], "report_id INT, label STRING")
    entries = spark.createDataFrame([(1, "clear"), (2, "fake"), (3, "real")], "report_id INT, label STRING")
    assert rows(sets.record_feedback(now, entries), "report_id") == [(2, "fake"), (3, "real")]


def test_listing_ignores_unknown_sort_columns(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 3.0)], "ward_id INT, s DOUBLE")
    assert [r[0] for r in ranking.listing(df, "s", 2).collect()] == [2, 3]
    assert [r[0] for r in ranking.listing(df, "nope", 2).collect()] == [1, 2]


def test_promotion(spark):
    registry = spark.createDataFrame(
        [("m", 1, "Production", "r1"), ("m", 2, "Staging", "r2"), ("n", 4, "Production", "r3")],
        "model STRING, version INT, stage STRING, run_id STRING")
    decisions = spark.createDataFrame([("m", "r9", True), ("n", "r8", False)], "model STRING, run_id STRING, passes BOOLEAN")
    assert rows(models.promote(registry, decisions), "model", "version") == [
        ("m", 1, "Archived", "r1"), ("m", 2, "Staging", "r2"), ("m", 3, "Production", "r9"), ("n", 4, "Production", "r3")]
    assert models.archive(registry, "m", 2).filter("stage = 'Archived'").count() == 1
