"""Ward windows, running computations and their behaviour on hot keys."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from wardlens.operators import aggregates, running, series

START = dt.datetime(2024, 4, 9, 13, 30)


def readings(spark, data):
    return spark.createDataFrame(
        [(w, START + dt.timedelta(seconds=s), t, 50.0, 30.0, r) for w, s, t, r in data],
        "ward_id INT, ts TIMESTAMP, temperature_c DOUBLE, humidity_pct DOUBLE, pm25 DOUBLE, rainfall_mm DOUBLE")


def test_window_edges_and_anomaly_limits(spark):
    data = [(1, 0, 40.0, 5.0), (1, 899, 40.0, 15.0), (1, 900, 40.1, 0.0), (2, 10, 20.0, 20.001), (3, 10, 20.0, 20.0)]
    got = rows(aggregates.ward_windows(readings(spark, data)), "ward_id", "window_start")
    assert [(r[0], r[1], r[7], r[8]) for r in got] == [
        (1, START, 2, 0),  # exactly 40.0 and 20.0 are no anomaly
        (1, START + dt.timedelta(minutes=15), 1, 1),
        (2, START, 1, 1),
        (3, START, 1, 0),
    ]


def test_flag_is_computed_before_rounding(spark):
    window = aggregates.rounded_windows(aggregates.ward_windows(readings(spark, [(1, 0, 40.001, 0.0)]))).first()
    assert window["avg_temperature_c"] == 40.0 and window["has_anomaly"] == 1


def hot_key_frame(spark, n=600):
    rng = random.Random(7)
    data = [(0 if i % 3 == 0 else rng.randrange(40), i, rng.randrange(1000) / 8) for i in range(n)]
    return data, spark.createDataFrame(data, "k INT, i BIGINT, v DOUBLE")


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_running_aggregates_equal_plain_windows(spark, block):
    data, df = hot_key_frame(spark)
    out = running.running(df, ["k"], ["i"], F.floor(F.col("i") / block), {
        "total": ("sum", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v"))})
    frame = pd.DataFrame(data, columns=["k", "i", "v"]).sort_values(["k", "i"])
    frame["total"] = frame.groupby("k").v.cumsum()
    frame["low"] = frame.groupby("k").v.cummin()
    frame["high"] = frame.groupby("k").v.cummax()
    assert rows(out, "k", "i") == [tuple(r) for r in frame.itertuples(index=False)]


def test_running_sum_gives_peers_one_value(spark):
    data = [(1, 0, 20.0, 1.0), (1, 5, 20.0, 2.0), (1, 5, 20.0, 4.0), (1, 90_000, 20.0, 8.0), (2, 5, 20.0, 0.5)]
    out = running.running_sum_by_time(readings(spark, data), "ward_id", "ts", "rainfall_mm")
    assert sorted(r["running"] for r in out.collect()) == [0.5, 1.0, 7.0, 7.0, 15.0]


@pytest.mark.parametrize("block", [19, 64])
def test_rolling_mean_crosses_blocks(spark, block):
    data = [(k, i, float(i * (k + 1) % 17)) for k in range(2) for i in range(150)]
    df = spark.createDataFrame(data, "k INT, i BIGINT, v DOUBLE")
    got = rows(running.rolling_mean(df, "k", "i", ["v"], 20, block).select("k", "i", "v_mean"), "k", "i")
    frame = pd.DataFrame(data, columns=["k", "i", "v"])
    expected = frame.groupby("k").v.rolling(20, min_periods=1).mean().tolist()
    assert [r[2] for r in got] == pytest.approx(expected)


def test_forward_fill(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 1.0, None, None, 5.0, None])], "k INT, i BIGINT, v DOUBLE")
    got = rows(running.forward_fill(df, "k", "i", ["v"], block=2), "i")
    assert [r[2] for r in got] == [None, 1.0, 1.0, 1.0, 5.0, 5.0]


def test_early_stop(spark):
    values = [5.0, 4.0, 4.0, 4.5, 3.0, 3.1, 3.2, 3.3, 1.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "run STRING, epoch BIGINT, v DOUBLE")
    got = {r["epoch"]: r for r in running.early_stop(df, "run", "epoch", "v", 3, block=2).collect()}
    assert [got[i]["streak"] for i in range(9)] == [0, 0, 1, 2, 0, 1, 2, 3, 0]
    assert [i for i in range(9) if got[i]["active"]] == list(range(8))  # stops after epoch 7
    assert got[8]["stop_epoch"] == 7


def test_arrival_order_reopens_windows(spark):
    minute = 60
    arrivals = [0, 16 * minute, 1 * minute, 17 * minute]  # window A, B, A again, B again
    df = readings(spark, [(1, s, 20.0, 1.0) for s in arrivals])
    ordered = df.withColumn("arrival", F.monotonically_increasing_id())
    numbered = df.sparkSession.createDataFrame(
        [(1, START + dt.timedelta(seconds=s), 20.0, 50.0, 30.0, 1.0, i) for i, s in enumerate(arrivals)],
        ordered.schema)
    out = rows(running.arrival_order_windows(numbered).select("part", "window_start", "reading_count", "open"), "part")
    late = START + dt.timedelta(minutes=15)
    assert out == [(1, START, 1, False), (2, late, 1, False), (3, START, 1, False), (4, late, 1, True)]


def test_counter_rate_survives_a_reset(spark):
    stamps = [(0, 10.0), (60, 16.0), (120, 2.0), (180, 5.0)]
    df = spark.createDataFrame([("c", START + dt.timedelta(seconds=s), v) for s, v in stamps], "name STRING, ts TIMESTAMP, value DOUBLE")
    row = series.counter_rate(df, ["name"], 300).first()
    assert row["increase"] == 11.0 and row["rate"] == pytest.approx(11 / 180)


def test_histogram_quantile_in_the_last_bucket(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 5.0, 4), ("a", float("inf"), 10)], "k STRING, le DOUBLE, count BIGINT")
    assert series.histogram_quantile(df, ["k"], 0.99).first()["quantile"] == 5.0
    assert series.histogram_quantile(df, ["k"], 0.3).first()["quantile"] == 3.0
