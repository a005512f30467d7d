"""Active keys of sliding windows against a plain count."""

from __future__ import annotations

import datetime as dt
import random

from conftest import rows

from wardlens.operators import sliding

DAY = dt.datetime(2024, 4, 9, 23, 40)


def readings(spark, data):
    return spark.createDataFrame([(k, None if m is None else DAY + dt.timedelta(minutes=m, seconds=s)) for k, m, s in data],
                                 "sensor string, ts timestamp")


def plain(data, minutes):
    seen = {(k, m) for k, m, _ in data if k is not None and m is not None}
    times = [m for _, m in seen]
    return {m: len({k for k, at in seen if m - minutes < at <= m}) for m in range(min(times), max(times) + 1)}


def found(df):
    return {round((r[0] - DAY).total_seconds() / 60): r[1] for r in rows(df.selectExpr("cast(minute_start as timestamp_ntz)", "active"))}


def test_active_keys_match_a_plain_count(spark):
    rng = random.Random(4)
    data = [(f"s{rng.randrange(30)}" if rng.random() < 0.7 else "busy", rng.randrange(300), rng.randrange(60)) for _ in range(600)]
    data += [("late", 900, 0), (None, 5, 0), ("s1", None, 0), *[("busy", 7, 1)] * 50]
    df = readings(spark, data).repartition(3)
    for minutes in (1, 10):
        assert found(sliding.active_keys(df, "sensor", minutes=minutes)) == plain(data, minutes)
    assert sliding.active_keys(df.limit(0), "sensor").collect() == []


def test_sketches_merge_to_close_estimates(spark):
    rng = random.Random(5)
    data = [(f"s{rng.randrange(20_000)}", rng.randrange(40), 0) for _ in range(30_000)]
    df = readings(spark, data)
    guesses, exact = found(sliding.active_keys_estimate(sliding.minute_sketches(df, "sensor"))), plain(data, 10)
    assert set(guesses) == set(exact)
    assert all(abs(guesses[m] - n) <= 5 * 0.01625 * n for m, n in exact.items())
