"""The arrival-order stream: partial windows, timers, late rows, restarts and retried batches."""

from __future__ import annotations

import datetime as dt
import random

from wardlens.sources.files import follow_parquet
from wardlens.streaming import arrivals

DAY = dt.datetime(2024, 4, 9, tzinfo=dt.timezone.utc)
SCHEMA = "ward_id long, arrival long, ts timestamp, temperature_c double, humidity_pct double, pm25 double, rainfall_mm double"
WIDTH = 15 * 60


class Run:
    """A folder that rows land in, and the stream over it, started anew for every batch."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path = spark, tmp_path
        self.shape = spark.createDataFrame([], SCHEMA).schema

    def land(self, rows):
        data = [(w, a, DAY + dt.timedelta(seconds=s), t, 50.0, 30.0, 1.0) for w, a, s, t in rows]
        self.spark.createDataFrame(data, SCHEMA).repartition(2).write.mode("append").parquet(f"{self.path}/in")

    def start(self):
        stream = arrivals.arrival_stream(follow_parquet(self.spark, f"{self.path}/in", self.shape))
        query = arrivals.publish_arrivals(stream, f"{self.path}/out", f"{self.path}/state", once=True)
        query.awaitTermination()
        assert query.exception() is None
        return arrivals.published(stream, f"{self.path}/out")


def seconds(stamp):
    return round((stamp.replace(tzinfo=dt.timezone.utc) - DAY).total_seconds())


def parts(stored):
    return sorted((r.ward_id, r.part, seconds(r.window_start), r.reading_count, r.avg_temperature_c)
                  for r in arrivals.closed_parts(stored).collect())


def late(stored):
    return sorted((r.ward_id, r.arrival, seconds(r.ts)) for r in arrivals.late_rows(stored).collect())


def test_windows_close_by_rows_and_by_timers(spark, tmp_path):
    run = Run(spark, tmp_path)
    run.land([(1, 1, 60, 20.0), (1, 2, 120, 22.0), (2, 3, 30, 45.0)])
    assert parts(run.start()) == []  # all are open
    run.land([(1, 4, WIDTH + 5, 20.0), (1, 5, 300, 30.0)])  # another window, then the first one again
    assert parts(run.start()) == [(1, 1, 0, 2, 21.0), (1, 2, WIDTH, 1, 20.0)]
    run.land([(3, 6, 4 * WIDTH, 10.0)])
    stored = run.start()  # the watermark passes the open windows of both wards: timers close them
    assert parts(stored) == [(1, 1, 0, 2, 21.0), (1, 2, WIDTH, 1, 20.0), (1, 3, 0, 1, 30.0), (2, 1, 0, 1, 45.0)]
    assert late(stored) == []
    run.land([(1, 7, 10, 99.0), (2, 8, 4 * WIDTH + 1, 1.0)])  # behind the watermark: kept apart
    stored = run.start()
    assert late(stored) == [(1, 7, 10)] and len(parts(stored)) == 4
    before = parts(stored), late(stored)
    stored = run.start()  # nothing new: a restart repeats nothing
    assert (parts(stored), late(stored)) == before


def test_any_cut_into_batches_gives_the_windows_of_one_pass(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice((1, 1, 1, 2)), k, 20 * k + rng.choice((0, 0, 0, -1000, -20_000)) + 20_000, float(rng.randrange(50)))
            for k in range(400)]
    run, mark, expected_late, kept = Run(spark, tmp_path), None, [], []
    for n in range(4):
        chunk = rows[n * 100 : (n + 1) * 100]
        for w, a, s, t in chunk:
            behind = mark is not None and (s // WIDTH + 1) * WIDTH <= mark
            (expected_late if behind else kept).append((w, a, s, t))
        mark = max(s for _, _, s, _ in rows[: (n + 1) * 100]) - 30
        rng.shuffle(chunk)
        run.land(chunk)
        stored = run.start()
    expected, now = [], {}
    for w, _, s, t in kept:
        held = now.get(w)
        if held is None or held[1] != s // WIDTH:
            expected += [held] if held else []
            now[w] = held = [(held[0][0], held[0][1] + 1) if held else (w, 1), s // WIDTH, 0, 0.0]
        held[2], held[3] = held[2] + 1, held[3] + t
    expected += [h for h in now.values() if (h[1] + 1) * WIDTH <= mark]
    assert parts(stored) == sorted((w, p, b * WIDTH, n, t / n) for (w, p), b, n, t in expected)
    assert late(stored) == sorted((w, a, s) for w, a, s, _ in expected_late) and expected_late
