"""Windows of a live stream in arrival order: keyed state, event-time timers, and late rows as a second output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import TimestampType

from ..operators.aggregates import RAIN_ANOMALY_MM, TEMPERATURE_ANOMALY_C
from .windows import LATENESS, TRIGGER, _start

MEASURES = ("temperature_c", "humidity_pct", "pm25", "rainfall_mm")
_STATE = "part long, start long, n long, " + ", ".join(f"{m} double" for m in MEASURES)
_OUT = "ward_id long, late boolean, arrival long, event long, part long, start long, n long, " + ", ".join(
    f"{m} double" for m in MEASURES)
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ArrivalWindows(StatefulProcessor):
    """A ward's open window as sums. It ends when a row of another window arrives or the watermark passes its end.

    ``width`` is the window's length in microseconds. The rows of a ward in one micro-batch are put in arrival order;
    what they hold in memory is bounded by the trigger, not by the ward's history.
    """

    def __init__(self, width: int) -> None:
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", _STATE)

    def close(self) -> None:
        pass

    def _frame(self, ward: int, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame([(ward, *row) for row in rows], columns=_COLUMNS)
        return frame.astype({c: "Int64" for c in ("arrival", "event", "part", "start", "n")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        event = batch["event"].to_numpy(np.int64)
        start = event - event % self.width
        late = start + self.width <= timerValues.getCurrentWatermarkInMs() * 1000
        values = batch[list(MEASURES)].to_numpy(float)
        out: list[tuple] = [
            (True, int(a), int(e), None, int(s), 1, *v)
            for a, e, s, v in zip(batch["arrival"][late], event[late], start[late], values[late].tolist())]
        start, values = start[~late], values[~late]
        if len(start):
            held = self.state.get() if self.state.exists() else (0, 0, 0, *[0.0] * len(MEASURES))
            part, open_start, n, *sums = held
            if n:
                self.handle.deleteTimer((open_start + self.width) // 1000)
            first = np.flatnonzero(np.r_[True, start[1:] != start[:-1]])
            totals = np.add.reduceat(values, first, axis=0)
            sizes = np.diff(np.r_[first, len(start)])
            for at, total, size in zip(first, totals, sizes):
                if n and start[at] == open_start:
                    n, sums = n + int(size), [a + b for a, b in zip(sums, total)]
                    continue
                if n:
                    out.append((False, None, None, part, open_start, n, *sums))
                part, open_start, n, sums = part + 1, int(start[at]), int(size), total.tolist()
            self.state.update((part, open_start, n, *map(float, sums)))
            self.handle.registerTimer((open_start + self.width) // 1000)
        if out:
            yield self._frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            part, start, n, *sums = self.state.get()
            if n and (start + self.width) // 1000 <= timerValues.getCurrentWatermarkInMs():
                self.state.update((part, start, 0, *sums))
                yield self._frame(key[0], [(False, None, None, part, start, n, *sums)])


def arrival_stream(readings: DataFrame, arrival: str = "arrival", minutes: int = 15, lateness: str = LATENESS) -> DataFrame:
    """Partial windows as ``running.arrival_order_windows`` gives them, and the rows that came too late for theirs.

    ``readings`` is a stream with ward_id, ts, an ``arrival`` number that grows with time, and the measures. A row is
    late when its window's end is not after the watermark of its micro-batch. Rows with ``late`` carry ``arrival``,
    ``event`` and their own measures; the others are windows with ``part`` (numbered per ward), ``start``, the number of
    rows ``n`` and the sums of the measures. Times are microseconds since 1970.
    """
    timed = readings
    if not isinstance(readings.schema["ts"].dataType, TimestampType):
        timed = readings.withColumn("ts", F.col("ts").cast("timestamp"))
    # the event time goes on as a number: the watermark advances, and no row is dropped before it is seen
    rows = timed.withWatermark("ts", lateness).select(
        F.col("ward_id").cast("long").alias("ward_id"), F.col(arrival).cast("long").alias("arrival"),
        F.unix_micros("ts").alias("event"), *[F.col(m).cast("double").alias(m) for m in MEASURES])
    return rows.groupBy("ward_id").transformWithStateInPandas(
        ArrivalWindows(minutes * 60_000_000), _OUT, "append", "eventtime")


def publish_arrivals(stream: DataFrame, path: str, checkpoint: str, once: bool = False, every: str = TRIGGER) -> StreamingQuery:
    """Two outputs below ``path``, late=false and late=true, with a folder per micro-batch that a retry replaces.

    Timers need the RocksDB state store; the session's own choice is put back once the query has started.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("late", "batch").parquet(path)

    conf = stream.sparkSession.conf
    before = conf.get(_STORE, None)
    conf.set(_STORE, _ROCKS)
    try:
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
        return _start(writer, once, every)
    finally:
        if before is None:
            conf.unset(_STORE)
        else:
            conf.set(_STORE, before)


def closed_parts(rows: DataFrame, minutes: int = 15) -> DataFrame:
    """The stored windows with the columns of ``running.arrival_order_windows`` (without ``open``: none of them is)."""
    mean = {m: F.col(m) / F.col("n") for m in MEASURES}
    anomaly = (mean["temperature_c"] > TEMPERATURE_ANOMALY_C) | (F.col("rainfall_mm") > RAIN_ANOMALY_MM)
    return rows.filter("not late").select(
        "ward_id", "part", F.timestamp_micros("start").alias("window_start"),
        F.timestamp_micros(F.col("start") + minutes * 60_000_000).alias("window_end"),
        mean["temperature_c"].alias("avg_temperature_c"), mean["humidity_pct"].alias("avg_humidity_pct"),
        mean["pm25"].alias("avg_pm25"), F.col("rainfall_mm").alias("sum_rainfall_mm"), F.col("n").alias("reading_count"),
        anomaly.cast("int").alias("has_anomaly"))


def late_rows(rows: DataFrame) -> DataFrame:
    """The stored late readings."""
    return rows.filter("late").select("ward_id", "arrival", F.timestamp_micros("event").alias("ts"), *MEASURES)


def published(stream: DataFrame, path: str) -> DataFrame:
    """Everything ``publish_arrivals`` has written."""
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
