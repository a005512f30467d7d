"""Sensor stream to ward windows and anomaly alerts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampType

from ..operators.aggregates import anomalies, ward_windows

LATENESS = "30 seconds"
TRIGGER = "60 seconds"


def windowed_stream(readings: DataFrame, minutes: int = 15, lateness: str = LATENESS) -> DataFrame:
    """Closed ward windows of a stream of readings.

    The state holds sums and counts of the open windows only. A row whose window has closed is dropped; progress
    reports count them (see ``dropped_late_rows``).
    """
    timed = readings
    if not isinstance(readings.schema["ts"].dataType, TimestampType):
        timed = readings.withColumn("ts", F.col("ts").cast("timestamp"))
    return ward_windows(timed.withWatermark("ts", lateness), minutes)


def _start(writer, once: bool, every: str) -> StreamingQuery:
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return writer.trigger(**trigger).start()


def append_stream(
    df: DataFrame, path: str, checkpoint: str, once: bool = False, every: str = TRIGGER
) -> StreamingQuery:
    """Append to a Parquet table, exactly once."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint)
    return _start(writer, once, every)


def publish_windows(
    windows: DataFrame, features_path: str, alerts_path: str, checkpoint: str, once: bool = False, every: str = TRIGGER
) -> StreamingQuery:
    """One stateful query, two outputs: all windows and the anomalous ones.

    Each micro-batch writes its own folder in overwrite mode, so a batch that is retried after a failure replaces its
    first attempt instead of adding to it. The batch is not cached: closed windows are few, and a cached copy would be
    lost with its executor.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"batch={batch_id}"
        batch.write.mode("overwrite").parquet(os.path.join(features_path, folder))
        stored = batch.sparkSession.read.schema(batch.schema).parquet(os.path.join(features_path, folder))
        anomalies(stored).write.mode("overwrite").parquet(os.path.join(alerts_path, folder))

    writer = windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return _start(writer, once, every)


def dropped_late_rows(query: StreamingQuery) -> int:
    """Late rows dropped so far, from the query's recent progress reports."""
    total = 0
    for progress in query.recentProgress:
        for operator in progress["stateOperators"]:
            total += operator["numRowsDroppedByWatermark"]
    return total
