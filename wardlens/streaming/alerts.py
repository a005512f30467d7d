"""Alert relay, dedupe and periodic evaluation."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ranking import most_recent
from ..plans.risk import threshold_alerts
from ..sources.messages import valid_json
from .windows import _start

ALERT_EVERY = "15 seconds"


def relay(messages: DataFrame) -> DataFrame:
    return valid_json(messages)


def dedupe_stream(alerts: DataFrame, lateness: str = "10 minutes", by_type: bool = False) -> DataFrame:
    """First alert per (ward, millisecond); keys are forgotten once the watermark passes them."""
    keys = ["ward_id", "ts_ms"] + (["alert_type"] if by_type else [])
    stamped = alerts.withColumn("ts_ms", F.unix_millis("timestamp"))
    return stamped.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(keys)


def publish_newest(
    alerts: DataFrame, path: str, checkpoint: str, keep: int = 50, once: bool = False
) -> StreamingQuery:
    """The newest alerts of each micro-batch, one folder per batch; all of its alerts are kept in ``path``.all."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(f"{path.rstrip('/')}.all", f"batch={batch_id}"))
        newest = most_recent(batch, "timestamp", keep, "ward_id")
        newest.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))

    writer = alerts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return _start(writer, once, ALERT_EVERY)


def evaluate_alerts(
    ticks: DataFrame, risks: Callable[[], DataFrame], path: str, checkpoint: str, once: bool = False,
    every: str = ALERT_EVERY,
) -> StreamingQuery:
    """Evaluate the threshold rules over the current risk table at every trigger.

    ``ticks`` is any stream with a ``timestamp`` column (for example the rate source); ``risks`` re-reads the table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        as_of = batch.agg(F.max("timestamp")).scalar()
        threshold_alerts(risks(), as_of).write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))

    writer = ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return _start(writer, once, every)
