"""Drift of streamed predictions against a stored baseline."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.histograms import merged, sketch, stability
from ..plans.quality import drift_report
from .windows import _start


def monitor_drift(
    predictions: DataFrame, baseline: DataFrame, path: str, checkpoint: str, once: bool = False,
    every: str = "60 seconds",
) -> StreamingQuery:
    """PSI of each micro-batch's (metric, value) rows against the baseline, one folder per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        report = drift_report(baseline, batch)
        report.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))

    writer = predictions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return _start(writer, once, every)


def monitor_sketches(
    predictions: DataFrame, baseline: DataFrame, path: str, checkpoint: str, once: bool = False,
    every: str = "60 seconds",
) -> StreamingQuery:
    """PSI of each micro-batch against a baseline sketch, and the micro-batch's own sketch, one folder per batch each.

    ``baseline`` is a stored ``histograms.sketch``: the values it was taken from are not read again. The sketches below
    ``path``/sketches merge to that of the whole stream (``stream_sketch``). A retried batch replaces its folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        own = os.path.join(path, "sketches", f"batch={batch_id}")
        sketch(batch).write.mode("overwrite").parquet(own)
        stored = batch.sparkSession.read.parquet(own)
        stability(baseline, stored).write.mode("overwrite").parquet(os.path.join(path, "reports", f"batch={batch_id}"))

    writer = predictions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return _start(writer, once, every)


def stream_sketch(predictions: DataFrame, path: str) -> DataFrame:
    """The sketch of all that ``monitor_sketches`` has seen, merged from its micro-batches'."""
    rows = predictions.sparkSession.read.schema("metric string, level int, place long, n long").parquet(os.path.join(path, "sketches"))
    return merged(rows.select("metric", "level", "place", "n"))
