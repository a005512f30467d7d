"""Counter and histogram series: rates, quantiles from buckets, last values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import latest_per_key
from .running import running


def label(name: str) -> Column:
    return F.try_element_at(F.col("labels"), F.lit(name))


def counter_increases(samples: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", block: str = "hour"):
    """Each sample's increase over the previous one of its series; after a reset the value itself is the increase.

    ``samples`` has at most one row per (keys, ts).
    """
    previous = running(
        samples, keys, [ts], F.date_trunc(block, F.col(ts)),
        {"_prev": ("max", F.struct(F.col(ts).alias("t"), F.col(value).alias("v")))}, include_current=False,
    )
    increase = F.when(F.col(value) >= F.col("_prev.v"), F.col(value) - F.col("_prev.v")).otherwise(F.col(value))
    return previous.withColumn("increase", F.when(F.col("_prev").isNotNull(), increase)).withColumn(
        "previous_ts", F.col("_prev.t")).drop("_prev")


def counter_rate(
    samples: DataFrame, keys: list[str], seconds: int, ts: str = "ts", value: str = "value", block: str = "hour"
) -> DataFrame:
    """Per-second rate of a counter in tumbling windows: increase between a window's samples over their elapsed time.

    A window needs two samples, as the first one only gives the starting level.
    """
    steps = counter_increases(samples, keys, ts, value, block)
    window = F.window(ts, f"{seconds} seconds")
    inside = steps.withColumn("_w", window).withColumn(
        "_step", F.when(F.col("previous_ts") >= F.col("_w.start"), F.col("increase"))
    )
    rated = inside.groupBy(*keys, F.col("_w.start").alias("window_start")).agg(
        F.sum("_step").alias("increase"), F.min(ts).alias("_first"), F.max(ts).alias("_last"),
        F.count(F.lit(1)).alias("samples"),
    ).filter((F.col("samples") > 1) & (F.col("_last") > F.col("_first")))
    elapsed = (F.unix_micros(F.col("_last").cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))) / 1e6
    return rated.select(*keys, "window_start", "samples", "increase", (F.col("increase") / elapsed).alias("rate"))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float, bound: str = "le", count: str = "count"):
    """Quantile from cumulative bucket counts, linear inside the bucket that reaches q of the total.

    ``bound`` is the bucket's upper bound (infinity for the last). The lowest bucket starts at 0; a quantile in the
    last bucket is the highest finite bound. A series has a handful of buckets, so a window per series is small.
    """
    order = Window.partitionBy(*keys).orderBy(bound)
    steps = buckets.withColumn("_low", F.lag(bound).over(order)).withColumn("_below", F.lag(count).over(order))
    total = F.max(count).over(Window.partitionBy(*keys))
    hit = steps.withColumn("_total", total).filter((F.col("_total") > 0) & (F.col(count) >= F.lit(q) * F.col("_total")))
    first = hit.groupBy(*keys).agg(
        F.min_by(F.struct(bound, count, "_low", "_below", "_total"), bound).alias("b")
    )
    low, below = F.coalesce(F.col("b._low"), F.lit(0.0)), F.coalesce(F.col("b._below"), F.lit(0))
    high = F.col(f"b.{bound}")
    inside = F.col(f"b.{count}") - below
    share = F.when(inside > 0, (F.lit(q) * F.col("b._total") - below) / inside).otherwise(F.lit(0.0))
    value = F.when(high == float("inf"), low).otherwise(low + (high - low) * share)
    return first.select(*keys, value.alias("quantile"))


def bucket_counts(observations: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative histogram of raw observations: one partial count per bound, then long form."""
    counted = observations.groupBy(*keys).agg(
        *[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)],
        F.count(value).alias("_inf"),
    )
    entries = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("count")) for i, b in enumerate(bounds)]
    entries.append(F.struct(F.lit(float("inf")).alias("le"), F.col("_inf").alias("count")))
    return counted.select(*keys, F.explode(F.array(*entries)).alias("b")).select(*keys, "b.*")


def latest_value(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return latest_per_key(samples, keys, order)
