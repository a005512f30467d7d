"""Histograms whose bins are powers of two wide: they merge exactly, whatever ranges they were taken over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .statistics import with_key_columns

BINS = 64
# A value's place among the bins stays below 2^60, so that bins are whole numbers of 64 bits.
_PLACES = 60


def _fitting(low: Column, high: Column, bins: int) -> Column:
    """How often bins must double until those from ``low`` to ``high`` are at most ``bins``."""
    guess = F.greatest(F.lit(0), F.ceil(F.log2((high - low + 1) / float(bins)))).cast("int")
    return F.when(_halved(high, guess) - _halved(low, guess) < bins, guess).otherwise(guess + 1)


def _halved(place: Column, times: Column) -> Column:
    """The place after bins have doubled so often."""
    few = F.least(times, F.lit(62)).cast("int")
    return F.when(times > 62, F.when(place < 0, -1).otherwise(0).cast("long")).otherwise(
        F.call_function("shiftright", place, few))


def sketch(df: DataFrame, metric: str = "metric", value: str = "value", bins: int = BINS) -> DataFrame:
    """(metric, level, place, n): how many values v of a metric lie in [place, place + 1) * 2^level.

    The level is the least whose bins over the metric's range are at most ``bins``. Nulls and values that are not finite
    are left out. Two passes over the values: ranges (a row per metric, kept), then counts that are combined before the
    shuffle.
    """
    v = F.col(value).cast("double")
    known = df.select(F.col(metric).alias("metric"), v.alias("v")).filter("v is not null and v between -1.7e308 and 1.7e308")
    ends = known.groupBy("metric").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    size = F.greatest(F.abs("low"), F.abs("high"), F.lit(2.0**-900))
    least = F.ceil(F.log2(size)) - _PLACES
    span = F.col("high") - F.col("low")
    wanted = F.when(span > 0, F.ceil(F.log2(span / float(bins)))).otherwise(least)
    start = F.greatest(wanted - 1, least).cast("int")
    power = F.pow(F.lit(2.0), F.col("_start"))
    ends = ends.withColumn("_start", start).withColumn(
        "level", F.col("_start") + _fitting(F.floor(F.col("low") / power), F.floor(F.col("high") / power), bins))
    placed = with_key_columns(known, cut_lineage(ends.select("metric", "level")), "metric", "v").withColumn(
        "place", F.floor(F.col("v") / F.pow(F.lit(2.0), F.col("level"))))
    return placed.groupBy("metric", "level", "place").agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, bins: int = BINS, keys: tuple[str, ...] = ()) -> DataFrame:
    """One sketch per metric from the rows of several, at the level a sketch of all their values would have.

    ``keys`` are columns that stay apart (such as the side of a comparison) but get a common level.
    """
    top = sketches.groupBy("metric").agg(F.max("level").alias("_top"))
    raised = sketches.join(top, "metric").withColumn("place", _halved(F.col("place"), F.col("_top") - F.col("level")))
    ends = raised.groupBy("metric").agg(_fitting(F.min("place"), F.max("place"), bins).alias("_more"))
    return raised.join(ends, "metric").groupBy(
        "metric", *keys, (F.col("_top") + F.col("_more")).alias("level"), _halved(F.col("place"), F.col("_more")).alias("place")
    ).agg(F.sum("n").alias("n"))


def stability(expected: DataFrame, actual: DataFrame, bins: int = 10) -> DataFrame:
    """(metric, psi) of two sketches over at most ``bins`` common bins; empty bins between count with their floor of 1e-6.

    Metrics that only one side has are left out.
    """
    both = merged(expected.select("metric", "level", "place", "n", F.lit(0).alias("side")).unionByName(
        actual.select("metric", "level", "place", "n", F.lit(1).alias("side"))), bins, ("side",))
    counts = both.groupBy("metric", "place").agg(*[
        F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in (0, 1)])
    ends = counts.groupBy("metric").agg(
        F.min("place").alias("low"), F.max("place").alias("high"), F.sum("c0").alias("n0"), F.sum("c1").alias("n1"))
    grid = ends.filter("n0 > 0 and n1 > 0").withColumn("place", F.explode(F.sequence("low", "high")))
    full = grid.join(counts, ["metric", "place"], "left")

    def share(count: str, total: str) -> Column:
        return F.greatest(F.coalesce(F.col(count), F.lit(0)) / (F.col(total) + 1e-8), F.lit(1e-6))

    e, a = share("c0", "n0"), share("c1", "n1")
    return full.groupBy("metric").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))
