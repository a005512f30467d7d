"""Ordered computations per key that stay parallel when one key holds most rows.

A plain ``OVER (PARTITION BY key ORDER BY ts)`` sends a whole key to one task. Here every key's order is cut into blocks
by a column that never decreases along the order (a truncated timestamp, a divided sequence number). Each block is one
window partition, and a per-block total carries the state of earlier blocks in. Only the block totals are windowed by
key alone, and there is one such row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(
            carried.isNotNull() | local.isNotNull(),
            F.coalesce(carried, F.lit(0).cast("double")) + F.coalesce(local, F.lit(0).cast("double")),
        )
    return F.least(carried, local) if kind == "min" else F.greatest(carried, local)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    aggs: dict[str, tuple[str, Column]],
    include_current: bool = True,
) -> DataFrame:
    """Running sum/min/max over ROWS UNBOUNDED PRECEDING .. CURRENT (or .. 1 PRECEDING).

    The input is read twice (block totals, rows), so a chain of running computations stores each step's result first.
    ``aggs`` maps an output name to (kind, value); sums come back as double. ``order`` must be unique per key.
    ``max`` over a struct whose first field is the order gives "last value so far".
    """
    named = df.withColumn("_block", block)
    for i, (_, value) in enumerate(aggs.values()):
        named = named.withColumn(f"_v{i}", value)
    kinds = [kind for kind, _ in aggs.values()]

    totals = named.groupBy(*keys, "_block").agg(*[_AGG[k](f"_v{i}").alias(f"_t{i}") for i, k in enumerate(kinds)])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_block", *[_AGG[k](f"_t{i}").over(before).alias(f"_c{i}") for i, k in enumerate(kinds)]
    )

    end = Window.currentRow if include_current else -1
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    joined = named.join(carried, [*keys, "_block"])
    columns = [
        _combine(k, F.col(f"_c{i}"), _AGG[k](f"_v{i}").over(inside)).alias(name)
        for i, (name, k) in enumerate(zip(aggs, kinds))
    ]
    return joined.select(*df.columns, *columns)


def ordinal(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str = "idx") -> DataFrame:
    """Row number from 0 in ``order`` per key."""
    out = running(df, keys, order, block, {name: ("sum", F.lit(1))}, include_current=False)
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("long"))


def with_halo(df: DataFrame, index: str, lookback: int, size: int) -> DataFrame:
    """Cut a dense index into blocks of ``size`` and copy each block's last ``lookback`` rows into the next block.

    A window partitioned by (key, _block) then sees every row's ``lookback`` predecessors; ``_own`` marks the rows that
    belong to the block. ``size`` >= ``lookback`` keeps it to one copy per row at most.
    """
    if size < lookback:
        raise ValueError("block size must be at least the lookback")
    own = F.floor(F.col(index) / size).cast("long")
    tail = F.pmod(F.col(index), F.lit(size)) >= size - lookback
    blocks = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == own)


def running_sum_by_time(
    df: DataFrame, key: str, ts: str, value: str, name: str = "running", block: str = "day"
) -> DataFrame:
    """SUM(value) OVER (PARTITION BY key ORDER BY ts): rows of one instant share the value (RANGE frame).

    Rows of one instant are summed first, so an instant shared by many rows is one row in the blocks.
    """
    instants = df.groupBy(key, ts).agg(F.sum(value).alias("_sum"))
    sums = running(instants, [key], [ts], F.date_trunc(block, F.col(ts)), {name: ("sum", F.col("_sum"))})
    return df.join(sums.select(key, ts, name), [key, ts])


def rolling_mean(
    df: DataFrame, key: str, index: str, values: list[str], size: int = 20, block: int = 4096
) -> DataFrame:
    """Mean over the current and the size-1 previous rows of a dense per-key index."""
    frame = Window.partitionBy(key, "_block").orderBy(index).rowsBetween(-(size - 1), 0)
    spread = with_halo(df, index, size - 1, block)
    means = [F.avg(v).over(frame).alias(f"{v}_mean") for v in values]
    return spread.select(*df.columns, "_own", *means).filter("_own").drop("_own")


def forward_fill(df: DataFrame, key: str, index: str, values: list[str], block: int = 4096) -> DataFrame:
    """Last non-null value up to the current row of a per-key integer index."""
    aggs = {
        f"_last_{v}": ("max", F.when(F.col(v).isNotNull(), F.struct(F.col(index).alias("i"), F.col(v).alias("x"))))
        for v in values
    }
    out = running(df, [key], [index], F.floor(F.col(index) / block), aggs)
    return out.select(
        *[F.col(f"_last_{c}.x").alias(c) if c in values else F.col(c) for c in df.columns]
    )


def early_stop(
    metrics: DataFrame, key: str, epoch: str, value: str, patience: int, block: int = 4096
) -> DataFrame:
    """Best-so-far, streak without improvement, and whether training had stopped before the epoch.

    An epoch improves when its value is below every earlier one. Training stops at the first epoch whose streak reaches
    ``patience``; ``active`` is false for later epochs. ``epoch`` counts from 0 without gaps per key.
    """
    chunk = F.floor(F.col(epoch) / block)
    best = running(metrics, [key], [epoch], chunk, {"best_before": ("min", F.col(value))}, include_current=False)
    improved = F.col("best_before").isNull() | (F.col(value) < F.col("best_before"))
    flagged = cut_lineage(best).withColumn("improved", improved).withColumn("best", F.least(value, "best_before"))
    marked = cut_lineage(running(
        flagged, [key], [epoch], chunk, {"_last": ("max", F.when(F.col("improved"), F.col(epoch)))}
    ).withColumn("streak", (F.col(epoch) - F.col("_last")).cast("long")))
    stops = marked.groupBy(key).agg(F.min(F.when(F.col("streak") >= patience, F.col(epoch))).alias("stop_epoch"))
    return (
        marked.join(stops, key)
        .withColumn("active", F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
        .drop("_last", "best_before")
    )


def arrival_order_windows(
    readings: DataFrame, arrival: str = "arrival", minutes: int = 15, block: int = 100_000
) -> DataFrame:
    """Windows as a one-pass reader would emit them: a ward's open window closes when a row of another window arrives.

    Out-of-order rows reopen a window, so one (ward, window) may yield several partial rows. ``part`` numbers a ward's
    output rows in arrival order; ``open`` marks the last one, which only a final flush would emit.
    """
    from .aggregates import window_measures

    bucket = F.window("ts", f"{minutes} minutes")
    rows = readings.withColumn("window_start", bucket["start"]).withColumn("window_end", bucket["end"])
    chunk = F.floor(F.col(arrival) / block)
    previous = running(
        rows, ["ward_id"], [arrival], chunk,
        {"_prev": ("max", F.struct(F.col(arrival).alias("a"), F.col("window_start").alias("w")))},
        include_current=False,
    )
    opens = F.col("_prev").isNull() | (F.col("_prev.w") != F.col("window_start"))
    islands = running(
        cut_lineage(previous.withColumn("_opens", opens.cast("int")).drop("_prev")), ["ward_id"], [arrival], chunk,
        {"part": ("sum", F.col("_opens"))},
    )
    parts = cut_lineage(islands.groupBy(
        "ward_id", F.col("part").cast("long").alias("part"), "window_start", "window_end"
    ).agg(*window_measures()))
    last = parts.groupBy("ward_id").agg(F.max("part").alias("_max"))
    return parts.join(last, "ward_id").withColumn("open", F.col("part") == F.col("_max")).drop("_max")
