"""Distribution and error statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

# A percentile's value is found so many bits at a time, from the top, until all values that are left fit a pass.
RADIX_BITS = 20
# A table of up to so many rows goes to every task; the parts into which values of a key are dealt beyond that.
FEW_ROWS = 10_000
KEY_PARTS = 64


def correlations(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Pearson correlation per named pair in one row; undefined becomes null."""
    return df.agg(*[F.nanvl(F.corr(a, b), F.lit(None).cast("double")).alias(n) for n, (a, b) in pairs.items()])


def with_key_columns(rows: DataFrame, stored: DataFrame, key: str, value: str) -> DataFrame:
    """Inner join of ``rows`` with ``stored``, a materialised table of one row per key.

    Keys are usually few and each has many rows, so a shuffle by key alone would bring a share of all rows to one task.
    Up to 10,000 stored rows go to every task and ``rows`` stay where they are. More are repeated for 64 parts of each
    key, and rows are dealt to the parts by their value.
    """
    if stored.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        return rows.join(F.broadcast(stored), key)
    parts = stored.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(KEY_PARTS - 1).cast("long"))))
    return rows.withColumn("_part", F.pmod(F.xxhash64(value), F.lit(KEY_PARTS))).join(parts, [key, "_part"]).drop("_part")


def population_stability(
    expected: DataFrame, actual: DataFrame, metric: str, value: str, bins: int = 10
) -> DataFrame:
    """PSI per metric between two long tables, over equal-width bins of their shared range.

    Two scans: one for the range of each metric (a row per metric, kept), one that bins both sides where they lie and
    reduces them map-side to counts per (metric, bin). All bins take part, because an empty bin still contributes
    through the 1e-6 floor.
    """
    both = expected.select(metric, F.col(value).cast("double").alias("v"), F.lit(0).alias("side")).unionByName(
        actual.select(metric, F.col(value).cast("double").alias("v"), F.lit(1).alias("side"))
    ).filter(F.col("v").isNotNull())
    ranges = cut_lineage(both.groupBy(metric).agg(
        F.min("v").alias("lo"), (F.max("v") + 1e-6).alias("hi"),
        F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"),
    ).filter((F.col("n0") > 0) & (F.col("n1") > 0)))
    width = (F.col("hi") - F.col("lo")) / bins
    guess = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))
    below = F.col("v") < F.col("lo") + guess * width
    above = (F.col("v") >= F.col("lo") + (guess + 1) * width) & (guess < bins - 1)
    bin_id = (guess - below.cast("int") + above.cast("int")).cast("int")
    counts = with_key_columns(both, ranges, metric, "v").groupBy(metric, bin_id.alias("bin")).agg(
        F.count_if(F.col("side") == 0).alias("c0"), F.count_if(F.col("side") == 1).alias("c1")
    )
    grid = ranges.select(metric, "n0", "n1", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(counts, [metric, "bin"], "left")

    def share(count: str, total: str) -> Column:
        return F.greatest(F.coalesce(F.col(count), F.lit(0)) / (F.col(total) + 1e-8), F.lit(1e-6))

    e, a = share("c0", "n0"), share("c1", "n1")
    return full.groupBy(metric).agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def regression_metrics(df: DataFrame, prediction: str, target: str, by: list[str] | None = None) -> DataFrame:
    """RMSE, MAE, R2 and the two training losses' building blocks."""
    residual = F.col(prediction) - F.col(target)
    squared = residual * residual
    total = F.var_pop(target) * F.count(residual)
    return df.groupBy(*(by or [])).agg(
        F.sqrt(F.avg(squared)).alias("rmse"),
        F.avg(F.abs(residual)).alias("mae"),
        (F.lit(1.0) - F.sum(squared) / (total + 1e-8)).alias("r2"),
        (F.lit(0.7) * F.avg(squared) + F.lit(0.3) * F.avg(F.abs(residual))).alias("robust_loss"),
    )


def dual_loss(df: DataFrame, heat: tuple[str, str], flood: tuple[str, str], weights=(0.6, 0.4)) -> DataFrame:
    """Weighted MSE of two targets and their combined RMSE/MAE."""
    h, f = F.col(heat[0]) - F.col(heat[1]), F.col(flood[0]) - F.col(flood[1])
    a, b = F.lit(weights[0]), F.lit(weights[1])
    return df.agg(
        (a * F.avg(h * h) + b * F.avg(f * f)).alias("dual_loss"),
        (a * F.sqrt(F.avg(h * h)) + b * F.sqrt(F.avg(f * f))).alias("combined_rmse"),
        (a * F.avg(F.abs(h)) + b * F.avg(F.abs(f))).alias("combined_mae"),
    )


def with_order_key(df: DataFrame, value: str, name: str = "key") -> DataFrame:
    """Adds a 64-bit integer that orders like the double ``value``: its exponent and fraction bits, negated for
    negative numbers.

    NaN comes last, both zeros are one, subnormal numbers and infinities keep their places. Only exact steps are taken:
    powers of two, their products and differences. Each step is a column of its own, so that none is computed twice.
    """
    v, size, power, exponent = F.col(value), F.col("_size"), F.col("_power"), F.col("_exponent")
    plain = size.between(2.0**-1022, 1.7976931348623157e308)
    stepped = (
        df.withColumn("_size", F.abs(v))
        .withColumn("_exponent", F.when(plain, F.floor(F.log2(size)).cast("int")))
        .withColumn("_power", F.pow(F.lit(2.0), exponent))
        .withColumn("_exponent", exponent + F.when(power > size, -1).when(power * 2.0 <= size, 1).otherwise(0))
        .withColumn("_power", (size * F.pow(F.lit(2.0), -exponent) - 1.0) * float(2**52))
        .withColumn("_key", F.when(plain, F.shiftleft((exponent + 1023).cast("long"), 52) + power.cast("long"))
                    .when(F.isnan(size), F.lit(2**63 - 1).cast("long"))
                    .when(size > 1.0, F.lit(2047 << 52).cast("long"))
                    .otherwise((size * float(2**537) * float(2**537)).cast("long"))))
    return stepped.select(*df.columns, F.when(v < 0, -F.col("_key")).otherwise(F.col("_key")).alias(name))


def exact_percentiles(df: DataFrame, column: str, probabilities: list[float]) -> DataFrame:
    """Percentiles with linear interpolation, exact, by radix selection: nothing is sorted, whatever the values are.

    Values become integers of the same order. The first pass counts them by their upper 20 bits, which tells each wanted
    rank's upper bits; each further pass counts 20 bits more of the values that share them, or all that are left once
    these are at most 2^20 values. A pass shuffles at most 2^20 counters for each of the (at most twice as many as
    ``probabilities``) prefixes; only the ranks with the bits found so far, as many rows, come back between passes.
    Outliers and ties cost nothing extra. Nulls are left out, NaN is the largest value; without values there are no
    percentiles.
    """
    values = with_order_key(df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull()), "v")
    spark = df.sparkSession
    known, shift = None, 64
    while shift:
        few = known and sum({r["bits"]: r["c"] for r in known}.values()) <= 1 << RADIX_BITS
        width = shift if few else min(RADIX_BITS, shift)
        shift -= width
        prefix, rows = F.lit(0).cast("long"), values
        if known:
            prefix = F.shiftright("key", shift + width)
            rows = values.filter(prefix.isin(sorted({r["bits"] for r in known})))
        counters = rows.groupBy(prefix.alias("prefix"), F.shiftright("key", shift).alias("bits")).agg(
            F.count(F.lit(1)).alias("c"), F.max("v").alias("v"))
        group = Window.partitionBy("prefix")
        before = F.sum("c").over(group.orderBy("bits").rowsBetween(Window.unboundedPreceding, -1))
        placed = counters.select("prefix", "bits", "c", "v", F.coalesce(before, F.lit(0)).alias("start"), F.sum("c").over(group).alias("n"))
        if known is None:
            pos = (F.col("n") - 1) * F.col("p")
            asked = placed.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))).withColumn(
                "pos", pos).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos"))))).withColumn(
                "below", F.lit(0).cast("long"))
        else:
            table = F.array(*[F.struct(
                F.lit(r["p"]).alias("p"), F.lit(r["pos"]).alias("pos"), F.lit(r["rank"]).cast("long").alias("rank"),
                F.lit(r["below"]).cast("long").alias("below"), F.lit(r["bits"]).cast("long").alias("prefix")) for r in known])
            asked = placed.withColumn("_r", F.explode(F.filter(table, lambda r: r["prefix"] == F.col("prefix")))).select(
                "bits", "c", "v", "start", "_r.p", "_r.pos", "_r.rank", "_r.below")
        start = F.col("below") + F.col("start")
        known = asked.filter((start <= F.col("rank")) & (F.col("rank") < start + F.col("c"))).select(
            "p", "pos", "rank", "bits", "c", start.alias("below"), "v").collect()
        if not known:
            break
    found = spark.createDataFrame(
        [(r["p"], r["pos"], r["v"]) for r in known], "p double, pos double, v double")
    ends = found.groupBy("p", "pos").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    between = F.col("pos") - F.floor("pos")
    return ends.select("p", F.when(between == 0, F.col("a")).otherwise(
        F.col("a") + (F.col("b") - F.col("a")) * between).alias("value"))


def node_error_percentiles(
    df: DataFrame, node: str, prediction: str, target: str, probabilities: tuple[float, ...] = (0.1, 0.5, 0.9)
) -> DataFrame:
    residual = F.col(prediction) - F.col(target)
    per_node = df.groupBy(node).agg(F.sqrt(F.avg(residual * residual)).alias("rmse"))
    return exact_percentiles(per_node, "rmse", list(probabilities))


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / (population std + 1e-8) with statistics over all rows."""
    stats = df.agg(F.struct(*[
        F.struct(F.avg(c).alias("mean"), (F.stddev_pop(c) + 1e-8).alias("std")).alias(c) for c in columns
    ])).scalar()
    scaled = df.withColumn("_s", stats)
    return scaled.select(*[
        ((F.col(c) - F.col(f"_s.{c}.mean")) / F.col(f"_s.{c}.std")).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])
