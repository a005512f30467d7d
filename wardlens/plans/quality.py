"""Data-quality report, pipeline gates and drift check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.aggregates import drift_level
from ..operators.sets import missing_keys
from ..operators.statistics import population_stability
from ..sinks.files import save_baseline

# Closed ranges of the ward snapshot.
RANGES = {
    "ward_id": (1, 198),
    "centroid_lat": (12.77, 13.18),
    "centroid_lon": (77.35, 77.82),
    "lst_celsius": (15, 60),
    "ndvi": (0, 1),
    "impervious_pct": (0, 100),
    "rainfall_mm_24h": (0, 500),
    "pm25_ugm3": (0, 500),
    "population_density": (0, 100000),
    "heat_stress_score": (0, 100),
    "flood_risk_score": (0, 100),
}
SUMMARY = ("lst_celsius", "ndvi", "impervious_pct", "rainfall_mm_24h", "heat_stress_score", "flood_risk_score")
PAIRS = {
    "heat_vs_lst": ("heat_stress_score", "lst_celsius"),
    "flood_vs_rain": ("flood_risk_score", "rainfall_mm_24h"),
    "heat_vs_impervious": ("heat_stress_score", "impervious_pct"),
}


def quality_counts(df: DataFrame, ranges: dict[str, tuple[float, float]] = RANGES) -> DataFrame:
    """Row count, nulls and range violations per column in one pass. A null never violates a range."""
    present = {c: r for c, r in ranges.items() if c in df.columns}
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns],
        *[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"bad_{c}") for c, (lo, hi) in present.items()],
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).agg(
        F.count(F.lit(1)).alias("duplicate_keys"))


def quality_report(df: DataFrame, expected_rows: int = 198, ranges: dict[str, tuple[float, float]] = RANGES) -> DataFrame:
    """One row: status, issues, null counts, range violations, correlations and summary statistics.

    Counts, correlations and summaries come from a single aggregate; duplicate and missing keys are scalar subqueries.
    """
    columns = df.columns
    present = [c for c in ranges if c in columns]
    absent = [c for c in ranges if c not in columns]
    summary = [c for c in SUMMARY if c in columns]
    pairs = {n: p for n, p in PAIRS.items() if p[0] in columns and p[1] in columns}
    row = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n")) for c in columns])
        .alias("nulls"),
        F.array(*[F.struct(F.lit(c).alias("column"),
                           F.count_if((F.col(c) < ranges[c][0]) | (F.col(c) > ranges[c][1])).alias("n"),
                           F.lit(f"[{ranges[c][0]}, {ranges[c][1]}]").alias("bounds"))
                  for c in present]).alias("ranges"),
        F.struct(*[F.round(F.nanvl(F.corr(a, b), F.lit(None).cast("double")), 4).alias(n)
                   for n, (a, b) in pairs.items()]).alias("correlations"),
        F.struct(*[F.struct(F.min(c).alias("min"), F.avg(c).alias("mean"), F.max(c).alias("max")).alias(c)
                   for c in summary]).alias("summary_stats"),
    )
    duplicates = duplicate_keys(df, "ward_id").scalar()
    missing = missing_keys(df, "ward_id", 1, expected_rows).agg(F.count(F.lit(1))).scalar()
    counted = row.withColumn("duplicates", duplicates).withColumn("missing", missing)
    found = counted.withColumn("null_counts", F.filter("nulls", lambda x: x["n"] > 0)).withColumn(
        "range_violations", F.filter("ranges", lambda x: x["n"] > 0))
    # The texts of the issues.
    issues = F.concat(
        F.array_compact(F.array(
            F.when(F.col("row_count") != expected_rows,
                   F.format_string(f"Expected {expected_rows} wards, found %d", F.col("row_count"))),
            F.when(F.col("duplicates") > 0, F.lit("ward_id contains duplicates")),
            F.when(F.col("missing") > 0, F.lit("ward_id sequence is incomplete")),
            *[F.lit(f"Missing required column: {c}") for c in absent],
        )),
        F.transform("null_counts", lambda x: F.format_string("Null values in %s: %d", x["column"], x["n"])),
        F.transform("range_violations", lambda x: F.format_string(
            "%s has %d value(s) outside %s", x["column"], x["n"], x["bounds"])),
    )
    return found.withColumn("issues", issues).select(
        F.when(F.size("issues") == 0, "pass").otherwise("fail").alias("status"),
        "row_count", F.lit(len(columns)).alias("column_count"), "null_counts",
        F.transform("range_violations", lambda x: F.struct(x["column"].alias("column"), x["n"].alias("n"))).alias(
            "range_violations"),
        "correlations", "issues", "summary_stats",
    )


def gate_snapshot(df: DataFrame, minimum_rows: int = 198) -> dict[str, int]:
    """Raise when the snapshot is short or a heat score is null; one aggregate row reaches the driver."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("heat_stress_score").isNull()).alias("nulls")).first()
    if row["n"] < minimum_rows:
        raise ValueError(f"expected {minimum_rows} ward rows, got {row['n']}")
    if row["nulls"] > 0:
        raise ValueError(f"{row['nulls']} wards have no heat_stress_score")
    return {"rows": row["n"], "nulls": row["nulls"]}


def gate_not_empty(df: DataFrame) -> None:
    if df.isEmpty():
        raise ValueError("table is empty")


def drift_report(baseline: DataFrame, current: DataFrame, bins: int = 10) -> DataFrame:
    """PSI and level per metric that both sides have; both are long (metric, value)."""
    psi = population_stability(baseline, current, "metric", "value", bins)
    return psi.withColumn("level", drift_level(F.col("psi")))


def needs_retraining(drift: DataFrame) -> DataFrame:
    return drift.agg(F.coalesce(F.max(F.col("psi") > 0.1), F.lit(False)).alias("retrain"))


def load_baseline(spark: SparkSession, path: str, model: str) -> DataFrame | None:
    """The model's stored (metric, value) rows, or None before its first save; anything but a missing path raises."""
    from pyspark.errors import AnalysisException

    try:
        stored = spark.read.schema("metric STRING, value DOUBLE, model STRING").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    own = stored.filter(F.col("model") == model).select("metric", "value")
    return None if own.isEmpty() else own


def check_drift(current: DataFrame, model: str, baseline_path: str) -> DataFrame:
    """Drift of (metric, value) rows against the model's own baseline; a model's first call stores it, reports nothing."""
    baseline = load_baseline(current.sparkSession, baseline_path, model)
    if baseline is None:
        save_baseline(current.withColumn("model", F.lit(model)), baseline_path)
        return current.sparkSession.createDataFrame([], "metric STRING, psi DOUBLE, level STRING")
    return drift_report(baseline, current)
