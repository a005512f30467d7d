"""Optional filters, time ranges and row validation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import SERVICE_BBOX, WARD_COUNT, inside_bbox


def equals_if(df: DataFrame, column: str, value: str | None) -> DataFrame:
    return df if value is None else df.filter(F.col(column) == value)


def at_least(df: DataFrame, column: str, minimum: float) -> DataFrame:
    """Applied only for a positive minimum."""
    return df.filter(F.coalesce(F.col(column), F.lit(0.0)) >= minimum) if minimum > 0 else df


def only_ids(df: DataFrame, ids: list[int] | DataFrame | None, key: str = "ward_id") -> DataFrame:
    """Keep the given ids. A list of any length becomes a pushed-down IN; a frame of ids becomes a semi join."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key), key, "left_semi")
    return df.filter(F.col(key).isin(ids)) if ids else df


def without_ids(df: DataFrame, ids: DataFrame, key: str = "ward_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def any_of(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Multi-select: nothing selected means everything."""
    return df.filter(F.col(column).isin(values)) if values else df


def in_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter(F.col(column).between(low, high))


def since(column: str, as_of: Column | datetime, interval: str, inclusive: bool = True) -> Column:
    """Rows of the last ``interval`` before ``as_of`` (e.g. "7 days"); the clock is never read."""
    start = (as_of if isinstance(as_of, Column) else F.lit(as_of)) - F.expr(f"INTERVAL {interval}")
    return F.col(column) >= start if inclusive else F.col(column) > start


def same_day(column: str, as_of: Column) -> Column:
    return F.col(column) >= F.date_trunc("day", as_of)


def metric_filter(df: DataFrame, run_prefix: str, metrics: list[str]) -> DataFrame:
    return df.filter(F.col("run_name").startswith(run_prefix) & F.col("metric_name").isin(metrics))


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split into accepted rows and rejected rows with the names of the rules they break (null breaks a rule)."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    )
    checked = df.withColumn("broken_rules", broken)
    accepted = checked.filter(F.size("broken_rules") == 0).drop("broken_rules")
    return accepted, checked.filter(F.size("broken_rules") > 0)


def report_rules(ward_count: int = WARD_COUNT) -> dict[str, Column]:
    def short(column: str, limit: int) -> Column:
        return F.col(column).isNull() | (F.length(column) <= limit)

    return {
        "ward_id": F.col("ward_id").between(1, ward_count),
        "location": inside_bbox(F.col("longitude"), F.col("latitude"), SERVICE_BBOX),
        "report_type": F.col("report_type").isNotNull(),
        "severity": F.col("severity").between(1, 5),
        "description": short("description", 1000),
        "image_url": short("image_url", 500),
    }


def score_rules(ward_count: int = WARD_COUNT) -> dict[str, Column]:
    return {
        "ward_id": F.col("ward_id").between(1, ward_count),
        "heat_stress_score": F.col("heat_stress_score").between(0, 100),
        "flood_risk_score": F.col("flood_risk_score").between(0, 100),
        "risk_level": F.col("risk_level").isin("low", "medium", "high", "critical"),
    }


def image_rules(max_bytes: int = 10 * 1024 * 1024) -> dict[str, Column]:
    return {
        "content_type": F.col("content_type").startswith("image/"),
        "size": F.col("length") <= max_bytes,
    }
