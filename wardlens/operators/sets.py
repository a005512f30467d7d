"""Unions, dedupe and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import most_recent


def union_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right, allowMissingColumns=True)


def symmetric_edges(edges: DataFrame, self_loops: DataFrame | None = None) -> DataFrame:
    """Both directions of every (src, dst), each once; optional (id, id) loops.

    Duplicates go while an edge is one row, its smaller end (a null before all) first, and the directions follow.
    """
    src, dst = F.col("src"), F.col("dst")
    one, other = F.struct("src", "dst"), F.struct(dst.alias("src"), src.alias("dst"))
    turned = (src > dst) | (src.isNotNull() & dst.isNull())
    ordered = edges.select(F.when(turned, other).otherwise(one).alias("e")).select("e.*")
    if self_loops is not None:
        ordered = ordered.union(self_loops.select("ward_id", "ward_id"))
    both = F.when(src.eqNullSafe(dst), F.array(one)).otherwise(F.array(one, other))
    return ordered.distinct().select(F.explode(both).alias("e")).select("e.*")


def merge_alerts(
    current: DataFrame, incoming: DataFrame, keep: int = 50, by_type: bool = False
) -> DataFrame:
    """Union of known and new alerts, one per (ward, millisecond), newest ``keep``.

    Known alerts win over new ones with their key. ``by_type`` adds the alert type to the key, so a ward's heat and
    flood alert of one instant both stay.
    """
    keys = ["ward_id", "ts_ms"] + (["alert_type"] if by_type else [])
    tagged = current.withColumn("_new", F.lit(0)).unionByName(
        incoming.withColumn("_new", F.lit(1))
    ).withColumn("ts_ms", F.unix_millis(F.col("timestamp").cast("timestamp")))
    row = F.struct(*current.columns)
    order = F.struct("_new", "alert_type", "value")
    kept = tagged.groupBy(*keys).agg(F.min_by(row, order).alias("_r")).select("_r.*")
    return most_recent(kept, "timestamp", keep, "ward_id")


def distinct_alerts(alerts: DataFrame, by_type: bool = False) -> DataFrame:
    keys = ["ward_id", "ts_ms"] + (["alert_type"] if by_type else [])
    return alerts.withColumn("ts_ms", F.unix_millis(F.col("timestamp").cast("timestamp"))).dropDuplicates(keys)


def missing_keys(df: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Expected ids that do not occur."""
    expected = df.sparkSession.range(first, last + 1).select(F.col("id").alias(key))
    return expected.join(df.select(F.col(key).cast("bigint").alias(key)), key, "left_anti")


def fired_rules(df: DataFrame, rules: list[Column], name: str = "alert") -> DataFrame:
    """Rows times the rules that fire for them, from a single scan; a rule is a struct or null."""
    return df.select("*", F.explode(F.array_compact(F.array(*rules))).alias(name))


def replace_by_key(table: DataFrame, entries: DataFrame, key: str, keep: Column) -> DataFrame:
    """Drop rows whose key occurs in ``entries`` and append the entries that satisfy ``keep``."""
    return table.join(entries.select(key), key, "left_anti").unionByName(entries.filter(keep))


def record_feedback(feedback: DataFrame, entries: DataFrame) -> DataFrame:
    """A new label replaces a report's earlier one; "clear" only removes."""
    return replace_by_key(feedback, entries, "report_id", F.col("label") != "clear")
