"""Keyed table maintenance over plain DataFrames: upserts, updates, deletes and reads of a change log.

A change log is an append-only table of full row images with ``version`` (int), ``op`` ('U' or 'D') and
``committed_at``. Every state of the table is a query over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import latest_per_key


def require_unique(df: DataFrame, keys: list[str]) -> None:
    """Fail when a key occurs twice: an upsert from such a source has no defined result."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).limit(1)
    if not repeated.isEmpty():
        raise ValueError(f"source rows are not unique on {keys}")


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """Matched rows are replaced whole, others inserted."""
    if check:
        require_unique(source, keys)
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source)


def merge_columns(
    target: DataFrame, source: DataFrame, key: str, columns: list[str], check: bool = True
) -> DataFrame:
    """Upsert of some columns: listed ones come from the source when it has the key, the others survive."""
    if check:
        require_unique(source, [key])
    incoming = source.select(
        F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns]
    )
    joined = target.join(incoming, key, "full_outer")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in target.columns
    ])


def merge_partition_path(
    target_path: str, source: DataFrame, keys: list[str], buckets: int
) -> None:
    """Upsert into a Parquet table laid out by ``bucket = pmod(hash(keys), buckets)``; only touched buckets are rewritten.

    The rewritten rows are first materialised in the shared folder, because the job overwrites what it reads.
    """
    from ..session import cut_lineage

    spark = source.sparkSession
    require_unique(source, keys)
    placed = source.withColumn("bucket", F.pmod(F.hash(*keys), F.lit(buckets)))
    target = spark.read.parquet(target_path)
    touched = target.join(placed.select("bucket").distinct(), "bucket", "left_semi")
    merged = cut_lineage(touched.join(placed.select(*keys), keys, "left_anti").unionByName(placed))
    writer = merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket").parquet(target_path)


def set_flags(table: DataFrame, ids: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Update columns of the rows whose key occurs in ``ids``."""
    marked = table.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.select(*[
        F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in table.columns
    ])


def delete_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def as_of_version(log: DataFrame, keys: list[str], version: int | None = None) -> DataFrame:
    """The table after ``version`` (latest when None): last image per key, deletions removed."""
    seen = log if version is None else log.filter(F.col("version") <= version)
    return latest_per_key(seen, keys, ["version"]).filter(F.col("op") != "D").drop("op", "version", "committed_at")


def history(log: DataFrame, limit: int | None = None) -> DataFrame:
    per_version = log.groupBy("version").agg(
        F.count(F.lit(1)).alias("changes"), F.count_if(F.col("op") == "D").alias("deletes"),
        F.max("committed_at").alias("committed_at"),
    ).orderBy(F.col("version").desc())
    return per_version if limit is None else per_version.limit(limit)


def compact(log: DataFrame, keys: list[str], as_of: Column, retention: str = "168 hours") -> DataFrame:
    """Drop images older than the retention unless they are still the last image of their key.

    Reads of any state newer than the cutoff are unchanged.
    """
    cutoff = as_of - F.expr(f"INTERVAL {retention}")
    recent = log.filter(F.col("committed_at") >= cutoff)
    old = log.filter(F.col("committed_at") < cutoff)
    base = latest_per_key(old, keys, ["version"]).filter(F.col("op") != "D").select(*log.columns)
    return recent.unionByName(base)


def append_changes(log: DataFrame | None, changes: DataFrame, version: int, committed_at: Column, op: str = "U"):
    stamped = changes.withColumn("version", F.lit(version)).withColumn("op", F.lit(op)).withColumn(
        "committed_at", committed_at
    )
    return stamped if log is None else log.unionByName(stamped)
