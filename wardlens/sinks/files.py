"""Table, CSV, JSON and GeoJSON writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.nested import JSON_TIMES, feature_collection_lines
from ..sources.files import CSV_TIMES


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("header", True).options(**CSV_TIMES).csv(path)


def write_snapshot(df: DataFrame, csv_path: str, parquet_path: str) -> None:
    """Both formats from one computation: the CSV copy is written from the stored Parquet."""
    overwrite_table(df, parquet_path)
    write_csv(df.sparkSession.read.schema(df.schema).parquet(parquet_path), csv_path, "overwrite")


def save_baseline(df: DataFrame, path: str) -> None:
    """Long form (model, metric, value), one folder per model; replaces the baselines of the models in ``df`` only."""
    df.select("metric", F.col("value").cast("double"), "model").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """One nested JSON record; the report is a one-row frame."""
    report.coalesce(1).write.mode("overwrite").json(path)


def export(df: DataFrame, path: str, fmt: str, geometry: str | None = None, order: str = "ward_id") -> None:
    """Export as csv, json or geojson. GeoJSON part files, read in name order, form one document."""
    if fmt == "csv":
        write_csv(df, path, "overwrite")
    elif fmt == "json":
        df.write.mode("overwrite").options(**JSON_TIMES).json(path)
    elif fmt == "geojson":
        lines = feature_collection_lines(df, geometry, order)
        ordered = lines.repartitionByRange("part", "pos").sortWithinPartitions("part", "pos")
        ordered.select("line").write.mode("overwrite").text(path)
    else:
        raise ValueError("format must be csv, json or geojson")
