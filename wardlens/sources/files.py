"""CSV, Parquet, JSON and JDBC readers, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import RAW_IOT, conform


# Spark's default CSV timestamps stop at milliseconds; both sides of a round trip use these.
CSV_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
}


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).options(**CSV_TIMES).csv(path)


def read_csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All fields as text, for sources whose bad values must not abort the read."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if schema is None else conform(df, schema)


def read_features(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Snapshot reader by suffix: .csv or .parquet/.pq."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_csv(spark, path, schema)
    if suffix in ("parquet", "pq"):
        return spark.read.parquet(path)
    raise ValueError("input must be .csv or .parquet")


def follow_csv(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Follow a folder of CSV files. New files are picked up; lines appended to a seen file are not."""
    return (
        spark.readStream.schema(schema)
        .option("header", True)
        .options(**CSV_TIMES)
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(folder)
    )


def follow_parquet(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    driver: str,
    key: str,
    lower: int,
    upper: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """Parallel table read over a numeric key. Needs the database's driver jar on the classpath."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, driver=driver, partitionColumn=key, lowerBound=str(lower),
                 upperBound=str(upper), numPartitions=str(partitions), **options)
        .load()
    )


def sensor_readings_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sensor CSV: the key and time stay as given, missing or bad numbers count as 0."""
    text = read_csv_text(spark, path, RAW_IOT.fieldNames())
    numbers = ("lat", "lon", "temperature_c", "humidity_pct", "pm25", "rainfall_mm")
    return text.select(
        F.col("ward_id").try_cast("int").alias("ward_id"),
        "sensor_id",
        "timestamp",
        F.try_to_timestamp("timestamp").alias("ts"),
        *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in numbers],
    )
