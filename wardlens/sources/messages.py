"""Topic readers and the JSON parse stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.text import event_time
from ..schemas import RAW_IOT


def kafka_messages(
    spark: SparkSession, servers: str, topic: str, starting: str = "latest", max_per_trigger: int | None = None
) -> DataFrame:
    """Value-only text messages of a topic. Needs the Kafka connector on the classpath."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    if max_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ingest_ts"))


def file_messages(spark: SparkSession, folder: str, streaming: bool = True) -> DataFrame:
    """The same contract over landed text files, one message per line; ingest time is the file's."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("text").load(folder).select(
        "value", F.col("_metadata.file_modification_time").alias("ingest_ts")
    )


def parse_messages(messages: DataFrame, schema: StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split messages into parsed rows and rejects.

    A message is rejected when it is not JSON or lacks a required field, which also keeps records of another shape on
    the same topic out of the windows.
    """
    parsed = messages.withColumn("parsed", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    complete = F.col("parsed").isNotNull()
    for name in required:
        complete = complete & F.col(f"parsed.{name}").isNotNull()
    accepted = parsed.filter(complete).select("parsed.*", *[c for c in messages.columns if c != "value"])
    rejected = parsed.filter(~complete).drop("parsed")
    return accepted, rejected


SENSOR_REQUIRED = ["ward_id", "temperature_c", "humidity_pct", "pm25", "rainfall_mm"]


def parse_sensor_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sensor readings with event time ``ts``; an unparsable time falls back to the message's ingest time."""
    nullable = StructType([f for f in RAW_IOT.fields])
    accepted, rejected = parse_messages(messages, nullable, SENSOR_REQUIRED)
    fallback = F.col("ingest_ts") if "ingest_ts" in messages.columns else None
    return accepted.withColumn("ts", event_time(F.col("timestamp"), fallback)), rejected


def valid_json(messages: DataFrame) -> DataFrame:
    """Forward only messages that parse as JSON (alert relay)."""
    return messages.filter(F.expr("try_parse_json(value)").isNotNull())
