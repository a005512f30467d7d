"""Keyed JSON messages to a topic, or to files with the same two columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.nested import JSON_TIMES


def to_messages(df: DataFrame, key: Column | None = None) -> DataFrame:
    value = F.to_json(F.struct("*"), JSON_TIMES).alias("value")
    keyed = F.lit(None).cast("string") if key is None else key.cast("string")
    return df.select(keyed.alias("key"), value)


def control_event(rows: DataFrame, run_id: str, ds: str, published_at: Column) -> DataFrame:
    """The "ward_features_updated" message with the number of rows written, keyed "control"."""
    body = F.struct(
        F.lit("ward_features_updated").alias("event_type"),
        F.lit(run_id).alias("pipeline_run"),
        F.lit(ds).alias("ds"),
        F.date_format(published_at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
        F.col("ward_count"),
    )
    counted = rows.agg(F.count(F.lit(1)).alias("ward_count"))
    return counted.select(F.lit("control").alias("key"), F.to_json(body).alias("value"))


def write_topic(messages: DataFrame, servers: str, topic: str) -> None:
    """Batch publish. Needs the Kafka connector on the classpath."""
    (messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save())


def stream_to_topic(messages: DataFrame, servers: str, topic: str, checkpoint: str, every: str = "60 seconds"):
    """Streaming publish, at-least-once."""
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )


def write_message_files(messages: DataFrame, path: str, mode: str = "append") -> None:
    messages.select("key", "value").write.mode(mode).json(path)
