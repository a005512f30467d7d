"""Steps that are read more than once, kept as Parquet in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written to a fresh folder below spark.checkpoint.dir and read back: its lineage ends there.

    ``compression`` is for tables that hold whole texts or their ids ("zstd"); the others keep the session's.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def among(rows: DataFrame, key: str, chosen: DataFrame) -> DataFrame:
    """The rows whose ``key`` is one of the keys in ``chosen`` (a table with that column; repeats and nulls do no harm).

    Keys are numbers from monotonically_increasing_id(), dense within a partition, so the chosen ones are stored as one
    bit each, 32,768 to a row. Wide rows thus meet a table small enough to be broadcast where a list of keys would not be;
    beyond the session's limit for that, Spark joins by the number of the bits' row.
    """
    at = F.col(key) + 1  # a partition's first key begins a row of bits
    bits = stored(
        chosen.filter(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits")), "bits")
    octet = F.conv(F.hex(F.expr(f"substring(_bits, int(bitmap_bit_position({key} + 1) div 8) + 1, 1)")), 16, 10).cast("int")
    is_set = octet.bitwiseAND(F.expr(f"shiftleft(1, int(bitmap_bit_position({key} + 1) % 8))")) != 0
    return rows.join(bits, F.bitmap_bucket_number(at) == F.col("_bucket")).filter(is_set).select(*rows.columns)
