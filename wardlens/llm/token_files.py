"""Token ids in Parquet list columns: encodings, row groups and pages are chosen, reads are selective."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .tokens import encoder

SCHEMA = "doc_id long, n_tokens long, tokens array<int>"


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, spaced: bool = False) -> DataFrame:
    """(doc_id, n_tokens, tokens) of every row of ``docs`` (doc_id, text); a null or empty text has the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, spaced).encode
        end = np.asarray([end_id], "<u4").tobytes()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                parts = [encode(text.as_py()) + end for text in batch.column(1)]
                counts = np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), ids)],
                    ["doc_id", "n_tokens", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, spaced: bool = False, encoding: str = "delta",
    row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, codec: str = "zstd",
) -> None:
    """Write the token ids of ``docs`` (doc_id, text; other columns are ignored) in ascending doc_id order.

    Documents are dealt out by ranges of (doc_id, hash of the text) and sorted inside each, so file k holds smaller
    ids than file k + 1 and the statistics of row groups and pages cut doc_id ranges out. ``encoding`` is "delta"
    (binary-packed differences) or "dictionary"; n_tokens and tokens are columns of their own, so counts are read
    without ids. The page index is written with every file. Spark's committer makes the write safe against lost
    executors. Nulls in doc_id come first, rows that share a doc_id stay side by side in the order of the hash of their text;
    a null text is an empty one. An empty table writes a table without rows.
    """
    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("_order", F.xxhash64("text"))
        .repartitionByRange("doc_id", "_order").sortWithinPartitions("doc_id", "_order")
    )
    options = {
        "compression": codec,
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.page.row.count.limit": "20000",
    }
    tokenised(ranged, vocabulary, end_id, spaced).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows; selecting columns or filtering on doc_id reads only those columns, row groups and pages."""
    return spark.read.schema(SCHEMA).parquet(path)


def token_ranges(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): ``stored`` is read_tokens(); start counts the ids of all rows before.

    Starts are running sums inside a file plus the totals of the files before it, so only one row per file is ordered
    globally, and that pass reads no ids. Rows that share a doc_id follow each other in any fixed order (by checksum).
    """
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            bounds = lists.offsets.to_numpy()
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())],
                ["file", "doc_id", "n_tokens", "ids_crc32"])

    named = stored.select(F.col("_metadata.file_name").alias("file"), "doc_id", "n_tokens", "tokens")
    totals = named.groupBy("file").agg(F.sum("n_tokens").alias("_total"))
    # part files are numbered in the order of their ranges, with more than five digits where there are so many
    number = F.regexp_extract("file", r"^part-([0-9]+)", 1).cast("long")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    digests = named.mapInArrow(run, "file string, doc_id long, n_tokens long, ids_crc32 long")
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32").rowsBetween(
        Window.unboundedPreceding, -1)
    return digests.join(bases, "file").select(
        "doc_id", (F.col("_base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).cast("long").alias("start"),
        "n_tokens", "ids_crc32")
