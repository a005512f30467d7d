"""Best-fit packing of token pieces under several capacities at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import stored
from .tokens import encoder

LENGTH = 2048
# Pieces that one task row group packs. Groups are dealt by hash, each alike in its lengths, and all sizes behave alike.
GROUP = 4096


def narrowed(ids: bytes) -> bytes:
    """Ids of 32 bits as ids of 16 bits, where all fit."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if len(wide) and wide.max() < 1 << 16 else ids


def widened(ids: Column, length: Column) -> Column:
    """``narrowed`` ids with 32 bits again; ``length`` is their number."""

    def run(ids: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([
            np.frombuffer(b, "<u2").astype("<u4").tobytes() if len(b) == 2 * n else b for b, n in zip(ids, length)], dtype=object)

    return F.pandas_udf(run, "binary")(ids, length)


def pieces_of(
    docs: DataFrame, vocabulary: str, end_id: int, length: int = LENGTH, spaced: bool = True, with_ids: bool = True,
    narrow: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32) of every row of ``docs`` (doc_id, text); ids is null on request.

    ``narrow`` ids have 16 bits in pieces whose ids allow it; the checksum is always that of 32 bits.

    A document is its ids and the end id. Only a longer one than ``length`` is cut, into full pieces after a first piece
    of the rest. A null or empty text is the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary, spaced)
        end = np.asarray([end_id], "<u4").tobytes()
        try:
            for whole in batches:
                for begin in range(0, whole.num_rows, 512):
                    batch = whole.slice(begin, 512)
                    out: list[tuple] = []
                    for doc_id, text in zip(batch.column(0), batch.column(1)):
                        ids, key = codec.encode(text.as_py()) + end, doc_id.as_py()
                        count = len(ids) // 4
                        starts = [0, *range(count % length or length, count, length)]
                        for number, (a, b) in enumerate(zip(starts, [*starts[1:], count])):
                            cut = ids[4 * a : 4 * b]
                            kept = (narrowed(cut) if narrow else cut) if with_ids else None
                            out.append((key, number, a, b - a, kept, zlib.crc32(cut)))
                    columns = list(zip(*out))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds)],
                        ["doc_id", "piece", "start", "length", "ids", "ids_crc32"])
        finally:
            codec.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long")


def fit(
    tokens: np.ndarray, attention: np.ndarray, capacity: tuple[float, float, float],
    weights: tuple[float, float, float], rule: str,
) -> np.ndarray:
    """Bin number per item; items come in descending order of tokens.

    Every bin has residual capacities (tokens, documents, attention cost), all as shares of the full capacity. Among the
    bins that hold the item in every dimension, "dot" takes the one with the least weighted dot product of residual
    and item (the tightest along what the item asks for), "norm" the one with the least weighted norm of the residual
    that would be left. Ties go to the oldest bin; an item that fits nowhere opens a bin.
    """
    cap = np.asarray(capacity, np.float64)
    w = np.asarray(weights, np.float64)
    need = np.stack([tokens, np.ones(len(tokens)), attention], axis=1)
    residual = np.empty((64, 3))
    alive = np.empty(64, np.int64)  # bin numbers of open bins, oldest first
    count = opened = 0
    out = np.empty(len(tokens), np.int64)
    least = need.min(axis=0) if len(need) else cap
    for k in range(len(need)):
        item = need[k]
        left = residual[:count]
        ok = np.flatnonzero((left >= item).all(axis=1))
        if len(ok):
            if rule == "dot":
                score = (left[ok] / cap) @ (w * item / cap)
            else:
                score = (((left[ok] - item) / cap) ** 2) @ w
            slot = ok[int(score.argmin())]
            out[k] = alive[slot]
        else:
            if count == len(alive):
                residual, alive = np.concatenate([residual, residual]), np.concatenate([alive, alive])
            slot, count = count, count + 1
            residual[slot], alive[slot] = cap, opened
            out[k], opened = opened, opened + 1
        residual[slot] -= item
        if (residual[slot] < least).any():  # nothing fits any more
            residual[slot : count - 1] = residual[slot + 1 : count].copy()
            alive[slot : count - 1] = alive[slot + 1 : count].copy()
            count -= 1
    return out


def packed(
    pieces: DataFrame, capacity: int = LENGTH, max_documents: int | None = None, max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25), rule: str = "dot", group: int = GROUP,
) -> DataFrame:
    """``pieces`` (doc_id, piece, length) with sequence_id and offset; other columns are not carried.

    Capacities of a sequence: tokens, documents (default: as many as tokens) and attention cost, the sum of squared
    lengths (default: the square of ``capacity``); a piece that exceeds one alone is an error. Pieces are dealt by
    hash into groups of about ``group`` pieces and packed inside a group in descending order of length, so memory is
    bounded and each group can be run again elsewhere with the same outcome; a group leaves a few sequences open at
    most. A full-length piece is a sequence of its own. Offsets follow the order of placement without gaps. Equal
    pieces are ordered by doc_id, piece; repeated rows are packed each. An empty table gives an empty result.
    """
    documents = capacity if max_documents is None else max_documents
    attention = float(capacity) ** 2 if max_attention is None else float(max_attention)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        tokens = rows["length"].to_numpy(np.float64)
        if (tokens > capacity).any() or (tokens ** 2 > attention).any() or documents < 1:
            raise ValueError("a piece exceeds a sequence's capacity")
        bins = fit(tokens, tokens ** 2, (capacity, documents, attention), weights, rule)
        rows = rows.assign(sequence_id=rows["_group"].to_numpy(np.int64) * (1 << 32) + bins)
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows[["doc_id", "piece", "length", "sequence_id", "offset"]]

    narrow = pieces.select("doc_id", "piece", F.col("length").cast("long").alias("length"))
    total = narrow.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / group)).cast("long")).scalar()
    dealt = narrow.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", F.lit(1)), total))
    return dealt.groupBy("_group").applyInPandas(
        run, "doc_id long, piece int, length long, sequence_id long, offset long")


def packed_documents(
    docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = LENGTH, with_ids: bool = False, **limits: object
) -> DataFrame:
    """Pieces of ``docs`` with their place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    ``with_ids`` adds ``ids``, the piece's token ids as little-endian unsigned 32-bit numbers; without it the pieces are
    stored without their ids, which pieces_of() gives again at any time. Until pieces and places have met, ids take 16
    bits where they fit. Rows that share a doc_id are told apart by a
    number of the copy, so each is packed whole.
    """
    more = ["ids"] if with_ids else []
    wide = [widened(F.col("ids"), F.col("length")).alias("ids")] if with_ids else []
    digests = stored(
        pieces_of(docs, vocabulary, end_id, capacity, with_ids=with_ids, narrow=True).select(
            "doc_id", "piece", "start", "length", "ids_crc32", *more, F.monotonically_increasing_id().alias("_key")), "pieces",
        "zstd" if with_ids else None)
    places = packed(
        digests.select(F.col("_key").alias("doc_id"), "piece", "length"), capacity, **limits
    ).select(F.col("doc_id").alias("_key"), "sequence_id", "offset")
    return digests.join(places, "_key").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *wide)
