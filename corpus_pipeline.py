"""Documents to packed training sequences: quality rules, near-dedup, source mixture, best-fit packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlens.llm import budgets, circulant, queries, risk_rules, vector_fit
from wardlens.llm.store import stored

# The mixture of the pipeline: op9's target weights over as many tokens as deduplication left. Leaves above their weight
# keep all their documents once; leaves below it catch up by repeats, at most so many epochs.
WEIGHTS, SHARE, EPOCHS, SEED = queries.MIX_WEIGHTS, 1.0, 3, 31


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the proven cutoffs of their language."""
    found, name = risk_rules.judged(docs, queries.table(spark, sf_dir, "labels"))
    return found.filter(F.col(name)["kept"]).select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on five-word shingles: the one with the smallest doc_id.

    Rows are judged one by one, so different texts that share a doc_id, or have none, are not mistaken for each other.
    """
    return circulant.one_of_each_group(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that bring domains, languages and sources towards their target weights.

    Every document comes at least once, so nothing clean is lost; a document of a leaf below its weight comes up to
    ``EPOCHS`` times.
    """
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "lang", "source",
        queries.domain_of().alias("domain"), queries.word_count().alias("n_tokens"))
    taken = budgets.mixed(
        sized, queries.MIX_PATH, F.col("n_tokens"), WEIGHTS, SHARE, EPOCHS, SEED, at_least_once=True)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int")))).select("row.*")


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids and their places in sequences of 2,048 tokens."""
    return vector_fit.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), queries.BYTE_END, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("source_mixture", source_mixture),
    ("best_fit_packing", best_fit),
]

# Shingle sets, sketches and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each stored before the next one reads it."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
