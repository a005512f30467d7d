"""Least squares of several targets at once from one mergeable aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

INTERCEPT = "intercept"


def moments(df: DataFrame, inputs: list[str], targets: list[str]) -> DataFrame:
    """One row (n, means, products): the means of all columns and the covariances of each input with every column.

    ``products`` holds one array per input, over inputs and then targets. Every entry is an aggregate that partial
    results merge into without loss of precision, so a table of any size is read once and the shuffle is one row a task.
    A null in any of the columns is an error, as no row may be left out in silence.
    """
    columns = [*inputs, *targets]
    known = df.select(*[
        F.coalesce(F.col(c).cast("double"), F.raise_error(F.lit(f"null in {c}")).cast("double")).alias(f"c{k}")
        for k, c in enumerate(columns)])
    pairs = {
        (i, j): F.covar_pop(f"c{i}", f"c{j}").alias(f"p{i}_{j}") for i in range(len(inputs)) for j in range(i, len(columns))}
    row = known.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"c{k}").alias(f"m{k}") for k in range(len(columns))], *pairs.values())
    return row.select(
        "n", F.array(*[f"m{k}" for k in range(len(columns))]).alias("means"),
        F.array(*[
            F.array(*[f"p{min(i, j)}_{max(i, j)}" for j in range(len(columns))]) for i in range(len(inputs))
        ]).alias("products"))


def coefficients(df: DataFrame, inputs: list[str], targets: list[str]) -> DataFrame:
    """(target, term, value): the intercept and the weight of every input, for every target.

    One aggregate (``moments``) and one solve of a system as large as the number of inputs, scaled to correlations. Of
    inputs that depend on each other the solution with the least weights is taken. Without rows there are no
    coefficients; a constant input gets the weight 0.
    """

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, means, products in zip(batch["n"], batch["means"], batch["products"]):
                if not n:
                    continue
                m = np.array(means, float)
                both = np.array([np.array(p, float) for p in products])
                k = len(inputs)
                scale = np.sqrt(np.diag(both[:, :k]))
                scale[scale == 0] = 1.0
                weights = np.linalg.lstsq(
                    both[:, :k] / np.outer(scale, scale), both[:, k:] / scale[:, None], rcond=1e-12)[0] / scale[:, None]
                offset = m[k:] - m[:k] @ weights
                yield pd.DataFrame([
                    (target, term, float(value)) for t, target in enumerate(targets)
                    for term, value in [(INTERCEPT, offset[t]), *zip(inputs, weights[:, t])]
                ], columns=["target", "term", "value"])

    return moments(df, inputs, targets).mapInPandas(solve, "target string, term string, value double")


def predictions(df: DataFrame, model: DataFrame, inputs: list[str], targets: list[str], suffix: str = "_pred") -> DataFrame:
    """``df`` with one more column per target; ``model`` are ``coefficients``, a few rows that become one constant."""
    table = model.agg(F.map_from_entries(F.collect_list(F.struct(
        F.struct("target", "term"), F.col("value"))))).scalar()

    def weight(target: str, term: str) -> Column:
        return F.element_at(F.col("_model"), F.struct(F.lit(target).alias("target"), F.lit(term).alias("term")))

    def fitted(target: str) -> Column:
        total = weight(target, INTERCEPT)
        for term in inputs:
            total = total + weight(target, term) * F.col(term)
        return total

    return df.withColumn("_model", table).withColumns({f"{t}{suffix}": fitted(t) for t in targets}).drop("_model")
