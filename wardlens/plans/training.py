"""Training-window sets and the baseline regression on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.graph import neighbour_mean
from ..operators.history import (
    FEATURES, TARGETS, WINDOW, chronological_split, densify, normalise_snapshot, sliding_samples, with_snapshot_index,
)
from ..operators.regression import coefficients, predictions
from ..operators.statistics import regression_metrics, standard_scale
from ..session import cut_lineage


def training_windows(
    history: DataFrame, features: tuple[str, ...] = FEATURES, targets: tuple[str, ...] = TARGETS,
    window: int = WINDOW, fill: str = "zero", validation: float = 0.2,
) -> DataFrame:
    """Indexed, normalised, densified, scaled history as sliding samples with a chronological split.

    Densifying, scaling and splitting each read their input more than once, so the history is stored before the first
    and the dense grid after it.
    """
    indexed = cut_lineage(normalise_snapshot(with_snapshot_index(history)))
    dense = cut_lineage(densify(indexed, [*features, *targets], fill))
    scaled = standard_scale(dense, list(features))
    samples = sliding_samples(scaled, list(features), list(targets), window)
    return chronological_split(samples, validation, positions=dense.filter(F.col("snapshot_idx") >= window))


def lag_features(
    history: DataFrame, values: list[str], targets: list[str], edges: DataFrame | None = None
) -> DataFrame:
    """Per (ward, snapshot): the previous snapshot's values, optionally its neighbours' mean, and the targets.

    The lag is an equi-join on the shifted index, so it needs no ordered window.
    """
    past = history.select(
        "ward_id", (F.col("snapshot_idx") + 1).alias("snapshot_idx"), *[F.col(v).alias(f"lag_{v}") for v in values])
    rows = history.select("ward_id", "snapshot_idx", *targets).join(past, ["ward_id", "snapshot_idx"])
    if edges is None:
        return rows
    around = neighbour_mean(edges, history.select("ward_id", "snapshot_idx", *values), values, ["snapshot_idx"])
    shifted = around.select(
        "ward_id", (F.col("snapshot_idx") + 1).alias("snapshot_idx"), *[F.col(v).alias(f"near_{v}") for v in values])
    return rows.join(shifted, ["ward_id", "snapshot_idx"])


def lagged_design(
    history: DataFrame, edges: DataFrame, values: list[str], targets: list[str], lags: tuple[int, ...] = (1, 2)
) -> tuple[DataFrame, list[str]]:
    """Per (ward, snapshot): own values and neighbours' weighted means at each lag, the targets, and the inputs' names.

    Every row is sent to the snapshots it is a past of and all meet there in one aggregate, so the number of lags adds
    no join and no ordered window. Only (ward, snapshot) pairs with all their lags are kept.
    """
    around = neighbour_mean(edges, history.select("ward_id", "snapshot_idx", *values), values, ["snapshot_idx"])
    state = history.select(
        F.col("ward_id").cast("long").alias("ward_id"), "snapshot_idx", *dict.fromkeys([*values, *targets])
    ).join(around.select("ward_id", "snapshot_idx", *[F.col(v).alias(f"near_{v}") for v in values]), ["ward_id", "snapshot_idx"])
    sent = state.withColumn("_lag", F.explode(F.array(*[F.lit(n) for n in (0, *lags)]))).withColumn(
        "snapshot_idx", F.col("snapshot_idx") + F.col("_lag"))

    def at(lag: int, column: str) -> Column:
        return F.max(F.when(F.col("_lag") == lag, F.col(column)))

    inputs = {f"{name}{lag}_{v}": at(lag, f"{side}{v}") for lag in lags for name, side in (("own", ""), ("near", "near_")) for v in values}
    met = sent.groupBy("ward_id", "snapshot_idx").agg(
        F.count(F.lit(1)).alias("_met"), *[at(0, t).alias(t) for t in targets], *[c.alias(n) for n, c in inputs.items()])
    return met.filter(F.col("_met") == len(lags) + 1).drop("_met"), list(inputs)


def risk_regression(
    history: DataFrame, edges: DataFrame, values: list[str], targets: tuple[str, ...] = TARGETS,
    lags: tuple[int, ...] = (1, 2), validation: float = 0.2,
) -> tuple[DataFrame, DataFrame]:
    """(coefficients, samples with predictions) of the lagged regression of all targets, fitted on the train split.

    ``history`` is a dense one (see ``densify``) and ``edges`` the weighted ward graph. The design is stored, as the
    split, the fit and the predictions read it.
    """
    rows, inputs = lagged_design(history, edges, values, list(targets), lags)
    samples = chronological_split(cut_lineage(rows), validation)
    model = cut_lineage(coefficients(samples.filter(F.col("split") == "train"), inputs, list(targets)))
    return model, predictions(samples, model, inputs, list(targets))


def regression_report(samples: DataFrame, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """(split, target, rmse, mae, r2) of every target, from one pass over the predicted samples."""
    long = samples.select("split", F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(f"{t}_pred").alias("fitted"), F.col(t).alias("actual")) for t in targets
    ])).alias("e")).select("split", "e.*")
    return regression_metrics(long, "fitted", "actual", ["split", "target"]).drop("robust_loss")


def fit_baseline(samples: DataFrame, inputs: list[str], target: str):
    """Least squares with Spark ML; fits on the rows marked "train". A null input is an error, no row is left out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error")
    regression = LinearRegression(featuresCol="features", labelCol=target, predictionCol="prediction")
    return Pipeline(stages=[assembler, regression]).fit(samples.filter(F.col("split") == "train"))


def evaluate_baseline(model, samples: DataFrame, target: str) -> DataFrame:
    scored = model.transform(samples).select("split", "prediction", target)
    return regression_metrics(scored, "prediction", target, ["split"])
