"""Least squares of several targets against numpy, and the lagged design against a plain reading."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from wardlens.operators import regression
from wardlens.plans import training


def frame(spark, table, names):
    return spark.createDataFrame([tuple(map(float, r)) for r in table], ", ".join(f"{n} double" for n in names)).repartition(4)


def fitted(df, inputs, targets):
    return {(r["target"], r["term"]): r["value"] for r in regression.coefficients(df, inputs, targets).collect()}


def test_two_targets_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4)) * [1, 1e3, 1e-4, 5] + [0, 1e6, 3, -20]
    y = np.stack([x @ [1, 2e-3, 500, 0.1] + 7 + rng.normal(size=500), x @ [0, 1e-3, -900, 2] + rng.normal(size=500)], axis=1)
    df = frame(spark, np.hstack([x, y]), ["a", "b", "c", "d", "heat", "flood"])
    found = fitted(df, ["a", "b", "c", "d"], ["heat", "flood"])
    centred, mean = x - x.mean(axis=0), x.mean(axis=0)
    for t, target in enumerate(("heat", "flood")):
        weights = np.linalg.lstsq(centred / x.std(axis=0), y[:, t] - y[:, t].mean(), rcond=None)[0] / x.std(axis=0)
        assert [found[target, n] for n in "abcd"] == pytest.approx(weights.tolist(), rel=1e-8, abs=1e-12)
        assert found[target, "intercept"] == pytest.approx(y[:, t].mean() - mean @ weights, rel=1e-8)


def test_dependent_and_constant_inputs(spark):
    rows = [(k, 2 * k, 5.0, 3 * k + 1) for k in range(20)]
    df = frame(spark, rows, ["a", "b", "c", "y"])
    found = fitted(df, ["a", "b", "c"], ["y"])
    assert found["y", "c"] == 0 and found["y", "a"] + 2 * found["y", "b"] == pytest.approx(3.0)
    model = regression.coefficients(df, ["a", "b", "c"], ["y"])
    errors = regression.predictions(df, model, ["a", "b", "c"], ["y"]).selectExpr("max(abs(y - y_pred))").first()[0]
    assert errors < 1e-9


def test_nulls_are_refused_and_no_rows_give_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "x double, y double")
    with pytest.raises(PySparkException):
        regression.coefficients(df, ["x"], ["y"]).collect()
    assert regression.coefficients(df.limit(0), ["x"], ["y"]).collect() == []


def test_design_holds_all_lags_and_neighbours(spark):
    rng = random.Random(4)
    value = {(w, s): (rng.random(), rng.random()) for w in (1, 2, 3) for s in range(6)}
    history = spark.createDataFrame([(w, s, *v) for (w, s), v in value.items()], "ward_id bigint, snapshot_idx bigint, heat double, flood double")
    weights = {(1, 2): 1.0, (2, 1): 0.25, (2, 3): 0.75, (3, 2): 1.0}
    edges = spark.createDataFrame([(s, d, w) for (s, d), w in weights.items()], "src bigint, dst bigint, weight double")
    rows, inputs = training.lagged_design(history, edges, ["heat", "flood"], ["heat", "flood"], (1, 3))
    assert inputs == [f"{side}{lag}_{v}" for lag in (1, 3) for side in ("own", "near") for v in ("heat", "flood")]
    found = {(r["ward_id"], r["snapshot_idx"]): r for r in rows.collect()}
    assert set(found) == {(w, s) for w in (1, 2, 3) for s in range(3, 6)}
    for (w, s), r in found.items():
        assert (r["heat"], r["flood"]) == value[w, s]
        for lag in (1, 3):
            near = [(src, x) for (src, dst), x in weights.items() if dst == w]
            for k, v in enumerate(("heat", "flood")):
                assert r[f"own{lag}_{v}"] == value[w, s - lag][k]
                assert r[f"near{lag}_{v}"] == pytest.approx(sum(x * value[src, s - lag][k] for src, x in near) / len(near))
