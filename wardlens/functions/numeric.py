"""Arithmetic helpers shared by all feature formulas."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; null stays null (``least``/``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def safe_ratio(numerator: Column, denominator: Column, otherwise: float = 0.0) -> Column:
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(float(otherwise)))


def numeric_or_zero(value: Column) -> Column:
    """Tolerant cast of a text field: missing or unparsable becomes 0."""
    return F.coalesce(F.expr("null").cast("double") if value is None else value.try_cast("double"), F.lit(0.0))


def log_norm(value: Column, eps: float = 0.1, scale: float = 6.0) -> Column:
    return F.log(F.greatest(value, F.lit(0.0)) + F.lit(eps)) / F.lit(scale)


def clip_norm(value: Column, low: float, high: float, clip_first: bool = True) -> Column:
    """Scale [low, high] to about [0, 1]; the image-channel variant clips after dividing."""
    span = F.lit(high - low + 1e-8)
    if clip_first:
        return (clip(value, low, high) - F.lit(float(low))) / span
    return clip((value - F.lit(float(low))) / span, 0.0, 1.0)


def sigmoid(x: Column) -> Column:
    """Logistic function; exp() saturates to infinity instead of overflowing, so no guard is needed."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def present(value: Column, digits: int) -> Column:
    """Output rounding: NaN and null both become null."""
    return F.round(null_if_nan(value), digits)


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def l2_norm(vector: Column) -> Column:
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def l2_normalise(vector: Column, eps: float = 1e-12) -> Column:
    norm = F.greatest(l2_norm(vector), F.lit(eps))
    return F.transform(vector, lambda x: x.cast("double") / norm)
