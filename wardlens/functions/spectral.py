"""Landsat Collection-2 scaling and indices."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import clip, safe_ratio

# Landsat Collection-2 Level-2 scale factors and the Kelvin offset.
REFLECTANCE_SCALE = 0.0000275
REFLECTANCE_OFFSET = -0.2
THERMAL_SCALE = 0.00341802
THERMAL_OFFSET = 149.0
KELVIN = 273.15


def reflectance(dn: Column) -> Column:
    return dn * F.lit(REFLECTANCE_SCALE) + F.lit(REFLECTANCE_OFFSET)


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where the sum is 0."""
    return safe_ratio(a - b, a + b)


def ndvi(b5: Column, b4: Column) -> Column:
    return normalized_difference(b5, b4)


def ndbi(b6: Column, b5: Column) -> Column:
    return normalized_difference(b6, b5)


def mndwi(b3: Column, b6: Column) -> Column:
    return normalized_difference(b3, b6)


def lst_celsius(b10: Column) -> Column:
    return b10 * F.lit(THERMAL_SCALE) + F.lit(THERMAL_OFFSET) - F.lit(KELVIN)


def impervious_pct(ndbi_value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return clip((ndbi_value + 1.0) / 2.0 * 100.0, low, high)
