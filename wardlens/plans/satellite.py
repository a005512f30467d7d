"""Pixels to ward features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import spectral
from ..functions.geo import GRID_COLUMNS, WARD_COUNT
from ..operators.spatial import pixel_wards, zonal_means

INDICES = ["ndvi", "ndbi", "impervious_pct", "lst_celsius"]


def with_indices(pixels: DataFrame) -> DataFrame:
    """Indices in steps, so that each formula refers to columns instead of repeating its inputs' arithmetic."""
    scaled = pixels.withColumns({f"_{b}": spectral.reflectance(F.col(b)) for b in ("b4", "b5", "b6")})
    ratios = scaled.withColumns({
        "ndvi": spectral.ndvi(F.col("_b5"), F.col("_b4")), "ndbi": spectral.ndbi(F.col("_b6"), F.col("_b5")),
    })
    return ratios.select(
        *pixels.columns, "ndvi", "ndbi", spectral.impervious_pct(F.col("ndbi")).alias("impervious_pct"),
        spectral.lst_celsius(F.col("b10")).alias("lst_celsius"),
    )


def satellite_features(
    pixels: DataFrame, scene_date: Column, height: Column, width: Column, ward_count: int = WARD_COUNT,
    columns: int = GRID_COLUMNS, keys: list[str] | None = None,
) -> DataFrame:
    """Zonal means of the indices per ward (and ``keys``); one scan, one shuffle of partial means."""
    placed = pixel_wards(with_indices(pixels), height, width, ward_count, columns)
    means = zonal_means(placed, [*(keys or []), "ward_id"], INDICES)
    return means.withColumn("scene_date", scene_date)


def rounded_features(features: DataFrame) -> DataFrame:
    digits = {"ndvi": 4, "ndbi": 4, "impervious_pct": 2, "lst_celsius": 2}
    return features.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in features.columns])


# Indices of a ward whose sample lacks a band.
POINT_DEFAULTS = {"ndvi": 0.2, "ndbi": 0.0, "mndwi": -0.1, "lst_celsius": 32.0}


def point_samples(samples: DataFrame) -> DataFrame:
    """Per-ward point samples of one scene: the four indices with their defaults."""
    b3, b4, b5, b6 = (spectral.reflectance(F.col(b)) for b in ("b3", "b4", "b5", "b6"))
    values = {
        "ndvi": spectral.ndvi(b5, b4), "ndbi": spectral.ndbi(b6, b5), "mndwi": spectral.mndwi(b3, b6),
        "lst_celsius": spectral.lst_celsius(F.col("b10")),
    }
    known = {
        "ndvi": F.col("b4").isNotNull() & F.col("b5").isNotNull(),
        "ndbi": F.col("b5").isNotNull() & F.col("b6").isNotNull(),
        "mndwi": F.col("b3").isNotNull() & F.col("b6").isNotNull(),
        "lst_celsius": F.col("b10").isNotNull(),
    }
    return samples.select(
        "ward_id", *[F.when(known[n], v).otherwise(F.lit(POINT_DEFAULTS[n])).alias(n) for n, v in values.items()]
    )
