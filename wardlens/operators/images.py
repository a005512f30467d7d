"""Flood scoring of images from their pixel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import clip, sigmoid

FLOOD_THRESHOLD = 0.52
# Share of the image above the scored area, and the weights of the five colour classes.
SKIPPED_TOP = 0.4
CLASS_WEIGHTS = {"water": 0.45, "mud": 0.30, "dark": 0.10, "green": -0.15, "dry": -0.10}


def _class_scores() -> dict[str, Column]:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    brightness = (r + g + b) / 3.0
    blue = (b > r + 15) & (b > g + 5) & (brightness > 40) & (brightness < 180)
    murky = (F.abs(r - g) < 30) & (F.abs(g - b) < 30) & (brightness < 130)
    return {
        "water": blue.cast("int") * 1.0 + murky.cast("int") * 0.6,
        "mud": ((r > g) & (g > b) & (r > 80) & (b < 100) & (r - b > 30)).cast("int") * 1.0,
        "dark": (brightness < 50).cast("int") * 0.5,
        "green": ((g > r + 20) & (g > b + 20)).cast("int") * 1.0,
        "dry": ((r > 160) & (g > 130) & (b < 110)).cast("int") * 0.5,
    }


def pixel_classes(pixels: DataFrame) -> DataFrame:
    """Mean class scores per image over its lower 60 %; partial means, so a huge image is no hot group."""
    ground = pixels.filter(F.col("y") >= F.floor(F.col("height") * SKIPPED_TOP))
    return ground.groupBy("image_id").agg(*[F.avg(s).alias(n) for n, s in _class_scores().items()])


def flood_verdicts(classes: DataFrame, bias: Column | float = 0.0) -> DataFrame:
    """Raw score, bias, confidence and verdict per image."""
    shift = bias if isinstance(bias, Column) else F.lit(float(bias))
    parts = [F.col(n) * w for n, w in CLASS_WEIGHTS.items()]
    raw = clip(sum(parts[1:], parts[0]), 0.0, 1.0)
    scored = classes.withColumn("raw_flood_score", raw).withColumn("bias_applied", shift)
    confidence = sigmoid(clip(F.col("raw_flood_score") + F.col("bias_applied"), 0.0, 1.0) * 10.0 - 2.5)
    judged = scored.withColumn("confidence", confidence).withColumn(
        "is_flood", F.col("confidence") >= FLOOD_THRESHOLD)
    return judged.withColumn("label", F.when(F.col("is_flood"), "flood").otherwise("no_flood"))


def score_images(pixels: DataFrame, feedback: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """Verdicts with the bias learned from feedback; the bias is a one-row scalar of the plan."""
    if feedback is None:
        return flood_verdicts(pixel_classes(pixels))
    from .aggregates import feedback_bias

    return flood_verdicts(pixel_classes(pixels), feedback_bias(feedback, as_of).select("bias").scalar())


def with_details(verdicts: DataFrame) -> DataFrame:
    """Nested details as the API shows them."""
    details = F.struct(
        *[F.round(F.col(n) * 100, 1).alias(f"{n}_px_pct") for n in CLASS_WEIGHTS],
        F.round("raw_flood_score", 3).alias("raw_flood_score"), F.round("bias_applied", 4).alias("bias_applied"),
    )
    return verdicts.select("image_id", "is_flood", F.round("confidence", 3).alias("confidence"), "label",
                           details.alias("details"))
