"""Attribution report from stored importances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.history import global_importance, top_features

# Importances shown while no model has produced any.
STATIC_IMPORTANCE = (
    ("lst_celsius", 0.248, "Land Surface Temperature"),
    ("ndvi", 0.187, "Vegetation Index"),
    ("impervious_pct", 0.162, "Impervious Surface %"),
    ("rainfall_mm_24h", 0.141, "24h Rainfall"),
    ("pm25_ugm3", 0.098, "PM2.5 Concentration"),
    ("population_density", 0.074, "Population Density"),
    ("ndbi", 0.052, "Built-up Index"),
    ("industrial_weight", 0.038, "Industrial Proximity"),
)


def ward_report(predictions: DataFrame, importance: DataFrame, names: list[str], k: int = 4) -> DataFrame:
    """Predicted scores of each ward with its k main features as an array of structs."""
    scores = predictions.select(
        "ward_id", F.col("heat_stress_score").alias("heat_stress"), F.col("flood_risk_score").alias("flood_risk"))
    return scores.join(top_features(importance, names, k), "ward_id")


def feature_importance(spark: SparkSession, importance: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """Global importance from the model's importances, or the static table when there are none."""
    if importance is not None and not importance.isEmpty():
        return global_importance(importance, names).withColumn("source", F.lit("model_gradient"))
    static = spark.createDataFrame(list(STATIC_IMPORTANCE), "feature STRING, importance DOUBLE, description STRING")
    return static.withColumn("source", F.lit("static_fallback"))
