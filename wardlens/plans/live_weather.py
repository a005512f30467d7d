"""Weather payload to ward features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.risk import effective_rainfall, uhi_offset, uhi_surface_temperature
from ..operators.joins import with_static_features
from ..sources.weather import ABSENT_POINT, nearest_grid_point


def live_ward_weather(grid: DataFrame, wards: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Each ward takes its nearest grid point's weather, its static features, and the heat-island adjustment.

    ``wards`` has ward_id, ward_name, centroid_lon, centroid_lat; ``grid`` is the parsed payload.
    """
    placed = wards.withColumn("_g", nearest_grid_point(F.col("centroid_lon"), F.col("centroid_lat"))).select(
        *wards.columns, F.col("_g.grid_lat").alias("weather_grid_lat"), F.col("_g.grid_lon").alias("weather_grid_lon"))
    # one row per grid point; whether they are broadcast is left to their measured size
    values = [c for c in grid.columns if c not in ("grid_lat", "grid_lon")]
    points = grid.groupBy(
        F.col("grid_lat").alias("weather_grid_lat"), F.col("grid_lon").alias("weather_grid_lon")
    ).agg(F.max(F.struct(*values)).alias("v")).select("weather_grid_lat", "weather_grid_lon", "v.*")
    joined = placed.join(points, ["weather_grid_lat", "weather_grid_lon"], "left")
    for name, default in ABSENT_POINT.items():
        joined = joined.withColumn(name, F.coalesce(name, F.lit(default)))
    full = with_static_features(joined, snapshot)
    imp, ind = F.col("impervious_pct"), F.col("industrial_weight")
    return (
        full.withColumn("uhi_offset", uhi_offset(imp, ind))
        .withColumn("lst_celsius", uhi_surface_temperature(F.col("temperature_c"), imp, ind, F.col("ndvi")))
        .withColumn("rainfall_mm", effective_rainfall(F.col("rainfall_mm"), F.col("current_precip")))
    )
