"""Weather API payloads landed as JSON files, one response per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import WEATHER_PAYLOAD_DDL

# The 5 x 4 weather grid, lat-major, and the defaults for absent fields.
GRID_LATS = (12.840, 12.913, 12.986, 13.059, 13.130)
GRID_LONS = (77.462, 77.563, 77.664, 77.768)
DEFAULTS = {
    "temperature_c": 30.0,
    "humidity_pct": 60.0,
    "current_precip": 0.0,
    "rainfall_mm": 0.0,
    "temp_max": 32.0,
    "temp_min": 22.0,
    "wind_speed": 5.0,
}
# Defaults for a ward whose grid point is absent from the payload altogether.
ABSENT_POINT = {**DEFAULTS, "temperature_c": 28.0, "humidity_pct": 65.0}


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def rejected_payloads(payloads: DataFrame) -> DataFrame:
    """Payloads that are not JSON or name more locations than the grid has."""
    locations = F.from_json("value", f"ARRAY<{WEATHER_PAYLOAD_DDL}>")
    return payloads.filter(locations.isNull() | (F.size(locations) > len(GRID_LATS) * len(GRID_LONS)))


def grid_weather(payloads: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per grid point: position i of the response is (lat[i div 4], lon[i mod 4]); ``keep`` passes columns on.

    A response for a single location is an object instead of an array; ``from_json`` reads it as one element. A payload
    with more locations than the grid has points belongs to another grid: rejected_payloads() lists it.
    """
    locations = F.from_json("value", f"ARRAY<{WEATHER_PAYLOAD_DDL}>")
    points = payloads.filter(F.size(locations) <= len(GRID_LATS) * len(GRID_LONS)).select(
        *(keep or []), F.posexplode(locations).alias("i", "loc"))

    def field(path: str, name: str) -> Column:
        return F.coalesce(F.col(path), F.lit(DEFAULTS[name])).alias(name)

    def first_of(path: str, name: str) -> Column:
        return F.coalesce(F.get(F.col(path), F.lit(0)), F.lit(DEFAULTS[name])).alias(name)

    lats = F.array(*[F.lit(v) for v in GRID_LATS])
    lons = F.array(*[F.lit(v) for v in GRID_LONS])
    return points.select(
        *(keep or []),
        F.get(lats, F.floor(F.col("i") / len(GRID_LONS)).cast("int")).alias("grid_lat"),
        F.get(lons, F.pmod(F.col("i"), F.lit(len(GRID_LONS)))).alias("grid_lon"),
        field("loc.current.temperature_2m", "temperature_c"),
        field("loc.current.relative_humidity_2m", "humidity_pct"),
        field("loc.current.precipitation", "current_precip"),
        first_of("loc.daily.precipitation_sum", "rainfall_mm"),
        first_of("loc.daily.temperature_2m_max", "temp_max"),
        first_of("loc.daily.temperature_2m_min", "temp_min"),
        field("loc.current.wind_speed_10m", "wind_speed"),
    )


def nearest_grid_point(lon: Column, lat: Column) -> Column:
    """struct(grid_lat, grid_lon) nearest in squared degrees; the first point in lat-major order wins a tie.

    The grid is twenty constants, so this is a per-row expression: no join and no shuffle.
    """
    points = []
    for i, (glat, glon) in enumerate((a, o) for a in GRID_LATS for o in GRID_LONS):
        dlat, dlon = F.lit(glat) - lat, F.lit(glon) - lon
        points.append(
            F.struct(
                (dlat * dlat + dlon * dlon).alias("d2"),
                F.lit(i).alias("i"),
                F.lit(glat).alias("grid_lat"),
                F.lit(glon).alias("grid_lon"),
            )
        )
    best = F.array_min(F.array(*points))
    return F.struct(best["grid_lat"].alias("grid_lat"), best["grid_lon"].alias("grid_lon"))
