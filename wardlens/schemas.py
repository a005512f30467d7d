"""Declared table schemas and the conform step that enforces them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    BooleanType, DataType, DateType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType,
    TimestampType,
)

_TYPES: dict[str, DataType] = {
    "INT": IntegerType(), "BIGINT": LongType(), "DOUBLE": DoubleType(), "STRING": StringType(),
    "BOOLEAN": BooleanType(), "DATE": DateType(), "TIMESTAMP": TimestampType(),
    "LABELS": MapType(StringType(), StringType()),
}


def _schema(columns: str, required: tuple[str, ...] = ()) -> StructType:
    """"name TYPE, ..." without needing a session, so that schemas can be module constants."""
    pairs = [column.split() for column in columns.split(",")]
    return StructType([StructField(name, _TYPES[kind], name not in required) for name, kind in pairs])


RAW_IOT = _schema(
    "ward_id INT, sensor_id STRING, timestamp STRING, lat DOUBLE, lon DOUBLE, temperature_c DOUBLE, "
    "humidity_pct DOUBLE, pm25 DOUBLE, rainfall_mm DOUBLE",
    ("ward_id", "sensor_id", "timestamp"),
)

WARD_WINDOW_FEATURES = _schema(
    "ward_id INT, window_start TIMESTAMP, window_end TIMESTAMP, avg_temperature_c DOUBLE, avg_humidity_pct DOUBLE, "
    "avg_pm25 DOUBLE, sum_rainfall_mm DOUBLE, reading_count INT, has_anomaly INT",
    ("ward_id", "window_start", "window_end"),
)

SATELLITE_FEATURES = _schema(
    "ward_id INT, scene_date DATE, ndvi DOUBLE, ndbi DOUBLE, impervious_pct DOUBLE, lst_celsius DOUBLE, "
    "source_scene STRING",
    ("ward_id", "scene_date"),
)

PIXELS = _schema(
    "scene_id STRING, row INT, col INT, b2 INT, b3 INT, b4 INT, b5 INT, b6 INT, b7 INT, b10 INT",
    ("scene_id", "row", "col"),
)

SCENE_CATALOGUE = _schema(
    "scene_id STRING, sensor STRING, acquired DATE, west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE, "
    "cloud_cover DOUBLE",
    ("scene_id",),
)

WARD_FEATURES = _schema(
    "ward_id INT, ward_code STRING, ward_name STRING, centroid_lon DOUBLE, centroid_lat DOUBLE, lst_celsius DOUBLE, "
    "ndvi DOUBLE, impervious_pct DOUBLE, rainfall_mm_24h DOUBLE, flood_reports_7d INT, pm25_ugm3 DOUBLE, "
    "population_density DOUBLE, area_km2 DOUBLE, heat_stress_score DOUBLE, flood_risk_score DOUBLE, "
    "industrial_weight DOUBLE",
    ("ward_id",),
)

WEATHER_READINGS = _schema(
    "id BIGINT, ward_id INT, ward_name STRING, lat DOUBLE, lon DOUBLE, timestamp TIMESTAMP, temperature_2m DOUBLE, "
    "humidity_pct DOUBLE, precipitation_mm DOUBLE, wind_speed_kmh DOUBLE, surface_pressure DOUBLE, "
    "cloud_cover_pct DOUBLE, source STRING, ingested_at TIMESTAMP",
    ("ward_id", "timestamp"),
)

# one element of a weather API response
WEATHER_PAYLOAD_DDL = (
    "STRUCT<current: STRUCT<temperature_2m: DOUBLE, relative_humidity_2m: DOUBLE, precipitation: DOUBLE, "
    "wind_speed_10m: DOUBLE>, daily: STRUCT<precipitation_sum: ARRAY<DOUBLE>, temperature_2m_max: ARRAY<DOUBLE>, "
    "temperature_2m_min: ARRAY<DOUBLE>>>"
)

WARD_RISK_SCORES = _schema(
    "ward_id INT, heat_stress_score DOUBLE, flood_risk_score DOUBLE, risk_level STRING, lst_pred_celsius DOUBLE, "
    "ndvi DOUBLE, impervious_pct DOUBLE, created_at TIMESTAMP, updated_at TIMESTAMP",
    ("ward_id",),
)

WARDS = _schema("ward_id INT, ward_name STRING, centroid_lat DOUBLE, centroid_lon DOUBLE", ("ward_id",))

CITIZEN_REPORTS = _schema(
    "id BIGINT, ward_id INT, latitude DOUBLE, longitude DOUBLE, report_type STRING, severity INT, "
    "description STRING, image_url STRING, flood_predicted BOOLEAN, flood_confidence DOUBLE, reported_at TIMESTAMP, "
    "source STRING, is_fake BOOLEAN, bbmp_confirmed BOOLEAN, fake_flagged_at TIMESTAMP, confirmed_at TIMESTAMP",
    ("id", "ward_id", "report_type"),
)

FEEDBACK = _schema("report_id BIGINT, label STRING, image_path STRING, flagged_at TIMESTAMP", ("report_id", "label"))

IMAGE_PIXELS = _schema(
    "image_id STRING, x INT, y INT, r INT, g INT, b INT, height INT, width INT", ("image_id",)
)

INTERVENTION_LOG = _schema(
    "id INT, ward_id INT, intervention_type STRING, cost INT, expected_heat_reduction DOUBLE, "
    "expected_flood_reduction DOUBLE, created_at TIMESTAMP",
    ("id",),
)

RUN_METRICS = _schema(
    "run_id STRING, experiment STRING, run_name STRING, status STRING, metric_name STRING, metric_value DOUBLE, "
    "step BIGINT, logged_at TIMESTAMP",
    ("run_id", "metric_name"),
)

METRIC_SERIES = _schema("ts TIMESTAMP, name STRING, labels LABELS, value DOUBLE", ("ts", "name"))

DRIFT_BASELINE = _schema("model STRING, metric STRING, value DOUBLE", ("model", "metric"))

TABLES: dict[str, StructType] = {
    "raw_iot": RAW_IOT,
    "ward_window_features": WARD_WINDOW_FEATURES,
    "satellite_features": SATELLITE_FEATURES,
    "pixels": PIXELS,
    "scene_catalogue": SCENE_CATALOGUE,
    "ward_features": WARD_FEATURES,
    "weather_readings": WEATHER_READINGS,
    "ward_risk_scores": WARD_RISK_SCORES,
    "wards": WARDS,
    "citizen_reports": CITIZEN_REPORTS,
    "feedback": FEEDBACK,
    "image_pixels": IMAGE_PIXELS,
    "interventions": INTERVENTION_LOG,
    "run_metrics": RUN_METRICS,
    "metric_series": METRIC_SERIES,
    "drift_baseline": DRIFT_BASELINE,
}


def empty_table(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: cast, order, and null-fill optional columns.

    A required column that is absent fails at plan time; a null in a required column fails the job that reads it.
    """
    missing = [f.name for f in schema.fields if not f.nullable and f.name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    columns = []
    for field in schema.fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = value.cast(field.dataType)
        if not field.nullable:
            value = F.when(value.isNotNull(), value).otherwise(
                F.raise_error(F.lit(f"null in required column {field.name}")).cast(field.dataType)
            )
        columns.append(value.alias(field.name))
    return df.select(*columns)


def add_missing_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Column-add evolution: absent columns appear with the default, stored nulls read as the default."""
    out = df
    for name, default in defaults.items():
        value = F.lit(default)
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return out
