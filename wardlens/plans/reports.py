"""Citizen reports: intake, image verdicts, flags and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.risk import citizen_severity, effective_report_type
from ..functions.text import citizen_flood_message, fallback_ward_name
from ..operators.filters import report_rules, since, validate
from ..operators.images import FLOOD_THRESHOLD
from ..operators.ranking import most_recent
from ..operators.sets import record_feedback
from ..operators.tables import delete_ids, set_flags
from ..schemas import add_missing_columns


def intake(reports: DataFrame, verdicts: DataFrame | None = None, ward_count: int = 198):
    """Validate new reports and, for those with an image verdict, set prediction, confidence and effective type.

    ``verdicts`` has image_url, is_flood, confidence. Returns (accepted, rejected).
    """
    accepted, rejected = validate(reports, report_rules(ward_count))
    if verdicts is None:
        return accepted.withColumn("flood_predicted", F.lit(False)).withColumn(
            "flood_confidence", F.lit(None).cast("double")), rejected
    joined = accepted.join(verdicts.select("image_url", "is_flood", "confidence"), "image_url", "left")
    predicted = F.coalesce("is_flood", F.lit(False))
    typed = joined.withColumn("flood_predicted", predicted).withColumn(
        "report_type", effective_report_type(F.col("report_type"), predicted)
    ).withColumn("flood_confidence", F.col("confidence"))
    return typed.drop("is_flood", "confidence"), rejected


def citizen_alerts(accepted: DataFrame, wards: DataFrame, as_of: Column) -> DataFrame:
    """One flood alert per accepted report with a flood verdict."""
    flooded = accepted.filter("flood_predicted").join(wards.select("ward_id", "ward_name"), "ward_id", "left")
    name = fallback_ward_name(F.col("ward_name"), F.col("ward_id"))
    return flooded.select(
        "ward_id", F.lit("flood_warning").alias("alert_type"),
        citizen_severity(F.col("flood_confidence")).alias("severity"),
        citizen_flood_message(name, F.col("flood_confidence")).alias("message"),
        (F.col("flood_confidence") * 100).alias("value"), F.lit(100 * FLOOD_THRESHOLD).alias("threshold"),
        as_of.alias("timestamp"), F.col("id").alias("report_id"), F.lit("citizen_image").alias("source"),
    )


def with_review_columns(reports: DataFrame) -> DataFrame:
    return add_missing_columns(reports, {"is_fake": False, "bbmp_confirmed": False})


def recent(reports: DataFrame, limit: int = 20) -> DataFrame:
    return most_recent(with_review_columns(reports), "reported_at", limit)


def flag_fake(reports: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    return set_flags(reports, ids, "id", {"is_fake": F.lit(True), "fake_flagged_at": as_of})


def confirm(reports: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    return set_flags(reports, ids, "id", {"bbmp_confirmed": F.lit(True), "confirmed_at": as_of})


def delete(reports: DataFrame, feedback: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove reports and clear their feedback."""
    cleared = ids.select(F.col("id").alias("report_id"), F.lit("clear").alias("label"))
    entries = feedback.sparkSession.createDataFrame([], feedback.schema).unionByName(cleared, allowMissingColumns=True)
    return delete_ids(reports, ids, "id"), record_feedback(feedback, entries)


def recent_counts(reports: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Reports of the last days per ward and type."""
    from ..operators.aggregates import reports_per_ward_and_type

    return reports_per_ward_and_type(reports.filter(since("reported_at", as_of, f"{days} days")))
