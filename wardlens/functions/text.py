"""Messages, labels and event-time parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def event_time(text: Column, fallback: Column | None = None) -> Column:
    """ISO-8601 text to timestamp; an unparsable value takes ``fallback`` (an ingest-time column), never the clock."""
    parsed = F.try_to_timestamp(text)
    return parsed if fallback is None else F.coalesce(parsed, fallback)


def title_case(snake: Column) -> Column:
    return F.initcap(F.replace(snake, F.lit("_"), F.lit(" ")))


def fallback_ward_name(name: Column, ward_id: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("Ward-"), ward_id.cast("string")))


def critical_label(name: Column) -> Column:
    return F.concat(F.lit("CRITICAL: "), name)


def score_message(prefix: str, name: Column, score: Column) -> Column:
    """e.g. "High heat stress in X: 61/100"; the score is shown without decimals (halves to even)."""
    return F.concat(F.lit(prefix), F.lit(" in "), name, F.lit(": "), F.bround(score, 0).cast("int").cast("string"),
                    F.lit("/100"))


def citizen_flood_message(name: Column, confidence: Column) -> Column:
    percent = F.bround(confidence * 100, 0).cast("int").cast("string")
    return F.concat(F.lit("🌊 Citizen-reported flooding in "), name, F.lit(" (AI confidence: "), percent, F.lit("%)"))


def iso_utc(ts: Column) -> Column:
    """Sink rendering of a timestamp; the session zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")
