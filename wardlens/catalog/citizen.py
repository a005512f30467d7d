"""Citizen reports and image scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.geo import SERVICE_BBOX
from ..operators import aggregates, filters, images
from ..operators.ranking import most_recent
from ..plans import reports as jobs
from ..session import scratch_path
from ..sinks.rasters import write_images
from ..sources.rasters import read_image_files
from .registry import query
from .views import Tables


def _at(value: str):
    return F.to_timestamp_ntz(F.lit(value))


@query("A3 X19", "reports", "avg_severity", """
SELECT report_type, count(*) AS report_count, avg(severity) AS avg_severity, max(reported_at) AS latest_at
FROM reports GROUP BY report_type""")
def reports_by_type(t: Tables) -> DataFrame:
    return aggregates.reports_by_type(t.reports)


@query("A3 F9 X19", "reports", "avg_severity", """
SELECT ward_id, report_type, count(*) AS report_count, avg(severity) AS avg_severity, max(reported_at) AS latest_at
FROM reports WHERE reported_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL '7 days' GROUP BY ward_id, report_type""")
def recent_ward_reports(t: Tables) -> DataFrame:
    return jobs.recent_counts(t.reports, _at("2024-01-30 00:00:00"), 7)


_B = SERVICE_BBOX
_RULES = f"""
checked AS (SELECT *, NOT (latitude BETWEEN {_B.south} AND {_B.north} AND longitude BETWEEN {_B.west} AND {_B.east}) AS bad_place,
                   NOT severity_ BETWEEN 1 AND 5 AS bad_severity
            FROM (SELECT *, CASE WHEN id % 13 = 0 THEN 9 ELSE severity END AS severity_ FROM reports))"""


@query("F12 X19", "reports", "", f"""
WITH {_RULES} SELECT id, CASE WHEN bad_place AND bad_severity THEN 'location,severity' WHEN bad_place THEN 'location'
  ELSE 'severity' END AS broken FROM checked WHERE bad_place OR bad_severity""")
def rejected_reports(t: Tables) -> DataFrame:
    _, rejected = filters.validate(_damaged(t), filters.report_rules())
    return rejected.select("id", F.array_join("broken_rules", ",").alias("broken"))


@query("F12", "scores", "", """
SELECT ward_id FROM scores WHERE ward_id <= 198 AND heat_stress_score BETWEEN 0 AND 100 AND flood_risk_score BETWEEN 0 AND 100""")
def valid_scores(t: Tables) -> DataFrame:
    accepted, _ = filters.validate(t.scores, filters.score_rules())
    return accepted.select("ward_id")


def _damaged(t: Tables) -> DataFrame:
    """Every thirteenth report has an impossible severity; many lie outside the service box."""
    return t.reports.withColumn("severity", F.when(F.col("id") % 13 == 0, 9).otherwise(F.col("severity")))


def _verdicts(t: Tables) -> DataFrame:
    key = F.col("event_id")
    return t.base("events").select(
        F.concat(F.lit("img-"), key.cast("string")).alias("image_url"), (F.col("value") > 20).alias("is_flood"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"))


@query("X19 P35", "reports", "flood_confidence", f"""
WITH {_RULES}
SELECT c.id, CASE WHEN e.value > 20 THEN 'flood' ELSE report_type END AS report_type,
       e.value > 20 AS flood_predicted, least(e.value / 100, 1.0) AS flood_confidence
FROM checked c JOIN events e ON e.event_id = c.id WHERE NOT bad_place AND NOT bad_severity""")
def accepted_reports(t: Tables) -> DataFrame:
    """Reports with the verdict on their image."""
    with_images = _damaged(t).withColumn("image_url", F.concat(F.lit("img-"), F.col("id").cast("string")))
    accepted, _ = jobs.intake(with_images, _verdicts(t))
    return accepted.select("id", "report_type", "flood_predicted", "flood_confidence")


@query("P35 P34 X19", "reports wards", "value threshold", f"""
WITH {_RULES}
SELECT id AS report_id, c.ward_id, CASE WHEN least(e.value / 100, 1.0) >= 0.75 THEN 'critical' ELSE 'high' END AS severity,
       '🌊 Citizen-reported flooding in ' || ward_name || ' (AI confidence: '
         || CAST(round_even(least(e.value / 100, 1.0) * 100, 0) AS INTEGER) || '%)' AS message,
       least(e.value / 100, 1.0) * 100 AS value, 52.0 AS threshold
FROM checked c JOIN events e ON e.event_id = c.id JOIN wards w ON w.ward_id = c.ward_id
WHERE NOT bad_place AND NOT bad_severity AND e.value > 20""")
def citizen_alerts(t: Tables) -> DataFrame:
    with_images = _damaged(t).withColumn("image_url", F.concat(F.lit("img-"), F.col("id").cast("string")))
    accepted, _ = jobs.intake(with_images, _verdicts(t))
    alerts = jobs.citizen_alerts(accepted, t.wards, _at("2024-02-01 00:00:00"))
    return alerts.select("report_id", "ward_id", "severity", "message", "value", "threshold")


def _image_pixels(t: Tables) -> DataFrame:
    """Line items as pixels: one image per supplier, colours from keys and quantity."""
    return t.base("lineitem").select(
        F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") % 100).cast("int").alias("y"),
        (F.col("l_suppkey") * 2 % 120 + F.col("l_quantity")).cast("int").alias("r"),
        (F.col("l_partkey") % 60 + F.col("l_suppkey") % 100).cast("int").alias("g"),
        (F.col("l_suppkey") % 70 + F.col("l_linenumber") * 15).cast("int").alias("b"), F.lit(100).alias("height"))


_PIXEL_CLASSES = """
px AS (SELECT l_suppkey AS image_id, l_orderkey % 100 AS y, CAST(l_suppkey * 2 % 120 + l_quantity AS INTEGER) AS r,
              CAST(l_partkey % 60 + l_suppkey % 100 AS INTEGER) AS g, CAST(l_suppkey % 70 + l_linenumber * 15 AS INTEGER) AS b
       FROM lineitem),"""
_CLASSES = """
bright AS (SELECT *, (r + g + b) / 3.0 AS br FROM px WHERE y >= 40),
classes AS (
  SELECT image_id,
    avg(CASE WHEN b > r + 15 AND b > g + 5 AND br > 40 AND br < 180 THEN 1.0 ELSE 0.0 END
      + CASE WHEN abs(r - g) < 30 AND abs(g - b) < 30 AND br < 130 THEN 0.6 ELSE 0.0 END) AS water,
    avg(CASE WHEN r > g AND g > b AND r > 80 AND b < 100 AND r - b > 30 THEN 1.0 ELSE 0.0 END) AS mud,
    avg(CASE WHEN br < 50 THEN 0.5 ELSE 0.0 END) AS dark,
    avg(CASE WHEN g > r + 20 AND g > b + 20 THEN 1.0 ELSE 0.0 END) AS green,
    avg(CASE WHEN r > 160 AND g > 130 AND b < 110 THEN 0.5 ELSE 0.0 END) AS dry
  FROM bright GROUP BY image_id)"""
_PIXEL_CLASSES += _CLASSES
_IMAGE_DOUBLES = "water mud dark green dry raw_flood_score bias_applied confidence"


@query("A21 P27", "", "water mud dark green dry", f"WITH {_PIXEL_CLASSES} SELECT * FROM classes")
def pixel_classes(t: Tables) -> DataFrame:
    return images.pixel_classes(_image_pixels(t))


_VERDICTS = """
w AS (SELECT label, CASE WHEN floor((epoch_us(TIMESTAMP '2024-02-01 12:00:00') - epoch_us(flagged_at)) / 86400000000) < 3
                         THEN 2.0 ELSE 1.0 END AS weight FROM feedback),
bias AS (SELECT least(greatest(coalesce(sum(weight) FILTER (WHERE label = 'real'), 0) * 0.01
                - coalesce(sum(weight) FILTER (WHERE label = 'fake'), 0) * 0.03, -0.25), 0.15)::DOUBLE AS bias_applied FROM w),
raw AS (SELECT c.*, least(greatest(water * 0.45 + mud * 0.30 + dark * 0.10 + green * -0.15 + dry * -0.10, 0.0), 1.0) AS raw_flood_score,
               bias_applied FROM classes c, bias),
conf AS (SELECT *, 1.0 / (1.0 + exp(-(least(greatest(raw_flood_score + bias_applied, 0.0), 1.0) * 10.0 - 2.5))) AS confidence FROM raw)
SELECT *, confidence >= 0.52 AS is_flood, CASE WHEN confidence >= 0.52 THEN 'flood' ELSE 'no_flood' END AS label FROM conf"""


@query("X20 A20 A21", "feedback", _IMAGE_DOUBLES, f"WITH {_PIXEL_CLASSES},{_VERDICTS}")
def image_verdicts(t: Tables) -> DataFrame:
    return images.score_images(_image_pixels(t), t.feedback, _at("2024-02-01 12:00:00"))


_FILE_PIXELS = """
given AS (SELECT l_suppkey AS image_id, l_orderkey % 100 AS y, l_partkey % 16 AS x, max(CAST(l_suppkey * 2 % 120 + l_quantity AS INTEGER)) AS r,
                 max(CAST(l_partkey % 60 + l_suppkey % 100 AS INTEGER)) AS g, max(CAST(l_suppkey % 70 + l_linenumber * 15 AS INTEGER)) AS b
          FROM lineitem GROUP BY ALL),
px AS (SELECT image_id, y, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b
       FROM (SELECT * FROM (SELECT DISTINCT image_id FROM given), (SELECT unnest(range(100)) AS y), (SELECT unnest(range(16)) AS x))
       LEFT JOIN given USING (image_id, y, x)),"""


@query("S10 X20 A20 A21", "feedback", _IMAGE_DOUBLES, f"WITH {_FILE_PIXELS}{_CLASSES},{_VERDICTS}")
def image_verdicts_from_files(t: Tables) -> DataFrame:
    """Images written as RGB files of 100 by 16 pixels, read back strip by strip, and scored."""
    path = scratch_path(t.spark, "images")
    x = (F.col("l_partkey") % 16).cast("int")
    placed = t.base("lineitem").withColumn("image_id", F.col("l_suppkey")).select(
        "image_id", x.alias("x"), (F.col("l_orderkey") % 100).cast("int").alias("y"),
        (F.col("l_suppkey") * 2 % 120 + F.col("l_quantity")).cast("int").alias("r"),
        (F.col("l_partkey") % 60 + F.col("l_suppkey") % 100).cast("int").alias("g"),
        (F.col("l_suppkey") % 70 + F.col("l_linenumber") * 15).cast("int").alias("b"))
    one_each = placed.groupBy("image_id", "x", "y").agg(*[F.max(c).alias(c) for c in "rgb"])
    write_images(one_each, path, 100, 16).write.format("noop").mode("overwrite").save()
    pixels = read_image_files(t.spark, path).withColumn("image_id", F.col("image_id").cast("long"))
    return images.score_images(pixels, t.feedback, _at("2024-02-01 12:00:00"))


@query("X19 K11 U8", "reports feedback", "", """
SELECT id, id IN (SELECT report_id FROM feedback WHERE label = 'fake') AS is_fake,
       id IN (SELECT report_id FROM feedback WHERE label = 'real') AS bbmp_confirmed
FROM reports WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def reviewed_reports(t: Tables) -> DataFrame:
    """Reports after review: fakes flagged, real ones confirmed, toxic ones deleted."""
    def ids(label: str) -> DataFrame:
        return t.feedback.filter(F.col("label") == label).select(F.col("report_id").alias("id"))

    stored = jobs.with_review_columns(t.reports)
    for column in ("fake_flagged_at", "confirmed_at"):
        stored = stored.withColumn(column, F.lit(None).cast("timestamp_ntz"))
    as_of = _at("2024-02-01 00:00:00")
    reviewed = jobs.confirm(jobs.flag_fake(stored, ids("fake"), as_of), ids("real"), as_of)
    toxic = t.base("labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    kept, _ = jobs.delete(reviewed, t.feedback, toxic)
    return kept.select("id", "is_fake", "bbmp_confirmed")


@query("X19 U8", "feedback", "", """
SELECT report_id, label FROM feedback WHERE report_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def feedback_after_delete(t: Tables) -> DataFrame:
    toxic = t.base("labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    _, feedback = jobs.delete(t.reports, t.feedback, toxic)
    return feedback.select("report_id", "label")


@query("L6 X20", "feedback", "", """
SELECT report_id, label, flagged_at FROM feedback ORDER BY flagged_at DESC, report_id DESC LIMIT 20""")
def recent_feedback(t: Tables) -> DataFrame:
    return most_recent(t.feedback, "flagged_at", 20, "report_id")
