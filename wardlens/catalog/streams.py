"""Streaming jobs run to completion over the events table, compared with their batch equivalents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from ..operators import histograms
from ..plans.risk import threshold_alerts
from ..session import scratch_path
from ..sources.files import follow_parquet
from ..streaming import alerts as alert_jobs, arrivals as arrival_jobs, drift as drift_jobs, windows as window_jobs
from .readings import _WINDOW_DOUBLES, _WINDOW_SQL
from .registry import query
from .risk_jobs import ALERTS_SQL
from .views import Tables

# A window is closed once the newest event is 30 seconds past its end.
_CLOSED = f"""
SELECT * FROM ({_WINDOW_SQL}) WHERE window_end <= (SELECT max(ts) FROM readings) - INTERVAL '30 seconds'"""


def _readings_stream(t: Tables) -> DataFrame:
    """The readings view over a streaming scan of the events file."""
    schema = t.base("events").schema
    stream = follow_parquet(t.spark, t.folder, schema, "events.parquet")
    streaming = Tables(t.spark, t.folder)
    streaming.base = lambda name: stream if name == "events" else t.base(name)
    return streaming.readings


def _finish(query_) -> None:
    query_.awaitTermination()
    if query_.exception() is not None:
        raise query_.exception()


def _naive(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("T1 T2 T3 T5 K4 X2", "readings", _WINDOW_DOUBLES, _CLOSED)
def streamed_windows(t: Tables) -> DataFrame:
    out = scratch_path(t.spark, "windows")
    windows = window_jobs.windowed_stream(_readings_stream(t))
    _finish(window_jobs.append_stream(windows, os.path.join(out, "table"), os.path.join(out, "state"), once=True))
    return _naive(t.spark.read.schema(windows.schema).parquet(os.path.join(out, "table")))


@query("T4 X2 F2", "readings", _WINDOW_DOUBLES, f"SELECT * FROM ({_CLOSED}) WHERE has_anomaly = 1")
def streamed_anomalies(t: Tables) -> DataFrame:
    """The alert output of the two-output job."""
    out = scratch_path(t.spark, "anomalies")
    windows = window_jobs.windowed_stream(_readings_stream(t))
    _finish(window_jobs.publish_windows(
        windows, os.path.join(out, "features"), os.path.join(out, "alerts"), os.path.join(out, "state"), once=True))
    stored = t.spark.read.schema(windows.schema).option("recursiveFileLookup", True).parquet(os.path.join(out, "alerts"))
    return _naive(stored)


# Four chunks of arrivals, each its own start of the stream; every seventh reading comes two days late.
_CHUNKS = 4
_ARRIVED = """
arrived AS (
  SELECT * EXCLUDE (ward_id, ts), ward_id % 10 AS ward_id, event_id * 4 // ((SELECT max(event_id) FROM readings) + 1) AS chunk,
         ts + (event_id % 3) * INTERVAL '10 minutes' - (CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END) * INTERVAL '1 day' AS ts
  FROM readings),
marks AS (SELECT chunk, max(max(ts)) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL '30 seconds' AS mark
          FROM arrived GROUP BY chunk),
judged AS (SELECT *, time_bucket(INTERVAL '15 minutes', ts) AS window_start,
                  coalesce(time_bucket(INTERVAL '15 minutes', ts) + INTERVAL '15 minutes' <= mark, false) AS late
           FROM arrived JOIN marks USING (chunk))"""


@query("T3 T6 T12", "readings", f"{_WINDOW_DOUBLES}", f"""
WITH {_ARRIVED},
flagged AS (
  SELECT *, CASE WHEN lag(window_start) OVER w IS DISTINCT FROM window_start THEN 1 ELSE 0 END AS opens
  FROM judged WHERE NOT late WINDOW w AS (PARTITION BY ward_id ORDER BY event_id)),
islands AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY ward_id ORDER BY event_id) AS BIGINT) AS part FROM flagged),
parts AS (
  SELECT ward_id, part, window_start, window_start + INTERVAL '15 minutes' AS window_end,
         avg(temperature_c) AS avg_temperature_c, avg(humidity_pct) AS avg_humidity_pct, avg(pm25) AS avg_pm25,
         sum(rainfall_mm) AS sum_rainfall_mm, count(*) AS reading_count,
         CAST(avg(temperature_c) > 40 OR sum(rainfall_mm) > 20 AS INTEGER) AS has_anomaly,
         part = max(part) OVER (PARTITION BY ward_id) AS open
  FROM islands GROUP BY ward_id, part, window_start)
SELECT * EXCLUDE (open), CAST(NULL AS BIGINT) AS late_event FROM parts
WHERE NOT open OR window_end <= (SELECT max(ts) - INTERVAL '30 seconds' FROM arrived)
UNION ALL BY NAME
SELECT ward_id, event_id AS late_event, ts AS window_start, temperature_c AS avg_temperature_c, humidity_pct AS avg_humidity_pct,
       pm25 AS avg_pm25, rainfall_mm AS sum_rainfall_mm FROM judged WHERE late""")
def streamed_arrivals(t: Tables) -> DataFrame:
    """Both outputs of the arrival-order stream, stopped and started again between the chunks of arrivals."""
    out = scratch_path(t.spark, "arrivals")
    event = F.col("event_id")
    shifted = (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (event % 3 * 10).cast("int"))
               - F.make_dt_interval(F.when(event % 7 == 0, 2).otherwise(0)))
    rows = t.readings.withColumns({"ward_id": F.col("ward_id") % 10, "ts": shifted}).drop("sensor_id")
    chunk = F.floor(event * _CHUNKS / (t.base("events").agg(F.max("event_id")).scalar() + 1))
    for k in range(_CHUNKS):
        rows.filter(chunk == k).write.mode("append").parquet(os.path.join(out, "landed"))
        landed = follow_parquet(t.spark, os.path.join(out, "landed"), rows.schema)
        stream = arrival_jobs.arrival_stream(landed, "event_id")
        _finish(arrival_jobs.publish_arrivals(stream, os.path.join(out, "table"), os.path.join(out, "state"), once=True))
    stored = arrival_jobs.published(stream, os.path.join(out, "table"))
    parts = _naive(arrival_jobs.closed_parts(stored)).withColumn("late_event", F.lit(None).cast("long"))
    late = arrival_jobs.late_rows(stored).select(
        "ward_id", F.col("arrival").alias("late_event"), F.col("ts").cast("timestamp_ntz").alias("window_start"),
        F.col("temperature_c").alias("avg_temperature_c"), F.col("humidity_pct").alias("avg_humidity_pct"),
        F.col("pm25").alias("avg_pm25"), F.col("rainfall_mm").alias("sum_rainfall_mm"))
    return parts.unionByName(late, allowMissingColumns=True)


@query("T7 U3", "", "", """
SELECT ward_id, ts_ms, count(*) AS n FROM (
  SELECT DISTINCT user_id % 198 + 1 AS ward_id, epoch_ms(date_trunc('hour', ts)) AS ts_ms FROM events) GROUP BY ALL""")
def streamed_alert_keys(t: Tables) -> DataFrame:
    """Readings as alerts stamped by the hour: one per (ward, instant) survives."""
    out = scratch_path(t.spark, "alert-keys")
    alerts = _readings_stream(t).select(
        "ward_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp"),
        F.lit("heat_wave").alias("alert_type"))
    deduped = alert_jobs.dedupe_stream(alerts)
    _finish(window_jobs.append_stream(deduped, os.path.join(out, "table"), os.path.join(out, "state"), once=True))
    stored = t.spark.read.schema(deduped.schema).parquet(os.path.join(out, "table"))
    return stored.groupBy("ward_id", "ts_ms").agg(F.count(F.lit(1)).alias("n"))


@query("T9 X3 P34", "risks", "value threshold", ALERTS_SQL.replace("TIMESTAMP '2024-02-01 00:00:00'", "(SELECT max(ts) FROM events)"))
def evaluated_alerts(t: Tables) -> DataFrame:
    """One evaluation of the rules per micro-batch of events."""
    out = scratch_path(t.spark, "evaluated")
    ticks = _readings_stream(t).select(F.col("ts").cast("timestamp").alias("timestamp"))
    _finish(alert_jobs.evaluate_alerts(
        ticks, lambda: t.risks, os.path.join(out, "table"), os.path.join(out, "state"), once=True))
    shape = threshold_alerts(t.risks, F.current_timestamp()).schema
    stored = t.spark.read.schema(shape).option("recursiveFileLookup", True).parquet(os.path.join(out, "table"))
    return stored.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("T10 A14", "", "psi", """
WITH b AS (SELECT value AS v, 0 AS side FROM events UNION ALL SELECT value * 1.5::DOUBLE, 1 FROM events),
r AS (SELECT min(v) AS lo, (max(v) + 1e-6 - min(v)) / 10 AS w, (SELECT count(*) FROM events) AS n FROM b),
c AS (SELECT k, count(*) FILTER (WHERE side = 0 AND v >= lo + k * w AND (v < lo + (k + 1) * w OR k = 9)) AS c0,
             count(*) FILTER (WHERE side = 1 AND v >= lo + k * w AND (v < lo + (k + 1) * w OR k = 9)) AS c1,
             any_value(n) AS n FROM b, r, range(0, 10) t(k) GROUP BY k),
s AS (SELECT greatest(c0 / (n + 1e-8), 1e-6) AS e, greatest(c1 / (n + 1e-8), 1e-6) AS a FROM c)
SELECT 'pm25' AS metric, sum((a - e) * ln(a / e)) AS psi,
       CASE WHEN sum((a - e) * ln(a / e)) > 0.2 THEN 'CRITICAL' WHEN sum((a - e) * ln(a / e)) > 0.1 THEN 'WARN' ELSE 'OK' END AS level
FROM s""")
def streamed_drift(t: Tables) -> DataFrame:
    """Streamed readings, raised by half, against the stored ones."""
    out = scratch_path(t.spark, "drift")

    def long(df: DataFrame, factor: float) -> DataFrame:
        return df.select(F.lit("pm25").alias("metric"), (F.col("pm25") * factor).alias("value"))

    _finish(drift_jobs.monitor_drift(
        long(_readings_stream(t), 1.5), long(t.readings, 1.0), os.path.join(out, "table"), os.path.join(out, "state"),
        once=True))
    return t.spark.read.schema("metric STRING, psi DOUBLE, level STRING").option("recursiveFileLookup", True).parquet(
        os.path.join(out, "table"))


@query("T10 A14 K12", "", "psi", """
WITH b AS (SELECT value AS v, 0 AS side FROM events UNION ALL SELECT value * 1.5::DOUBLE, 1 FROM events),
r AS (SELECT min(v) AS lo, max(v) AS hi, CAST(ceil(log2((max(v) - min(v)) / 10)) AS INTEGER) - 1 AS s FROM b),
l AS (SELECT CASE WHEN floor(hi / pow(2, s)) - floor(lo / pow(2, s)) < 10 THEN s
                  WHEN floor(hi / pow(2, s + 1)) - floor(lo / pow(2, s + 1)) < 10 THEN s + 1 ELSE s + 2 END AS level, lo, hi FROM r),
c AS (SELECT CAST(floor(v / pow(2, level)) AS BIGINT) AS place, count(*) FILTER (WHERE side = 0) AS c0, count(*) FILTER (WHERE side = 1) AS c1
      FROM b, l GROUP BY 1),
g AS (SELECT unnest(range(CAST(floor(lo / pow(2, level)) AS BIGINT), CAST(floor(hi / pow(2, level)) AS BIGINT) + 1)) AS place FROM l),
s AS (SELECT greatest(coalesce(c0, 0) / ((SELECT count(*) FROM events) + 1e-8), 1e-6) AS e,
             greatest(coalesce(c1, 0) / ((SELECT count(*) FROM events) + 1e-8), 1e-6) AS a FROM g LEFT JOIN c USING (place))
SELECT 'pm25' AS metric, sum((a - e) * ln(a / e)) AS psi, true AS several FROM s""")
def streamed_drift_sketches(t: Tables) -> DataFrame:
    """Readings raised by half, in one micro-batch per file, against a baseline sketch taken once."""
    out = scratch_path(t.spark, "sketches")

    def long(df: DataFrame, factor: float) -> DataFrame:
        return df.select(F.lit("pm25").alias("metric"), (F.col("pm25") * factor).alias("value"))

    histograms.sketch(long(t.readings, 1.0)).write.parquet(os.path.join(out, "baseline"))
    baseline = t.spark.read.parquet(os.path.join(out, "baseline"))
    rows = t.readings.select("pm25")
    rows.repartition(3).write.parquet(os.path.join(out, "landed"))
    stream = long(follow_parquet(t.spark, os.path.join(out, "landed"), rows.schema, files_per_trigger=1), 1.5)
    _finish(drift_jobs.monitor_sketches(stream, baseline, os.path.join(out, "table"), os.path.join(out, "state"), once=True))
    reports = t.spark.read.parquet(os.path.join(out, "table", "reports")).agg((F.count_distinct("batch") >= 3).alias("several"))
    whole = histograms.stability(baseline, drift_jobs.stream_sketch(stream, os.path.join(out, "table")))
    return whole.withColumn("several", reports.scalar())
