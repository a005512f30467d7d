"""Sensor readings: parse, windows, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregates, joins, ranking, running, series, sliding
from ..plans import dashboard
from ..schemas import RAW_IOT
from ..sources.messages import parse_sensor_messages, valid_json
from ..session import cut_lineage
from .registry import query
from .views import Tables, sensor_k

_WINDOW_SQL = """
SELECT ward_id, time_bucket(INTERVAL '15 minutes', ts) AS window_start,
       time_bucket(INTERVAL '15 minutes', ts) + INTERVAL '15 minutes' AS window_end,
       avg(temperature_c) AS avg_temperature_c, avg(humidity_pct) AS avg_humidity_pct, avg(pm25) AS avg_pm25,
       sum(rainfall_mm) AS sum_rainfall_mm, count(*) AS reading_count,
       CAST(avg(temperature_c) > 40 OR sum(rainfall_mm) > 20 AS INTEGER) AS has_anomaly
FROM readings GROUP BY ALL"""
_WINDOW_DOUBLES = "avg_temperature_c avg_humidity_pct avg_pm25 sum_rainfall_mm"


@query("A1 X2 D2 T2 T12", "readings", _WINDOW_DOUBLES, _WINDOW_SQL)
def ward_windows(t: Tables) -> DataFrame:
    return aggregates.ward_windows(t.readings)


@query("F2 A1", "readings", _WINDOW_DOUBLES, f"SELECT * FROM ({_WINDOW_SQL}) WHERE has_anomaly = 1")
def anomaly_windows(t: Tables) -> DataFrame:
    return aggregates.anomalies(aggregates.ward_windows(t.readings))


@query("A1", "readings", _WINDOW_DOUBLES, _WINDOW_SQL.replace("15 minutes", "1 day").replace(
    "SELECT ward_id", "SELECT ward_id % 10 AS ward_id"))
def daily_zone_windows(t: Tables) -> DataFrame:
    """Coarse zones and days: windows with many rows each."""
    return aggregates.ward_windows(t.readings.withColumn("ward_id", F.col("ward_id") % 10), 24 * 60)


@query("P1 F1 S1 N1 D1", "", "temperature_c", """
SELECT user_id % 198 + 1 AS ward_id, ts, 20.0 + value * 0.2 AS temperature_c
FROM events WHERE event_id % 5 != 0 AND event_id % 7 != 0""")
def parsed_messages(t: Tables) -> DataFrame:
    """Every fifth message is broken JSON and every seventh lacks the sensor fields; both become rejects."""
    accepted, _ = parse_sensor_messages(_messages(t))
    return accepted.select(F.col("ward_id").cast("bigint").alias("ward_id"), F.col("ts").cast("timestamp_ntz")
                           .alias("ts"), "temperature_c")


@query("P1 F13 T8", "", "", """
SELECT count(*) FILTER (WHERE event_id % 5 = 0 OR event_id % 7 = 0) AS rejected,
       count(*) FILTER (WHERE event_id % 5 != 0) AS valid_json FROM events""")
def rejected_messages(t: Tables) -> DataFrame:
    messages = _messages(t)
    _, rejected = parse_sensor_messages(messages)
    forwarded = valid_json(messages).agg(F.count(F.lit(1)))
    return rejected.agg(F.count(F.lit(1)).alias("rejected")).withColumn("valid_json", forwarded.scalar())


def _messages(t: Tables) -> DataFrame:
    """Readings as topic messages, some of them damaged."""
    fields = F.struct(
        "ward_id", "sensor_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.lit(12.9).alias("lat"), F.lit(77.6).alias("lon"), "temperature_c", "humidity_pct", "pm25", "rainfall_mm",
    )
    body = F.to_json(fields)
    other = F.to_json(F.struct("ward_id", F.col("temperature_c").alias("temperature_2m")))
    value = F.when(F.col("event_id") % 5 == 0, F.substring(body, 1, 30)).when(
        F.col("event_id") % 7 == 0, other).otherwise(body)
    return t.readings.select(value.alias("value"), F.col("ts").cast("timestamp").alias("ingest_ts"))


@query("P2 P3", "", "k", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE ts END AS ts,
       CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k
FROM events""")
def tolerant_casts(t: Tables) -> DataFrame:
    """Unparsable times take the ingest time, unparsable numbers count as 0."""
    from ..functions.numeric import numeric_or_zero
    from ..functions.text import event_time

    text = F.when(F.col("event_id") % 3 == 0, "not a time").otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    k = F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(sensor_k().cast("string"))
    ingest = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return t.base("events").select(
        "event_id", event_time(text, ingest).cast("timestamp_ntz").alias("ts"), numeric_or_zero(k).alias("k"))


@query("T6", "readings", _WINDOW_DOUBLES, """
WITH rows_ AS (
  SELECT *, time_bucket(INTERVAL '15 minutes', ts + (event_id % 3) * INTERVAL '10 minutes') AS window_start
  FROM (SELECT * REPLACE (ward_id % 10 AS ward_id) FROM readings)),
flagged AS (
  SELECT *, CASE WHEN lag(window_start) OVER w IS DISTINCT FROM window_start THEN 1 ELSE 0 END AS opens
  FROM rows_ WINDOW w AS (PARTITION BY ward_id ORDER BY event_id)),
islands AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY ward_id ORDER BY event_id) AS BIGINT) AS part FROM flagged)
SELECT ward_id, part, window_start, window_start + INTERVAL '15 minutes' AS window_end,
       avg(temperature_c) AS avg_temperature_c, avg(humidity_pct) AS avg_humidity_pct, avg(pm25) AS avg_pm25,
       sum(rainfall_mm) AS sum_rainfall_mm, count(*) AS reading_count,
       CAST(avg(temperature_c) > 40 OR sum(rainfall_mm) > 20 AS INTEGER) AS has_anomaly,
       part = max(part) OVER (PARTITION BY ward_id) AS open
FROM islands GROUP BY ward_id, part, window_start""")
def arrival_order_windows(t: Tables) -> DataFrame:
    """Out-of-order arrivals (event time shifted by up to 20 minutes) split windows into several partial rows."""
    shifted = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") % 3 * 10).cast("int"))
    rows = t.readings.withColumn("ward_id", F.col("ward_id") % 10).withColumn("ts", shifted)
    return running.arrival_order_windows(rows, "event_id", block=2000)


@query("W1 J2", "readings wards", "value", """
SELECT i.ward_id, ts, event_id, w.ward_name, SUM(rainfall_mm) OVER (PARTITION BY i.ward_id ORDER BY ts) AS value
FROM readings i JOIN wards w ON i.ward_id = w.ward_id WHERE ts > TIMESTAMP '2024-01-02 00:00:00'""")
def running_rainfall(t: Tables) -> DataFrame:
    start = F.to_timestamp_ntz(F.lit("2024-01-02 00:00:00"))
    return dashboard.running_rainfall(t.readings, t.wards, start).select(
        "ward_id", "ts", "event_id", "ward_name", "value")


@query("A8 F9", "readings", "", """
SELECT count(DISTINCT sensor_id) AS active_sensors FROM readings
WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL '10 days'""")
def active_sensors(t: Tables) -> DataFrame:
    as_of = F.to_timestamp_ntz(F.lit("2024-01-20 12:00:00"))
    return aggregates.active_sensors(t.readings, as_of - F.expr("INTERVAL 10 days"))


@query("J10", "readings scores", "temperature_c", """
SELECT ward_id, sensor_id, ts, temperature_c FROM readings
WHERE ward_id IN (SELECT ward_id % 198 + 1 FROM scores GROUP BY 1 ORDER BY max(heat_stress_score) DESC, 1 LIMIT 5)
  AND ts > TIMESTAMP '2024-01-03 00:00:00'""")
def hottest_ward_sensors(t: Tables) -> DataFrame:
    start = F.to_timestamp_ntz(F.lit("2024-01-03 00:00:00"))
    city = t.scores.groupBy((F.col("ward_id") % 198 + 1).alias("ward_id")).agg(
        F.max("heat_stress_score").alias("heat_stress_score"))
    return dashboard.hot_ward_sensors(t.readings, city, start).select("ward_id", "sensor_id", "ts", "temperature_c")


def _counter(t: Tables) -> DataFrame:
    """A counter per event type that restarts at midnight, sampled at every event's minute."""
    minute = F.date_trunc("minute", "ts")
    per_minute = t.base("events").groupBy("event_type", minute.alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    daily = running.running(
        per_minute.withColumn("day", F.to_date("ts")), ["event_type", "day"], ["ts"], F.date_trunc("hour", F.col("ts")),
        {"value": ("sum", F.col("n"))})
    return cut_lineage(daily.select("event_type", "ts", "value"))


_COUNTER_SQL = """
counter AS (
  SELECT event_type, ts, CAST(sum(n) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts) AS DOUBLE) AS value
  FROM (SELECT event_type, date_trunc('minute', ts) AS ts, count(*) AS n FROM events GROUP BY ALL))"""


@query("W13", "", "increase rate", f"""
WITH {_COUNTER_SQL},
steps AS (
  SELECT *, lag(value) OVER w AS prev, lag(ts) OVER w AS prev_ts, time_bucket(INTERVAL '1 hour', ts) AS window_start
  FROM counter WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT event_type, window_start, count(*) AS samples,
       sum(CASE WHEN prev_ts >= window_start THEN CASE WHEN value >= prev THEN value - prev ELSE value END END)
         AS increase,
       sum(CASE WHEN prev_ts >= window_start THEN CASE WHEN value >= prev THEN value - prev ELSE value END END)
         / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1000000 AS rate
FROM steps GROUP BY event_type, window_start HAVING count(*) > 1""")
def counter_rates(t: Tables) -> DataFrame:
    rates = series.counter_rate(_counter(t), ["event_type"], 3600)
    return rates.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("W14", "", "quantile", """
WITH hist AS (
  SELECT event_type, unnest([5.0, 10.0, 25.0, 50.0, 100.0, 200.0, 'inf'::DOUBLE]) AS le, value FROM events),
buckets AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS c FROM hist GROUP BY ALL),
steps AS (
  SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(c) OVER w, 0) AS below,
         max(c) OVER (PARTITION BY event_type) AS total
  FROM buckets WINDOW w AS (PARTITION BY event_type ORDER BY le)),
hit AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS rn FROM steps WHERE c >= 0.9 * total)
SELECT event_type, CASE WHEN isinf(le) THEN low
                        ELSE low + (le - low) * (0.9 * total - below) / (c - below) END AS quantile
FROM hit WHERE rn = 1""")
def latency_quantiles(t: Tables) -> DataFrame:
    buckets = series.bucket_counts(t.base("events"), ["event_type"], "value", [5, 10, 25, 50, 100, 200])
    return series.histogram_quantile(buckets, ["event_type"], 0.9)


@query("W15 W2 N7", "", "value", """
SELECT event_type AS job, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""")
def latest_up_values(t: Tables) -> DataFrame:
    samples = t.base("events").select(
        "ts", "event_id", F.create_map(F.lit("job"), F.col("event_type")).alias("labels"), "value")
    keyed = samples.withColumn("job", series.label("job")).drop("labels")
    return series.latest_value(keyed, ["job"], ["ts", "event_id"]).select("job", "ts", "value")


@query("A8 F9", "readings", "", """
WITH s AS (SELECT DISTINCT sensor_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS m FROM readings),
w AS (SELECT m + k AS minute, count(DISTINCT sensor_id) AS n FROM s, range(0, 10) r(k) GROUP BY 1)
SELECT make_timestamp(minute * 60000000) AS minute_start, coalesce(n, 0) AS active
FROM (SELECT unnest(range((SELECT min(m) FROM s), (SELECT max(m) + 1 FROM s))) AS minute) LEFT JOIN w USING (minute)""")
def active_sensors_by_minute(t: Tables) -> DataFrame:
    """Distinct sensors of the last ten minutes, for every minute of the table."""
    found = sliding.active_keys(t.readings, "sensor_id")
    return found.withColumn("minute_start", F.col("minute_start").cast("timestamp_ntz"))


@query("A8", "readings", "", """
WITH s AS (SELECT DISTINCT sensor_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS m FROM readings),
w AS (SELECT m + k AS minute, count(DISTINCT sensor_id) AS n FROM s, range(0, 10) r(k) GROUP BY 1)
SELECT make_timestamp(minute * 60000000) AS minute_start, true AS within FROM w WHERE minute <= (SELECT max(m) FROM s)""")
def estimated_sensors_by_minute(t: Tables) -> DataFrame:
    """The same from sketches of single minutes, held against the exact counts: within five standard errors, or one."""
    exact = sliding.active_keys(t.readings, "sensor_id")
    guess = sliding.active_keys_estimate(sliding.minute_sketches(t.readings, "sensor_id"))
    both = guess.withColumnRenamed("active", "guess").join(exact, "minute_start")
    allowed = F.greatest(F.lit(1.0), F.col("active") * (5 * 1.04 / 64))
    return both.select(F.col("minute_start").cast("timestamp_ntz").alias("minute_start"),
                       (F.abs(F.col("guess") - F.col("active")) <= allowed).alias("within"))
