"""Snapshot histories, samples, importances, the baseline regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import graph, history, nested
from ..plans import attribution, scoring, training
from ..session import cut_lineage
from .geography import EDGES
from .registry import query
from .views import WARDS, Tables

_INDEXED = """
indexed AS (SELECT *, dense_rank() OVER (ORDER BY snapshot_ts) - 1 AS snapshot_idx FROM snapshots)"""
# every (ward, snapshot) with the daily temperature and rain, gaps as zero
_DENSE = f"""
{_INDEXED},
grid AS (SELECT ward_id, s AS snapshot_idx FROM (SELECT DISTINCT ward_id FROM indexed), (SELECT DISTINCT snapshot_idx AS s FROM indexed)),
dense AS (SELECT g.ward_id, g.snapshot_idx, coalesce(lst_celsius, 0.0) AS lst_celsius, coalesce(rainfall_mm_24h, 0.0) AS rainfall_mm_24h
          FROM grid g LEFT JOIN indexed USING (ward_id, snapshot_idx))"""
_VALUES = ["lst_celsius", "rainfall_mm_24h"]


def _dense(t: Tables) -> DataFrame:
    return cut_lineage(history.densify(_indexed(t), _VALUES))


def _indexed(t: Tables) -> DataFrame:
    return cut_lineage(history.with_snapshot_index(t.snapshots))


@query("W4 U7", "snapshots", "lst_celsius", f"""
WITH {_INDEXED} SELECT ward_id, snapshot_ts, snapshot_idx, lst_celsius FROM indexed""")
def indexed_snapshots(t: Tables) -> DataFrame:
    return history.with_snapshot_index(t.snapshots).select("ward_id", "snapshot_ts", "snapshot_idx", "lst_celsius")


@query("W16 N2", "snapshots", "lst_celsius rainfall_mm_24h",
       f"WITH {_DENSE} SELECT ward_id, snapshot_idx, lst_celsius, rainfall_mm_24h FROM dense")
def dense_history(t: Tables) -> DataFrame:
    return _dense(t)


@query("W16", "snapshots", "lst_celsius rainfall_mm_24h", f"""
WITH {_DENSE}
SELECT g.ward_id, g.snapshot_idx, coalesce(last_value(i.lst_celsius IGNORE NULLS) OVER w, 0.0) AS lst_celsius,
       coalesce(last_value(i.rainfall_mm_24h IGNORE NULLS) OVER w, 0.0) AS rainfall_mm_24h
FROM grid g LEFT JOIN indexed i USING (ward_id, snapshot_idx)
WINDOW w AS (PARTITION BY g.ward_id ORDER BY g.snapshot_idx)""")
def filled_history(t: Tables) -> DataFrame:
    return history.densify(_indexed(t), _VALUES, "ffill")


@query("W5 N1", "snapshots", "temperature rain target", f"""
WITH {_DENSE}
SELECT ward_id, snapshot_idx, CAST(k AS INTEGER) AS step, temperature, rain, target FROM (
  SELECT t.ward_id, t.snapshot_idx, 8 - (t.snapshot_idx - p.snapshot_idx) AS k, p.lst_celsius AS temperature,
         p.rainfall_mm_24h AS rain, t.rainfall_mm_24h AS target
  FROM dense t JOIN dense p ON p.ward_id = t.ward_id AND p.snapshot_idx BETWEEN t.snapshot_idx - 8 AND t.snapshot_idx - 1
  WHERE t.snapshot_idx >= 8)""")
def sliding_samples(t: Tables) -> DataFrame:
    """Samples flattened to one row per step; small blocks so that the copied tails matter."""
    samples = history.sliding_samples(_dense(t), _VALUES, ["rainfall_mm_24h"], 8, block=10)
    steps = samples.select("ward_id", "snapshot_idx", F.posexplode("x_seq").alias("step", "x"),
                           F.col("rainfall_mm_24h").alias("target"))
    return steps.select("ward_id", "snapshot_idx", "step", F.col("x")[0].alias("temperature"), F.col("x")[1].alias("rain"),
                        "target")


@query("W6 N2", "snapshots", "temperature", f"""
WITH {_INDEXED}, l AS (SELECT max(snapshot_idx) AS last FROM indexed)
SELECT w.ward_id, CAST(k AS INTEGER) AS step, coalesce(i.lst_celsius, 0.0) AS temperature
FROM (SELECT DISTINCT ward_id FROM indexed) w CROSS JOIN range(0, 40) r(k) CROSS JOIN l
LEFT JOIN indexed i ON i.ward_id = w.ward_id AND i.snapshot_idx = last - 39 + k""")
def padded_history(t: Tables) -> DataFrame:
    """A window of 40 over 30 days: ten steps of left padding."""
    latest = history.padded_latest(_indexed(t), ["lst_celsius"], 40)
    return latest.select("ward_id", F.posexplode("x_seq").alias("step", "x")).select(
        "ward_id", "step", F.col("x")[0].alias("temperature"))


@query("W6", "ward_features", "x", """
SELECT ward_id, CAST(k AS INTEGER) AS step, heat_stress_score AS x FROM ward_features, range(0, 8) r(k)""")
def replicated_snapshot(t: Tables) -> DataFrame:
    seq = history.replicated_snapshot(t.ward_features, ["heat_stress_score"], 8)
    return seq.select("ward_id", F.posexplode("x_seq").alias("step", "v")).select("ward_id", "step", F.col("v")[0].alias("x"))


@query("W8", "snapshots", "", f"""
WITH {_DENSE}, s AS (SELECT ward_id, snapshot_idx FROM dense WHERE snapshot_idx >= 8),
b AS (SELECT count(DISTINCT snapshot_idx) AS n, max(snapshot_idx) AS last FROM s)
SELECT ward_id, snapshot_idx, CASE WHEN snapshot_idx > last - greatest(1, CAST(floor(n * 0.2) AS BIGINT)) THEN 'validation' ELSE 'train' END
  AS split FROM s, b""")
def chronological_split(t: Tables) -> DataFrame:
    samples = _dense(t).filter(F.col("snapshot_idx") >= 8).select("ward_id", "snapshot_idx")
    return history.chronological_split(samples)


@query("X12 P23 A28 W4 W5 W8", "snapshots", "mean_lst mean_rain mean_target", f"""
WITH {_INDEXED},
f AS (SELECT ward_id, snapshot_idx, (least(greatest(lst_celsius, 20.0), 50.0) - 20.0) / 30.00000001::DOUBLE AS lst_norm,
             ln(greatest(rainfall_mm_24h, 0.0) + 0.1) / 6.0 AS rainfall_log FROM indexed),
grid AS (SELECT ward_id, s AS snapshot_idx FROM (SELECT DISTINCT ward_id FROM indexed), (SELECT DISTINCT snapshot_idx AS s FROM indexed)),
d AS (SELECT g.ward_id, g.snapshot_idx, coalesce(lst_norm, 0.0) AS lst, coalesce(rainfall_log, 0.0) AS rain,
             coalesce(least(greatest(lst_norm * 100.0, 0.0), 100.0), 0.0) AS target FROM grid g LEFT JOIN f USING (ward_id, snapshot_idx)),
z AS (SELECT ward_id, snapshot_idx, (lst - avg(lst) OVER ()) / (stddev_pop(lst) OVER () + 1e-8) AS lst,
             (rain - avg(rain) OVER ()) / (stddev_pop(rain) OVER () + 1e-8) AS rain, target FROM d),
b AS (SELECT count(*) AS n, max(snapshot_idx) AS last FROM (SELECT DISTINCT snapshot_idx FROM d WHERE snapshot_idx >= 8))
SELECT t.ward_id, t.snapshot_idx,
       CASE WHEN t.snapshot_idx > any_value(last) - greatest(1, CAST(floor(any_value(n) * 0.2) AS BIGINT)) THEN 'validation'
            ELSE 'train' END AS split,
       avg(p.lst) AS mean_lst, avg(p.rain) AS mean_rain, any_value(t.target) AS mean_target
FROM z t JOIN z p ON p.ward_id = t.ward_id AND p.snapshot_idx BETWEEN t.snapshot_idx - 8 AND t.snapshot_idx - 1, b
WHERE t.snapshot_idx >= 8 GROUP BY t.ward_id, t.snapshot_idx""")
def training_windows(t: Tables) -> DataFrame:
    """Samples reduced to their window means of two features (surface temperature, rain)."""
    samples = training.training_windows(t.snapshots)
    lst, rain = history.FEATURES.index("lst_norm"), history.FEATURES.index("rainfall_log")

    def mean(i: int):
        return F.aggregate(F.transform("x_seq", lambda x: x[i]), F.lit(0.0), lambda s, x: s + x) / F.size("x_seq")

    return samples.select("ward_id", "snapshot_idx", "split", mean(lst).alias("mean_lst"), mean(rain).alias("mean_rain"),
                          F.col("heat_stress_score").alias("mean_target"))


_NAMES = [f"f{i:02d}" for i in range(32)]
_IMPORTANCE = """
imp AS (SELECT vec_id AS ward_id, i, 'f' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature,
               0.6 * abs(embedding[i + 1])::DOUBLE + 0.4 * abs(embedding[i + 33])::DOUBLE AS c
        FROM embeddings, range(0, 32) r(i))"""


def _importance(t: Tables) -> DataFrame:
    """The first half of an embedding as heat, the second as flood importance."""
    size = F.transform("embedding", lambda x: F.abs(x).cast("double"))
    return t.base("embeddings").select(
        F.col("vec_id").alias("ward_id"), F.slice(size, 1, 32).alias("heat_importance"),
        F.slice(size, 33, 32).alias("flood_importance"))


# The whole training set: every step of every sample with all twelve scaled features and both targets.
_FEATURE_SQL = {
    "ndvi": "ndvi", "ndbi": "ndbi", "impervious_norm": "(least(greatest(impervious_pct, 0.0), 100.0)) / (100.0 + 1e-8)",
    "lst_norm": "(least(greatest(lst_celsius, 20.0), 50.0) - 20.0) / (30.0 + 1e-8)",
    "rainfall_log": "ln(greatest(rainfall_mm_24h, 0.0) + 0.1) / 6.0", "pm25_log": "ln(greatest(pm25_ugm3, 0.0) + 0.1) / 6.0",
    "pop_log": "ln(greatest(population_density, 0.0) + 0.1) / 12.0", "area_norm": "CAST(0.5 AS DOUBLE)",
    "industrial_weight": "industrial_weight", "lon_norm": "CAST(0.5 AS DOUBLE)", "lat_norm": "CAST(0.5 AS DOUBLE)",
    "heat_proxy": "(least(greatest(lst_celsius, 20.0), 50.0) - 20.0) / (30.0 + 1e-8)",
}
_TARGET_SQL = {
    "heat_stress_score": "least(greatest(100.0 * (least(greatest(lst_celsius, 20.0), 50.0) - 20.0) / (30.0 + 1e-8), 0.0), 100.0)",
    "flood_risk_score": "least(greatest(30.0 * ln(greatest(rainfall_mm_24h, 0.0) + 0.1) / 6.0, 0.0), 100.0)",
}


@query("X12 P23 A28 W4 W5 W8", "snapshots", " ".join([*history.FEATURES, *history.TARGETS]), f"""
WITH {_INDEXED},
f AS (SELECT ward_id, snapshot_idx, {", ".join(f"{v} AS {k}" for k, v in (_FEATURE_SQL | _TARGET_SQL).items())} FROM indexed),
d AS (SELECT ward_id, snapshot_idx, {", ".join(f"coalesce({c}, 0.0) AS {c}" for c in (*_FEATURE_SQL, *_TARGET_SQL))}
  FROM (SELECT ward_id, s AS snapshot_idx FROM (SELECT DISTINCT ward_id FROM indexed), (SELECT DISTINCT snapshot_idx AS s FROM indexed))
  LEFT JOIN f USING (ward_id, snapshot_idx)),
m AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) + 1e-8 AS s_{c}" for c in _FEATURE_SQL)} FROM d),
z AS (SELECT ward_id, snapshot_idx, {", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in _FEATURE_SQL)}, {", ".join(_TARGET_SQL)} FROM d, m),
b AS (SELECT count(*) AS n, max(snapshot_idx) AS last FROM (SELECT DISTINCT snapshot_idx FROM d WHERE snapshot_idx >= 8))
SELECT t.ward_id, t.snapshot_idx, CAST(p.snapshot_idx - t.snapshot_idx + 8 AS INTEGER) AS step,
       CASE WHEN t.snapshot_idx > last - greatest(1, CAST(floor(n * 0.2) AS BIGINT)) THEN 'validation' ELSE 'train' END AS split,
       {", ".join(f"p.{c}" for c in _FEATURE_SQL)}, {", ".join(f"t.{c}" for c in _TARGET_SQL)}
FROM z t JOIN z p ON p.ward_id = t.ward_id AND p.snapshot_idx BETWEEN t.snapshot_idx - 8 AND t.snapshot_idx - 1, b
WHERE t.snapshot_idx >= 8""")
def training_steps(t: Tables) -> DataFrame:
    samples = training.training_windows(t.snapshots)
    steps = samples.select("ward_id", "snapshot_idx", "split", *history.TARGETS, F.posexplode("x_seq").alias("step", "x"))
    return steps.select("ward_id", "snapshot_idx", "step", "split", *history.TARGETS, *[
        F.col("x")[k].alias(name) for k, name in enumerate(history.FEATURES)])


@query("W7 X22 N5", "", "importance", f"""
WITH {_IMPORTANCE}
SELECT ward_id, CAST(rn - 1 AS INTEGER) AS rank, feature, share AS importance FROM (
  SELECT *, c / (sum(c) OVER (PARTITION BY ward_id) + 1e-12) AS share,
         row_number() OVER (PARTITION BY ward_id ORDER BY c DESC, i) AS rn FROM imp) WHERE rn <= 4""")
def top_features(t: Tables) -> DataFrame:
    top = history.top_features(_importance(t), _NAMES)
    return top.select("ward_id", F.posexplode("top_contributing_features").alias("rank", "f")).select(
        "ward_id", "rank", "f.feature", "f.importance")


@query("A22 X22", "", "importance", f"""
WITH {_IMPORTANCE} SELECT feature, sum(c) / ((SELECT sum(c) FROM imp) + 1e-12) AS importance FROM imp GROUP BY feature""")
def global_importance(t: Tables) -> DataFrame:
    return history.global_importance(_importance(t), _NAMES)


@query("X22 N5 W7", "scores", "heat_stress importance", f"""
WITH {_IMPORTANCE}
SELECT s.ward_id, heat_stress_score AS heat_stress, feature, share AS importance FROM (
  SELECT *, c / (sum(c) OVER (PARTITION BY ward_id) + 1e-12) AS share,
         row_number() OVER (PARTITION BY ward_id ORDER BY c DESC, i) AS rn FROM imp) i JOIN scores s USING (ward_id) WHERE rn = 1""")
def main_feature_of_wards(t: Tables) -> DataFrame:
    report = attribution.ward_report(t.scores, _importance(t), _NAMES, 1)
    top = F.get("top_contributing_features", F.lit(0))
    return report.select("ward_id", "heat_stress", top["feature"].alias("feature"), top["importance"].alias("importance"))


@query("X22 N5 W7", "scores", "heat_stress flood_risk importance", f"""
WITH {_IMPORTANCE}
SELECT s.ward_id, heat_stress_score AS heat_stress, flood_risk_score AS flood_risk, CAST(rn - 1 AS INTEGER) AS rank, feature,
       share AS importance FROM (
  SELECT *, c / (sum(c) OVER (PARTITION BY ward_id) + 1e-12) AS share,
         row_number() OVER (PARTITION BY ward_id ORDER BY c DESC, i) AS rn FROM imp) i JOIN scores s USING (ward_id) WHERE rn <= 4""")
def main_features_of_wards(t: Tables) -> DataFrame:
    """The report's four main features of every ward."""
    report = attribution.ward_report(t.scores, _importance(t), _NAMES)
    return report.select(
        "ward_id", "heat_stress", "flood_risk", F.posexplode("top_contributing_features").alias("rank", "f")).select(
        "ward_id", "heat_stress", "flood_risk", "rank", "f.feature", "f.importance")


@query("N6", "", "value", "SELECT vec_id, i AS pos, CAST(embedding[i + 1] AS DOUBLE) * 2 AS value FROM embeddings, range(0, 64) r(i)")
def reassembled_vectors(t: Tables) -> DataFrame:
    cells = nested.explode_vector(t.base("embeddings"), "vec_id", "embedding")
    doubled = cells.withColumn("value", F.col("value").cast("double") * 2)
    back = nested.assemble_vector(doubled, "vec_id")
    return back.select("vec_id", F.posexplode("vector").alias("pos", "value")).withColumn("pos", F.col("pos").cast("bigint"))


@query("N2", "snapshots", "w1 w2 w3", f"""
WITH {_INDEXED} SELECT snapshot_idx, max(lst_celsius) FILTER (WHERE ward_id = 1) AS w1,
  max(lst_celsius) FILTER (WHERE ward_id = 2) AS w2, max(lst_celsius) FILTER (WHERE ward_id = 3) AS w3
FROM indexed WHERE ward_id IN (1, 2, 3) GROUP BY snapshot_idx""")
def wide_snapshots(t: Tables) -> DataFrame:
    wide = nested.wide_snapshot(history.with_snapshot_index(t.snapshots), "snapshot_idx", [1, 2, 3], "lst_celsius")
    return wide.select("snapshot_idx", *[F.col(str(i)).alias(f"w{i}") for i in (1, 2, 3)])


_EVERY_WARD = range(1, WARDS + 1)


@query("N2", "snapshots", " ".join(f"w{i}" for i in _EVERY_WARD), f"""
WITH {_INDEXED} SELECT snapshot_idx, {", ".join(f"max(lst_celsius) FILTER (WHERE ward_id = {i}) AS w{i}" for i in _EVERY_WARD)}
FROM indexed GROUP BY snapshot_idx""")
def wide_city_snapshots(t: Tables) -> DataFrame:
    """One row per snapshot with a column for every ward of the city."""
    wide = nested.wide_snapshot(history.with_snapshot_index(t.snapshots), "snapshot_idx", list(_EVERY_WARD), "lst_celsius")
    return wide.select("snapshot_idx", *[F.col(str(i)).alias(f"w{i}") for i in _EVERY_WARD])


@query("N1", "readings", "temperature_c", "SELECT event_id, sensor_id, ts, temperature_c FROM readings")
def record_round_trip(t: Tables) -> DataFrame:
    rows = t.readings.select("event_id", "sensor_id", "ts", "temperature_c")
    return nested.from_record(nested.to_record(rows),
                              "event_id BIGINT, sensor_id STRING, ts TIMESTAMP_NTZ, temperature_c DOUBLE")


@query("D3 D1", "ward_features", "score", """
SELECT ward_id, 0.5 * lst_celsius + 0.3 * impervious_pct - 20.0 * ndvi + 1.5 AS score FROM ward_features""")
def scored_wards(t: Tables) -> DataFrame:
    load = scoring.linear_scorer(["lst_celsius", "impervious_pct", "ndvi"], [0.5, 0.3, -20.0], 1.5)
    inputs = t.ward_features.select("ward_id", "lst_celsius", "impervious_pct", "ndvi")
    return scoring.score(inputs, load, "ward_id BIGINT, score DOUBLE")


@query("X24", "snapshots", "lag_lst_celsius target", f"""
WITH {_DENSE} SELECT t.ward_id, t.snapshot_idx, p.lst_celsius AS lag_lst_celsius, t.lst_celsius AS target
FROM dense t JOIN dense p ON p.ward_id = t.ward_id AND p.snapshot_idx = t.snapshot_idx - 1""")
def lagged_features(t: Tables) -> DataFrame:
    rows = training.lag_features(_dense(t), ["lst_celsius"], ["lst_celsius"])
    return rows.select("ward_id", "snapshot_idx", "lag_lst_celsius", F.col("lst_celsius").alias("target"))


@query("X24 A15 W8", "snapshots", "", f"""
WITH {_DENSE}, r AS (SELECT t.snapshot_idx, p.lst_celsius AS x, t.lst_celsius AS y FROM dense t
  JOIN dense p ON p.ward_id = t.ward_id AND p.snapshot_idx = t.snapshot_idx - 1),
b AS (SELECT max(snapshot_idx) - greatest(1, CAST(floor(count(DISTINCT snapshot_idx) * 0.2) AS BIGINT)) AS cut FROM r),
m AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM r, b WHERE snapshot_idx <= cut)
SELECT CASE WHEN snapshot_idx > cut THEN 'validation' ELSE 'train' END AS split,
       CAST(floor(sqrt(avg(pow(i + s * x - y, 2))) * 1000 + 0.497) AS BIGINT) AS rmse_milli,
       CAST(floor(avg(abs(i + s * x - y)) * 1000 + 0.497) AS BIGINT) AS mae_milli
FROM r, b, m GROUP BY 1""")
def baseline_regression(t: Tables) -> DataFrame:
    """Least squares of a day's temperature on the day before; errors in thousandths."""
    rows = training.lag_features(_dense(t), ["lst_celsius"], ["lst_celsius"])
    samples = history.chronological_split(rows)
    model = training.fit_baseline(samples, ["lag_lst_celsius"], "lst_celsius")
    metrics = training.evaluate_baseline(model, samples, "lst_celsius")
    return metrics.select("split", *[F.floor(F.col(c) * 1000 + 0.497).alias(f"{c}_milli") for c in ("rmse", "mae")])


# Normal equations of both targets by Gauss-Jordan steps over lists; covariances, so the intercepts follow from the means.
_INPUTS = [f"{side}{lag}_{v}" for lag in (1, 2) for side in ("own", "near") for v in ("heat_stress_score", "flood_risk_score", "pm25_log")]
_REGRESSION = f"""
{_INDEXED}, city AS (SELECT * FROM wards WHERE ward_id <= {WARDS}), {EDGES.replace("wards", "city")},
scored AS (SELECT ward_id, snapshot_idx, pm, 100.0 * (least(greatest(lst_celsius, 20.0), 50.0) - 20.0) / (30.0 + 1e-8) AS h,
    least(greatest(30.0 * ln(greatest(rainfall_mm_24h, 0.0) + 0.1) / 6.0, 0.0), 100.0) AS f
  FROM (SELECT *, ln(greatest(pm25_ugm3, 0.0) + 0.1) / 6.0 AS pm FROM indexed)),
full_grid AS (SELECT ward_id, snapshot_idx, coalesce(h, 0.0) AS h, coalesce(f, 0.0) AS f, coalesce(pm, 0.0) AS pm
  FROM (SELECT ward_id, s AS snapshot_idx FROM (SELECT DISTINCT ward_id FROM indexed), (SELECT DISTINCT snapshot_idx AS s FROM indexed))
  LEFT JOIN scored USING (ward_id, snapshot_idx)),
around AS (SELECT dst AS ward_id, snapshot_idx, sum(weight * h) / count(*) AS nh, sum(weight * f) / count(*) AS nf,
    sum(weight * pm) / count(*) AS np FROM graph JOIN full_grid ON ward_id = src GROUP BY ALL),
state AS (SELECT g.*, coalesce(nh, 0.0) AS nh, coalesce(nf, 0.0) AS nf, coalesce(np, 0.0) AS np
  FROM full_grid g LEFT JOIN around USING (ward_id, snapshot_idx)),
design AS (SELECT t.snapshot_idx, [a.h, a.f, a.pm, a.nh, a.nf, a.np, b.h, b.f, b.pm, b.nh, b.nf, b.np, t.h, t.f] AS z
  FROM state t JOIN state a ON a.ward_id = t.ward_id AND a.snapshot_idx = t.snapshot_idx - 1
  JOIN state b ON b.ward_id = t.ward_id AND b.snapshot_idx = t.snapshot_idx - 2),
cut AS (SELECT max(snapshot_idx) - greatest(1, CAST(floor(count(DISTINCT snapshot_idx) * 0.2) AS BIGINT)) AS c FROM design),
samples AS (SELECT z, CASE WHEN snapshot_idx > c THEN 'validation' ELSE 'train' END AS split FROM design, cut),
fitted AS (SELECT z FROM samples WHERE split = 'train'),
means AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(z[i]) AS m FROM fitted, range(1, 15) r(i) GROUP BY i)),
cells AS (SELECT i, j, covar_pop(z[i], z[j]) AS v FROM fitted, range(1, 13) r(i), range(1, 15) q(j) GROUP BY i, j),
matrix AS (SELECT list(w ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS w FROM cells GROUP BY i)),
steps AS (SELECT 1 AS k, m FROM matrix UNION ALL
  SELECT k + 1, list_transform(range(1, 13), lambda i: list_transform(range(1, 15), lambda j:
    CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] / m[k][k] * m[k][j] END)) FROM steps WHERE k <= 12),
solved AS (SELECT m FROM steps WHERE k = 13),
weights AS (SELECT t, i, s.m[i][12 + t] AS w FROM solved s, range(1, 13) r(i), range(1, 3) q(t)),
offsets AS (SELECT t, any_value(means.m)[12 + t] - sum(w * means.m[i]) AS w FROM weights, means GROUP BY t),
terms AS (SELECT t, i, w FROM weights UNION ALL SELECT t, 0, w FROM offsets)"""
_TARGET = "CASE t WHEN 1 THEN 'heat_stress_score' ELSE 'flood_risk_score' END AS target"


def _regression(t: Tables) -> tuple[DataFrame, DataFrame]:
    values = [*history.TARGETS, "pm25_log"]
    scored = history.normalise_snapshot(_indexed(t))
    dense = cut_lineage(history.densify(scored, values))
    edges = graph.ward_graph(t.nodes.filter(F.col("ward_id") <= WARDS))
    return training.risk_regression(dense, edges, values)


@query("X24 X11 J17", "snapshots wards", "value", f"""
WITH RECURSIVE {_REGRESSION}
SELECT {_TARGET}, ['intercept', {", ".join(f"'{n}'" for n in _INPUTS)}][i + 1] AS term, w AS value FROM terms""")
def risk_coefficients(t: Tables) -> DataFrame:
    """Heat and flood risk from the wards' and their neighbours' last two days."""
    return _regression(t)[0]


@query("X24 A15 W8 J17", "snapshots wards", "rmse mae r2", f"""
WITH RECURSIVE {_REGRESSION},
model AS (SELECT t, list(w ORDER BY i) AS w FROM terms GROUP BY t),
errors AS (SELECT split, t, z[12 + t] AS y, w[1] + list_sum(list_transform(range(1, 13), lambda i: w[i + 1] * z[i])) - z[12 + t] AS e
  FROM samples, model)
SELECT split, {_TARGET}, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae,
       1.0 - sum(e * e) / (var_pop(y) * count(*) + 1e-8) AS r2 FROM errors GROUP BY split, t""")
def risk_regression_errors(t: Tables) -> DataFrame:
    return training.regression_report(_regression(t)[1])
