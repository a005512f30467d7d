"""Quality, drift, error metrics, training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregates, running, statistics as stats
from ..plans import quality
from ..session import cut_lineage
from .registry import query
from .views import Tables

_SUMMARY = ("lst_celsius", "ndvi", "impervious_pct", "rainfall_mm_24h", "heat_stress_score", "flood_risk_score")


@query("A11", "ward_features", "min mean max", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", min({c}) AS min, avg({c}) AS mean, max({c}) AS max FROM ward_features" for c in _SUMMARY))
def summary_stats(t: Tables) -> DataFrame:
    return aggregates.summary_stats(t.ward_features, list(_SUMMARY))


_BAD = {c: r for c, r in quality.RANGES.items()}


@query("A12", "ward_features", "", "SELECT count(*) AS row_count, "
       "count(*) FILTER (WHERE pm25_ugm3 IS NULL) AS null_pm25_ugm3, "
       "count(*) FILTER (WHERE ward_name IS NULL) AS null_ward_name, " + ", ".join(
           f"count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS bad_{c}" for c, (lo, hi) in _BAD.items())
       + " FROM ward_features")
def quality_counts(t: Tables) -> DataFrame:
    return quality.quality_counts(t.ward_features).select(
        "row_count", "null_pm25_ugm3", "null_ward_name", *[f"bad_{c}" for c in _BAD])


_STATS = [(c, s) for c in _SUMMARY for s in ("min", "mean", "max")]


@query("X8 A11 A12 A13 U6", "ward_features", " ".join([*quality.PAIRS, *(f"{c}_{s}" for c, s in _STATS)]), f"""
WITH f AS (SELECT * FROM ward_features),
v AS (SELECT unnest([{', '.join(f"'{c}'" for c in _BAD)}]) AS c,
      unnest([{', '.join(f"'[{lo}, {hi}]'" for lo, hi in _BAD.values())}]) AS bounds,
      unnest([{', '.join(f"(SELECT count(*) FROM f WHERE {c} < {lo} OR {c} > {hi})" for c, (lo, hi) in _BAD.items())}]) AS n),
i AS (SELECT 'Expected 198 wards, found ' || count(*) AS x FROM f HAVING count(*) <> 198
      UNION ALL SELECT 'ward_id contains duplicates' FROM f HAVING count(*) > count(DISTINCT ward_id)
      UNION ALL SELECT 'ward_id sequence is incomplete' FROM f
        HAVING count(DISTINCT ward_id) FILTER (WHERE ward_id BETWEEN 1 AND 198) < 198
      UNION ALL SELECT 'Null values in pm25_ugm3: ' || count(*) FROM f WHERE pm25_ugm3 IS NULL HAVING count(*) > 0
      UNION ALL SELECT c || ' has ' || n || ' value(s) outside ' || bounds FROM v WHERE n > 0)
SELECT 'fail' AS status, (SELECT count(*) FROM f) AS row_count, 13 AS column_count,
       'pm25_ugm3:' || (SELECT count(*) FROM f WHERE pm25_ugm3 IS NULL) AS nulls,
       (SELECT string_agg(c || ':' || n, ',' ORDER BY c) FROM v WHERE n > 0) AS violations,
       (SELECT string_agg(x, '|' ORDER BY x) FROM i) AS issues,
       {', '.join(f"(SELECT round(corr({a}, {b}), 4) FROM f) AS {n}" for n, (a, b) in quality.PAIRS.items())},
       {', '.join(f"(SELECT {'avg' if s == 'mean' else s}({c}) FROM f) AS {c}_{s}" for c, s in _STATS)}""")
def quality_report(t: Tables) -> DataFrame:
    """The nested report flattened to comparable columns."""
    report = quality.quality_report(t.ward_features, 198)

    def flat(column: str):
        return F.array_join(F.array_sort(F.transform(column, lambda x: F.concat(
            x["column"], F.lit(":"), x["n"].cast("string")))), ",")

    return report.select("status", "row_count", "column_count", flat("null_counts").alias("nulls"),
                         flat("range_violations").alias("violations"),
                         F.array_join(F.array_sort("issues"), "|").alias("issues"), "correlations.*",
                         *[F.col(f"summary_stats.{c}.{s}").alias(f"{c}_{s}") for c, s in _STATS])


@query("A13", "ward_features", "heat_vs_lst flood_vs_rain heat_vs_impervious", """
SELECT corr(heat_stress_score, lst_celsius) AS heat_vs_lst, corr(flood_risk_score, rainfall_mm_24h) AS flood_vs_rain,
       corr(heat_stress_score, impervious_pct) AS heat_vs_impervious FROM ward_features""")
def score_correlations(t: Tables) -> DataFrame:
    return stats.correlations(t.ward_features, quality.PAIRS)


@query("A12 X9", "", "", "SELECT count(*) AS duplicate_keys FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)")
def duplicate_keys(t: Tables) -> DataFrame:
    return quality.duplicate_keys(t.base("lineitem"), "l_orderkey")


def _drift_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Prices of returned items against accepted ones: as they are, and shifted by a fifth; quantities too."""
    rows = t.base("lineitem")

    def side(flag: str, shift: float) -> DataFrame:
        return rows.filter(F.col("l_returnflag") == flag).select(F.explode(F.array(
            F.struct(F.lit("price").alias("metric"), F.col("l_extendedprice").alias("value")),
            F.struct(F.lit("shifted_price").alias("metric"), (F.col("l_extendedprice") * shift).alias("value")),
            F.struct(F.lit("quantity").alias("metric"), F.col("l_quantity").alias("value")),
        )).alias("m")).select("m.*")

    return side("A", 1.0), side("N", 1.2)


_PSI = """
e AS (SELECT 'price' AS metric, l_extendedprice AS v FROM lineitem WHERE l_returnflag = 'A'
      UNION ALL SELECT 'shifted_price', l_extendedprice FROM lineitem WHERE l_returnflag = 'A'
      UNION ALL SELECT 'quantity', l_quantity FROM lineitem WHERE l_returnflag = 'A'),
a AS (SELECT 'price' AS metric, l_extendedprice AS v FROM lineitem WHERE l_returnflag = 'N'
      UNION ALL SELECT 'shifted_price', l_extendedprice * 1.2::DOUBLE FROM lineitem WHERE l_returnflag = 'N'
      UNION ALL SELECT 'quantity', l_quantity FROM lineitem WHERE l_returnflag = 'N'),
both_ AS (SELECT *, 0 AS side FROM e UNION ALL SELECT *, 1 FROM a),
r AS (SELECT metric, min(v) AS lo, (max(v) + 1e-6 - min(v)) / 10 AS w, count(*) FILTER (WHERE side = 0) AS n0,
             count(*) FILTER (WHERE side = 1) AS n1 FROM both_ GROUP BY metric),
b AS (SELECT metric, k, n0, n1, count(*) FILTER (WHERE side = 0) AS c0, count(*) FILTER (WHERE side = 1) AS c1
      FROM r JOIN both_ USING (metric), range(0, 10) t(k)
      WHERE v >= lo + k * w AND (v < lo + (k + 1) * w OR k = 9) GROUP BY ALL),
s AS (SELECT r.metric, greatest(coalesce(c0, 0) / (r.n0 + 1e-8), 1e-6) AS ep, greatest(coalesce(c1, 0) / (r.n1 + 1e-8), 1e-6) AS ap
      FROM r CROSS JOIN range(0, 10) t(k) LEFT JOIN b ON b.metric = r.metric AND b.k = t.k),
psi AS (SELECT metric, sum((ap - ep) * ln(ap / ep)) AS psi FROM s GROUP BY metric)"""


@query("A14 X7 T10", "", "psi", f"""
WITH {_PSI} SELECT metric, psi, CASE WHEN psi > 0.2 THEN 'CRITICAL' WHEN psi > 0.1 THEN 'WARN' ELSE 'OK' END AS level FROM psi""")
def drift_report(t: Tables) -> DataFrame:
    return quality.drift_report(*_drift_sides(t))


@query("X7", "", "", f"WITH {_PSI} SELECT max(psi) > 0.1 AS retrain FROM psi")
def retraining_gate(t: Tables) -> DataFrame:
    return quality.needs_retraining(quality.drift_report(*_drift_sides(t)))


@query("A25", "", "", f"""
WITH {_PSI} SELECT severity, count(*) AS alerts FROM (
  SELECT CASE WHEN psi > 0.2 THEN 'critical' WHEN psi > 0.1 THEN 'warning' END AS severity FROM psi)
WHERE severity IS NOT NULL GROUP BY severity""")
def drift_alert_counts(t: Tables) -> DataFrame:
    return aggregates.drift_alert_counts(quality.drift_report(*_drift_sides(t)))


@query("A15 P44", "predictions", "rmse mae r2 robust_loss", """
SELECT sqrt(avg((prediction - target) * (prediction - target))) AS rmse, avg(abs(prediction - target)) AS mae,
       1.0 - sum((prediction - target) * (prediction - target)) / (var_pop(target) * count(*) + 1e-8) AS r2,
       0.7 * avg((prediction - target) * (prediction - target)) + 0.3 * avg(abs(prediction - target)) AS robust_loss
FROM predictions""")
def regression_metrics(t: Tables) -> DataFrame:
    return stats.regression_metrics(t.predictions, "prediction", "target")


@query("A15 P44", "predictions", "dual_loss combined_rmse combined_mae", """
SELECT 0.6 * avg(pow(prediction - target, 2)) + 0.4 * avg(pow(flood_prediction - flood_target, 2)) AS dual_loss,
       0.6 * sqrt(avg(pow(prediction - target, 2))) + 0.4 * sqrt(avg(pow(flood_prediction - flood_target, 2))) AS combined_rmse,
       0.6 * avg(abs(prediction - target)) + 0.4 * avg(abs(flood_prediction - flood_target)) AS combined_mae
FROM predictions""")
def dual_loss(t: Tables) -> DataFrame:
    return stats.dual_loss(t.predictions, ("prediction", "target"), ("flood_prediction", "flood_target"))


@query("A16", "predictions", "value", """
WITH n AS (SELECT node, sqrt(avg((prediction - target) * (prediction - target))) AS rmse FROM predictions GROUP BY node)
SELECT unnest([0.1::DOUBLE, 0.5, 0.9]) AS p, unnest(quantile_cont(rmse, [0.1, 0.5, 0.9])) AS value FROM n""")
def node_error_percentiles(t: Tables) -> DataFrame:
    return stats.node_error_percentiles(t.predictions, "node", "prediction", "target")


@query("A16", "", "value", """
SELECT unnest([0.0::DOUBLE, 0.05, 0.5, 0.95, 1.0]) AS p,
       unnest(quantile_cont(l_extendedprice, [0.0, 0.05, 0.5, 0.95, 1.0])) AS value FROM lineitem""")
def exact_percentiles(t: Tables) -> DataFrame:
    return stats.exact_percentiles(t.base("lineitem"), "l_extendedprice", [0.0, 0.05, 0.5, 0.95, 1.0])


@query("A23", "pixels", "mean std min max", " UNION ALL ".join(
    f"SELECT '{b}' AS band, avg({b}) AS mean, stddev_pop({b}) AS std, min({b}) AS min, max({b}) AS max FROM pixels"
    for b in ("b2", "b3", "b4", "b5", "b6", "b7", "b10")))
def band_stats(t: Tables) -> DataFrame:
    return aggregates.band_stats(t.pixels, ["b2", "b3", "b4", "b5", "b6", "b7", "b10"])


@query("A26", "", "avg_reward", """
SELECT o_orderkey // 1000 * 1000 AS step_bucket, avg(o_totalprice / 1000) AS avg_reward, count(*) AS steps
FROM orders GROUP BY 1""")
def reward_by_steps(t: Tables) -> DataFrame:
    log = t.base("orders").withColumn("reward", F.col("o_totalprice") / 1000)
    return aggregates.training_log_by_steps(log, "o_orderkey", "reward", 1000)


@query("A26", "", "", """
SELECT l_suppkey, count(*) AS distinct_actions FROM (SELECT DISTINCT l_suppkey, l_linenumber, l_partkey FROM lineitem)
GROUP BY 1""")
def action_diversity(t: Tables) -> DataFrame:
    return aggregates.action_diversity(t.base("lineitem"), "l_suppkey", ["l_linenumber", "l_partkey"])


@query("A27", "", "mean_norm", """
SELECT avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS mean_norm, count(*) AS vectors
FROM embeddings""")
def mean_vector_norm(t: Tables) -> DataFrame:
    return aggregates.mean_norm(t.base("embeddings"), "embedding")


@query("A28", "", "l_quantity l_discount", """
SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER ()) / (stddev_pop(l_quantity) OVER () + 1e-8) AS l_quantity,
       (l_discount - avg(l_discount) OVER ()) / (stddev_pop(l_discount) OVER () + 1e-8) AS l_discount FROM lineitem""")
def scaled_features(t: Tables) -> DataFrame:
    rows = t.base("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return stats.standard_scale(rows, ["l_quantity", "l_discount"])


@query("A29 S7", "", "", """
SELECT l_suppkey AS scene_id, count(DISTINCT CASE WHEN l_linenumber = 7 AND l_suppkey % 3 = 0 THEN NULL ELSE l_linenumber END)
         AS band_count FROM lineitem GROUP BY 1 HAVING band_count = 7""")
def complete_scenes(t: Tables) -> DataFrame:
    """Line items as band samples; a third of the scenes lack the thermal band."""
    from ..sources.rasters import BANDS, complete_scenes

    band = F.get(F.array(*[F.lit(b) for b in BANDS]), F.col("l_linenumber") - 1)
    mislabelled = (F.col("l_linenumber") == 7) & (F.col("l_suppkey") % 3 == 0)
    samples = t.base("lineitem").select(
        F.col("l_suppkey").alias("scene_id"), F.when(mislabelled, "qa").otherwise(band).alias("band"))
    return complete_scenes(samples).withColumn("band_count", F.col("band_count").cast("bigint"))


@query("A29", "pixels", "", """
SELECT CAST(o_orderdate AS DATE) AS scene_date, count(DISTINCT o_custkey) AS wards, count(DISTINCT o_custkey) >= 5 AS complete
FROM orders GROUP BY 1""")
def ward_coverage(t: Tables) -> DataFrame:
    rows = t.base("orders").select(F.to_date("o_orderdate").alias("scene_date"), F.col("o_custkey").alias("ward_id"))
    return aggregates.ward_coverage(rows, 5)


@query("A20 X20", "feedback", "bias", """
WITH w AS (SELECT label, CASE WHEN floor((epoch_us(TIMESTAMP '2024-02-01 12:00:00') - epoch_us(flagged_at)) / 86400000000) < 3
                              THEN 2.0 ELSE 1.0 END AS weight FROM feedback)
SELECT least(greatest(coalesce(sum(weight) FILTER (WHERE label = 'real'), 0) * 0.01
                      - coalesce(sum(weight) FILTER (WHERE label = 'fake'), 0) * 0.03, -0.25), 0.15) AS bias,
       count(*) FILTER (WHERE label = 'fake') AS fake_count, count(*) FILTER (WHERE label = 'real') AS real_count
FROM w""")
def feedback_bias(t: Tables) -> DataFrame:
    return aggregates.feedback_bias(t.feedback, F.to_timestamp_ntz(F.lit("2024-02-01 12:00:00")))


def _episodes(t: Tables) -> DataFrame:
    """Orders of one priority are a run's episodes in key order."""
    key = F.col("o_orderkey")
    rows = t.base("orders").select(F.col("o_orderpriority").alias("run"), key.alias("step"),
                                   (F.col("o_totalprice") / 1000).alias("reward"), (key % 50).alias("length"))
    return running.ordinal(rows, ["run"], ["step"], F.floor(F.col("step") / 1000), "episode")


@query("W10", "", "reward_mean length_mean", """
SELECT run, episode, avg(reward) OVER w AS reward_mean, avg(length) OVER w AS length_mean FROM (
  SELECT o_orderpriority AS run, o_totalprice / 1000 AS reward, o_orderkey % 50 AS length,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS episode FROM orders)
WINDOW w AS (PARTITION BY run ORDER BY episode ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def rolling_rewards(t: Tables) -> DataFrame:
    return running.rolling_mean(_episodes(t), "run", "episode", ["reward", "length"], 20, 256).select(
        "run", "episode", "reward_mean", "length_mean")


@query("W11", "", "reward best", """
WITH e AS (SELECT o_custkey % 500 AS run, o_totalprice / 1000 AS reward,
                  row_number() OVER (PARTITION BY o_custkey % 500 ORDER BY o_orderkey) - 1 AS episode FROM orders),
b AS (SELECT *, min(reward) OVER (PARTITION BY run ORDER BY episode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM e),
i AS (SELECT *, before IS NULL OR reward < before AS improved FROM b),
s AS (SELECT *, episode - max(CASE WHEN improved THEN episode END) OVER (PARTITION BY run ORDER BY episode) AS streak FROM i),
x AS (SELECT *, min(CASE WHEN streak >= 10 THEN episode END) OVER (PARTITION BY run) AS stop_epoch FROM s)
SELECT run, episode, reward, improved, least(reward, before) AS best, streak, stop_epoch,
       stop_epoch IS NULL OR episode <= stop_epoch AS active FROM x""")
def early_stopping(t: Tables) -> DataFrame:
    rows = t.base("orders").select((F.col("o_custkey") % 500).alias("run"), F.col("o_orderkey").alias("step"),
                                   (F.col("o_totalprice") / 1000).alias("reward"))
    epochs = cut_lineage(running.ordinal(rows, ["run"], ["step"], F.floor(F.col("step") / 1000), "episode").drop("step"))
    return running.early_stop(epochs, "run", "episode", "reward", 10, block=16)
