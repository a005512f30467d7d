"""The domain tables as deterministic views over the test tables, once in Spark and once in SQL."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.risk import combined_risk, risk_level

SITE_COLUMNS = 128
WARDS = 198


@dataclass(frozen=True)
class View:
    sql: str
    needs: tuple[str, ...] = field(default=())


def sensor_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


class Tables:
    """Lazy access to the test tables and the derived views."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def readings(self) -> DataFrame:
        user = F.col("user_id").cast("string")
        return self.base("events").select(
            (F.col("user_id") % WARDS + 1).alias("ward_id"),
            F.concat(F.lit("SENSOR-"), F.lpad(user, 10, "0")).alias("sensor_id"),
            "ts", "event_id",
            (F.lit(20.0) + F.col("value") * 0.2).alias("temperature_c"),
            (F.lit(30) + F.col("event_id") % 70).cast("double").alias("humidity_pct"),
            F.col("value").alias("pm25"),
            (sensor_k() * 0.25).alias("rainfall_mm"),
        )

    @cached_property
    def wards(self) -> DataFrame:
        """Constant density: a grid of fixed pitch with a small offset per ward, so distances rarely tie."""
        key = F.col("c_custkey")
        jitter = F.pmod((F.col("c_acctbal") * 100).cast("bigint"), F.lit(1000)).cast("double")
        lon = F.lit(77.35) + (key % SITE_COLUMNS) * 0.02 + jitter / 100000.0
        lat = F.lit(12.77) + F.floor(key / SITE_COLUMNS) * 0.02 + (F.pmod(key * 7919, F.lit(1000))) / 100000.0
        return self.base("customer").select(
            (key + 1).alias("ward_id"), F.col("c_name").alias("ward_name"),
            lon.alias("centroid_lon"), lat.alias("centroid_lat"),
        )

    @property
    def nodes(self) -> DataFrame:
        return self.wards.select("ward_id", F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat"))

    @cached_property
    def scores(self) -> DataFrame:
        key = F.col("c_custkey")
        heat = F.least(F.greatest((F.col("c_acctbal") + 1000) / 110.0, F.lit(0.0)), F.lit(100.0))
        flood = (key * 37 % 101).cast("double")
        day = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
        stamp = day + F.make_dt_interval(F.lit(0), (key % 24).cast("int"))
        return self.base("customer").select(
            (key + 1).alias("ward_id"), heat.alias("heat_stress_score"), flood.alias("flood_risk_score"),
            risk_level(combined_risk(heat, flood)).alias("risk_level"),
            (F.lit(25.0) + key % 20).cast("double").alias("lst_pred_celsius"),
            (key % 75 / 100.0).alias("ndvi"), (F.lit(40) + key % 59).cast("double").alias("impervious_pct"),
            stamp.alias("updated_at"), stamp.alias("created_at"),
        )

    @property
    def risks(self) -> DataFrame:
        """Scores with names."""
        return self.scores.join(self.wards.select("ward_id", "ward_name"), "ward_id")

    @cached_property
    def weather(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.base("orders").select(
            key.alias("id"), (F.col("o_custkey") + 1).alias("ward_id"), F.col("o_orderdate").alias("ts"),
            (F.lit(20) + key % 25).cast("double").alias("temperature_2m"),
            (F.lit(30) + key % 70).cast("double").alias("humidity_pct"),
            (key % 30).cast("double").alias("precipitation_mm"),
        )

    @cached_property
    def reports(self) -> DataFrame:
        key = F.col("event_id")
        return self.base("events").select(
            key.alias("id"), (F.col("user_id") % WARDS + 1).alias("ward_id"),
            F.col("event_type").alias("report_type"), (key % 5 + 1).cast("int").alias("severity"),
            F.col("ts").alias("reported_at"),
            (F.lit(12.7) + key % 100 * 0.005).alias("latitude"), (F.lit(77.3) + key % 120 * 0.005).alias("longitude"),
            F.when(key % 11 == 0, F.col("props")).alias("description"), F.lit(None).cast("string").alias("image_url"),
        )

    @cached_property
    def pixels(self) -> DataFrame:
        def dn(value: Column) -> Column:
            return value.cast("int")

        qty, line, supp = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_suppkey")
        return self.base("lineitem").select(
            F.col("l_returnflag").alias("scene_id"), dn(F.col("l_orderkey") % 256).alias("row"),
            dn(F.col("l_partkey") % 256).alias("col"),
            dn(7000 + line * 300).alias("b2"), dn(7200 + qty * 40).alias("b3"), dn(7500 + supp % 90 * 50).alias("b4"),
            dn(8000 + qty * 200).alias("b5"), dn(7800 + line * 900).alias("b6"), dn(7600 + line * 500).alias("b7"),
            dn(40000 + qty * 100).alias("b10"),
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """Daily per-ward averages of the readings, with the columns of a feature history."""
        daily = self.readings.groupBy("ward_id", F.to_date("ts").alias("snapshot_ts")).agg(
            F.avg("temperature_c").alias("lst_celsius"), F.sum("rainfall_mm").alias("rainfall_mm_24h"),
            F.avg("pm25").alias("pm25_ugm3"), F.avg("humidity_pct").alias("impervious_pct"),
        )
        ward = F.col("ward_id")
        return daily.select(
            "*", (ward % 60 / 100.0).alias("ndvi"), (ward % 40 / 100.0 - 0.2).alias("ndbi"),
            (F.lit(2000.0) + ward * 100).alias("population_density"), (ward % 10 / 10.0).alias("industrial_weight"),
        )

    @property
    def feedback(self) -> DataFrame:
        day = F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))
        return self.base("labels").select(
            F.col("doc_id").alias("report_id"), F.when(F.col("quality") == 1, "real").otherwise("fake").alias("label"),
            (day - F.make_dt_interval((F.col("doc_id") % 10).cast("int"))).alias("flagged_at"),
        )

    @property
    def runs(self) -> DataFrame:
        return self.base("orders").select(
            F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
            F.col("o_orderpriority").alias("experiment"),
            F.concat(F.when(F.col("o_orderkey") % 2 == 0, "st_gnn_").otherwise("ppo_"),
                     F.col("o_orderkey").cast("string")).alias("run_name"),
            F.when(F.col("o_orderstatus") == "F", "FINISHED").otherwise("RUNNING").alias("status"),
            F.when(F.col("o_orderkey") % 3 == 0, "val_heat_rmse").otherwise("ep_reward_mean").alias("metric_name"),
            F.col("o_totalprice").alias("metric_value"), F.col("o_orderdate").alias("logged_at"),
        )

    @property
    def predictions(self) -> DataFrame:
        return self.base("lineitem").select(
            F.col("l_suppkey").alias("node"), F.col("l_quantity").alias("prediction"),
            (F.col("l_quantity") * (F.lit(1.0) + F.col("l_discount"))).alias("target"),
            F.col("l_extendedprice").alias("flood_prediction"),
            (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_tax"))).alias("flood_target"),
        )

    @property
    def interventions(self) -> DataFrame:
        key = F.col("o_orderkey")
        types = F.array(*[F.lit(t) for t in ("tree_planting", "green_roof", "permeable_pavement", "urban_wetland",
                                             "cool_pavement")])
        return self.base("orders").select(
            key.alias("id"), (F.col("o_custkey") + 1).alias("ward_id"),
            F.get(types, (key % 5).cast("int")).alias("intervention_type"), (key % 6 + 1).cast("int").alias("cost"),
            (key % 11).cast("double").alias("expected_heat_reduction"),
            (key % 26).cast("double").alias("expected_flood_reduction"), F.col("o_orderdate").alias("created_at"),
        )

    @property
    def ward_features(self) -> DataFrame:
        """The daily ward snapshot: scores plus static features."""
        key = F.col("ward_id") - 1
        joined = self.scores.join(self.wards, "ward_id")
        return joined.select(
            "ward_id", "ward_name", "centroid_lon", "centroid_lat", F.col("lst_pred_celsius").alias("lst_celsius"),
            "ndvi", "impervious_pct", (key % 70).cast("double").alias("rainfall_mm_24h"),
            F.when(key % 97 != 0, (key % 600).cast("double")).alias("pm25_ugm3"),
            (F.lit(1000.0) + key % 500 * 10).alias("population_density"), "heat_stress_score", "flood_risk_score",
            (key % 10 / 10.0).alias("industrial_weight"),
        )


_LEVEL = (
    "CASE WHEN 0.6 * {h} + 0.4 * {f} >= 75 THEN 'critical' WHEN 0.6 * {h} + 0.4 * {f} >= 50 THEN 'high' "
    "WHEN 0.6 * {h} + 0.4 * {f} >= 25 THEN 'medium' ELSE 'low' END"
)


def level_sql(heat: str, flood: str) -> str:
    return _LEVEL.format(h=heat, f=flood)


VIEWS: dict[str, View] = {
    "readings": View("""
        SELECT user_id % 198 + 1 AS ward_id,
               'SENSOR-' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS sensor_id, ts, event_id,
               20.0 + value * 0.2 AS temperature_c, CAST(30 + event_id % 70 AS DOUBLE) AS humidity_pct, value AS pm25,
               CAST(json_extract_string(props, '$.k') AS INTEGER) * CAST(0.25 AS DOUBLE) AS rainfall_mm
        FROM events"""),
    "wards": View("""
        SELECT c_custkey + 1 AS ward_id, c_name AS ward_name,
               77.35 + (c_custkey % 128) * CAST(0.02 AS DOUBLE)
                 + CAST(((CAST(trunc(c_acctbal * 100) AS BIGINT) % 1000) + 1000) % 1000 AS DOUBLE) / 100000.0
                 AS centroid_lon,
               12.77 + (c_custkey // 128) * CAST(0.02 AS DOUBLE)
                 + CAST(c_custkey * 7919 % 1000 AS DOUBLE) / 100000.0 AS centroid_lat
        FROM customer"""),
    "scores": View(f"""
        SELECT ward_id, heat_stress_score, flood_risk_score, {level_sql('heat_stress_score', 'flood_risk_score')}
                 AS risk_level, lst_pred_celsius, ndvi, impervious_pct, updated_at, updated_at AS created_at
        FROM (SELECT c_custkey + 1 AS ward_id,
                     least(greatest((c_acctbal + 1000) / 110.0, 0.0), 100.0) AS heat_stress_score,
                     CAST(c_custkey * 37 % 101 AS DOUBLE) AS flood_risk_score,
                     CAST(25 + c_custkey % 20 AS DOUBLE) AS lst_pred_celsius,
                     CAST(c_custkey % 75 AS DOUBLE) / 100.0 AS ndvi,
                     CAST(40 + c_custkey % 59 AS DOUBLE) AS impervious_pct,
                     TIMESTAMP '2024-01-01 00:00:00' + to_hours(c_custkey % 24) AS updated_at
              FROM customer)"""),
    "risks": View("SELECT s.*, w.ward_name FROM scores s JOIN wards w USING (ward_id)", ("scores", "wards")),
    "weather": View("""
        SELECT o_orderkey AS id, o_custkey + 1 AS ward_id, o_orderdate AS ts,
               CAST(20 + o_orderkey % 25 AS DOUBLE) AS temperature_2m,
               CAST(30 + o_orderkey % 70 AS DOUBLE) AS humidity_pct,
               CAST(o_orderkey % 30 AS DOUBLE) AS precipitation_mm
        FROM orders"""),
    "reports": View("""
        SELECT event_id AS id, user_id % 198 + 1 AS ward_id, event_type AS report_type,
               CAST(event_id % 5 + 1 AS INTEGER) AS severity, ts AS reported_at,
               12.7 + (event_id % 100) * CAST(0.005 AS DOUBLE) AS latitude,
               77.3 + (event_id % 120) * CAST(0.005 AS DOUBLE) AS longitude,
               CASE WHEN event_id % 11 = 0 THEN props END AS description
        FROM events"""),
    "pixels": View("""
        SELECT l_returnflag AS scene_id, CAST(l_orderkey % 256 AS INTEGER) AS "row",
               CAST(l_partkey % 256 AS INTEGER) AS col,
               CAST(7000 + l_linenumber * 300 AS INTEGER) AS b2, CAST(7200 + l_quantity * 40 AS INTEGER) AS b3,
               CAST(7500 + l_suppkey % 90 * 50 AS INTEGER) AS b4, CAST(8000 + l_quantity * 200 AS INTEGER) AS b5,
               CAST(7800 + l_linenumber * 900 AS INTEGER) AS b6, CAST(7600 + l_linenumber * 500 AS INTEGER) AS b7,
               CAST(40000 + l_quantity * 100 AS INTEGER) AS b10
        FROM lineitem"""),
    "snapshots": View("""
        SELECT *, CAST(ward_id % 60 AS DOUBLE) / 100.0 AS ndvi, CAST(ward_id % 40 AS DOUBLE) / 100.0 - 0.2 AS ndbi,
               2000.0 + ward_id * CAST(100 AS DOUBLE) AS population_density,
               CAST(ward_id % 10 AS DOUBLE) / 10.0 AS industrial_weight
        FROM (SELECT ward_id, CAST(ts AS DATE) AS snapshot_ts, avg(temperature_c) AS lst_celsius,
                     sum(rainfall_mm) AS rainfall_mm_24h, avg(pm25) AS pm25_ugm3, avg(humidity_pct) AS impervious_pct
              FROM readings GROUP BY ward_id, CAST(ts AS DATE))""", ("readings",)),
    "feedback": View("""
        SELECT doc_id AS report_id, CASE WHEN quality = 1 THEN 'real' ELSE 'fake' END AS label,
               TIMESTAMP '2024-02-01 00:00:00' - to_days(CAST(doc_id % 10 AS INTEGER)) AS flagged_at
        FROM labels"""),
    "runs": View("""
        SELECT 'run-' || o_orderkey AS run_id, o_orderpriority AS experiment,
               (CASE WHEN o_orderkey % 2 = 0 THEN 'st_gnn_' ELSE 'ppo_' END) || o_orderkey AS run_name,
               CASE WHEN o_orderstatus = 'F' THEN 'FINISHED' ELSE 'RUNNING' END AS status,
               CASE WHEN o_orderkey % 3 = 0 THEN 'val_heat_rmse' ELSE 'ep_reward_mean' END AS metric_name,
               o_totalprice AS metric_value, o_orderdate AS logged_at
        FROM orders"""),
    "predictions": View("""
        SELECT l_suppkey AS node, l_quantity AS prediction, l_quantity * (1.0 + l_discount) AS target,
               l_extendedprice AS flood_prediction, l_extendedprice * (1.0 - l_tax) AS flood_target
        FROM lineitem"""),
    "interventions": View("""
        SELECT o_orderkey AS id, o_custkey + 1 AS ward_id,
               ['tree_planting', 'green_roof', 'permeable_pavement', 'urban_wetland', 'cool_pavement']
                 [CAST(o_orderkey % 5 + 1 AS INTEGER)] AS intervention_type,
               CAST(o_orderkey % 6 + 1 AS INTEGER) AS cost,
               CAST(o_orderkey % 11 AS DOUBLE) AS expected_heat_reduction,
               CAST(o_orderkey % 26 AS DOUBLE) AS expected_flood_reduction, o_orderdate AS created_at
        FROM orders"""),
    "ward_features": View("""
        SELECT ward_id, ward_name, centroid_lon, centroid_lat, lst_pred_celsius AS lst_celsius, ndvi, impervious_pct,
               CAST((ward_id - 1) % 70 AS DOUBLE) AS rainfall_mm_24h,
               CASE WHEN (ward_id - 1) % 97 != 0 THEN CAST((ward_id - 1) % 600 AS DOUBLE) END AS pm25_ugm3,
               1000.0 + CAST((ward_id - 1) % 500 * 10 AS DOUBLE) AS population_density, heat_stress_score,
               flood_risk_score, CAST((ward_id - 1) % 10 AS DOUBLE) / 10.0 AS industrial_weight
        FROM scores JOIN wards USING (ward_id)""", ("scores", "wards")),
}
