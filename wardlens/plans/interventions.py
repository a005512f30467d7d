"""Intervention catalogue, recommendations, what-if scenarios and the ROI map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geo, risk
from ..functions.numeric import clip
from ..operators.aggregates import city_score
from ..operators.joins import expand_literals, first_per_key
from ..operators.nested import point_geometry
from ..operators.ranking import greedy_recommendations, ranked_top

# The five interventions and their effects.
CATALOGUE = (
    {"intervention_type": "tree_planting", "cost": 2, "ndvi_delta": 0.08, "impervious_delta": 0.0, "lst_delta": -1.5,
     "heat_delta": -6.0, "flood_delta": 0.0},
    {"intervention_type": "green_roof", "cost": 3, "ndvi_delta": 0.04, "impervious_delta": -5.0, "lst_delta": -0.8,
     "heat_delta": -4.0, "flood_delta": 0.0},
    {"intervention_type": "permeable_pavement", "cost": 4, "ndvi_delta": 0.0, "impervious_delta": -12.0,
     "lst_delta": 0.0, "heat_delta": 0.0, "flood_delta": -15.0},
    {"intervention_type": "urban_wetland", "cost": 6, "ndvi_delta": 0.05, "impervious_delta": 0.0, "lst_delta": 0.0,
     "heat_delta": -3.0, "flood_delta": -25.0},
    {"intervention_type": "cool_pavement", "cost": 2, "ndvi_delta": 0.0, "impervious_delta": 0.0, "lst_delta": -1.0,
     "heat_delta": -8.0, "flood_delta": 0.0},
)
TYPES = {
    "intervention_type": "string", "cost": "int", "ndvi_delta": "double", "impervious_delta": "double",
    "lst_delta": "double", "heat_delta": "double", "flood_delta": "double",
}


def catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue with its effectiveness score."""
    ddl = ", ".join(f"{n} {t}" for n, t in TYPES.items())
    rows = spark.createDataFrame([tuple(r[n] for n in TYPES) for r in CATALOGUE], ddl)
    return rows.withColumn("effectiveness", risk.effectiveness(
        F.col("heat_delta"), F.col("flood_delta"), F.col("ndvi_delta"), F.col("lst_delta")))


def actions(wards: DataFrame) -> DataFrame:
    """Wards times interventions, expanded in place (no join)."""
    return expand_literals(wards, list(CATALOGUE), TYPES)


def pad_wards(risks: DataFrame, ward_count: int, heat: float = 40.0, flood: float = 20.0) -> DataFrame:
    """Wards 1..ward_count that have no row get the given scores."""
    ids = risks.sparkSession.range(1, ward_count + 1).select(F.col("id").cast("int").alias("ward_id"))
    absent = ids.join(risks.select("ward_id"), "ward_id", "left_anti")
    return risks.unionByName(
        absent.select("ward_id", F.lit(heat).alias("heat_stress_score"), F.lit(flood).alias("flood_risk_score")),
        allowMissingColumns=True,
    )


def with_benefit(options: DataFrame) -> DataFrame:
    return options.select(
        "*",
        risk.intervention_benefit(F.col("heat_delta"), F.col("flood_delta"), F.col("heat_stress_score"),
                                  F.col("flood_risk_score")).alias("benefit_score"),
        risk.expected_heat_reduction(F.col("heat_delta"), F.col("lst_delta")).alias("expected_heat_reduction"),
        risk.expected_flood_reduction(F.col("flood_delta")).alias("expected_flood_reduction"),
    )


def benefit_recommendations(risks: DataFrame, budget: int = 60, top_k: int = 10) -> DataFrame:
    """The k affordable (ward, intervention) options of highest benefit."""
    options = with_benefit(actions(risks.select("ward_id", "heat_stress_score", "flood_risk_score")))
    keyed = options.filter(F.col("cost") <= budget).withColumn(
        "_key", F.struct("ward_id", "intervention_type"))
    best = ranked_top(keyed, F.col("benefit_score"), top_k, key="_key")
    return best.select(
        "priority_rank", "ward_id", "intervention_type", "expected_heat_reduction", "expected_flood_reduction", "cost",
        "benefit_score", F.col("heat_stress_score").alias("ward_heat_stress"),
        F.col("flood_risk_score").alias("ward_flood_risk"),
    )


def fill_recommendations(primary: DataFrame, risks: DataFrame, budget: int, top_k: int) -> DataFrame:
    """Complete a primary list from the heuristic over the wards it lacks, on the budget that is left; re-ranked.

    The primary list has at most top_k rows, so its size and cost are one-row scalars of the plan.
    """
    used = primary.agg(F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("cost"), F.lit(0)).alias("spent")))
    rest = risks.join(primary.select("ward_id").distinct(), "ward_id", "left_anti")
    left = F.lit(budget) - used.scalar()["spent"]
    extra = greedy_recommendations(rest, left.cast("int"), top_k)
    offset = used.scalar()["n"]
    shifted = extra.withColumn("priority_rank", (F.col("priority_rank") + offset).cast("int")).filter(
        F.col("priority_rank") <= top_k)
    columns = [c for c in primary.columns if c in shifted.columns]
    return primary.select(*columns).unionByName(shifted.select(*columns))


def project_effects(options: DataFrame, repeats: Column | None = None) -> DataFrame:
    """State after an intervention and its reward (deterministic effects).

    ``options`` has the ward state (ndvi, impervious_pct, scores) and the catalogue columns; ``repeats`` is how often
    the ward was treated before.
    """
    heat, flood = F.col("heat_stress_score"), F.col("flood_risk_score")
    new_heat = clip(heat + F.col("heat_delta") - F.abs("lst_delta") * 2.0, 0.0, 100.0)
    new_flood = clip(flood + F.col("flood_delta"), 0.0, 100.0)
    gain = F.greatest(F.lit(0.0), heat - new_heat) + F.greatest(F.lit(0.0), flood - new_flood)
    n = F.lit(0) if repeats is None else repeats
    reward = (
        gain - F.col("cost") * 0.001
        - F.when(n > 0, F.lit(0.5) * F.pow(n, F.lit(1.5))).otherwise(F.lit(0.0))
        - F.when(gain < 1.0, F.lit(0.3)).otherwise(F.lit(0.0))
    )
    return options.select(
        "ward_id", "intervention_type",
        clip(F.col("ndvi") + F.col("ndvi_delta"), 0.0, 1.0).alias("ndvi"),
        clip(F.col("impervious_pct") + F.col("impervious_delta"), 0.0, 100.0).alias("impervious_pct"),
        new_heat.alias("heat_stress_score"), new_flood.alias("flood_risk_score"), reward.alias("reward"),
    )


def scenarios(wards: DataFrame) -> DataFrame:
    """City score if every ward took one and the same intervention, next to the score of doing nothing."""
    after = city_score(project_effects(actions(wards)), ["intervention_type"])
    before = city_score(wards).select(F.lit("none").alias("intervention_type"), "city_score", "improvement_bonus")
    return after.unionByName(before)


def roi_table(risks: DataFrame, recommendations: DataFrame, ward_count: int = geo.WARD_COUNT) -> DataFrame:
    """Every ward with its first recommendation, return on investment and edge-to-edge grid position."""
    first = first_per_key(
        recommendations.select("ward_id", "priority_rank", "intervention_type", "expected_heat_reduction",
                               "expected_flood_reduction", "cost"),
        "ward_id", "priority_rank",
    ).drop("priority_rank")
    joined = risks.join(first, "ward_id", "left")
    heat = F.coalesce("expected_heat_reduction", F.lit(0.0))
    flood = F.coalesce("expected_flood_reduction", F.lit(0.0))
    lon, lat = geo.edge_to_edge(
        geo.grid_row(F.col("ward_id")), geo.grid_col(F.col("ward_id")), geo.grid_rows(ward_count))
    return joined.select(
        "ward_id", "ward_name",
        risk.combined_risk(F.col("heat_stress_score"), F.col("flood_risk_score")).alias("composite_risk"),
        "heat_stress_score", "flood_risk_score", "risk_level",
        F.col("intervention_type").alias("recommended_intervention"),
        heat.alias("expected_heat_reduction"), flood.alias("expected_flood_reduction"),
        F.coalesce(F.nullif("cost", F.lit(0)), F.lit(1)).alias("cost"),
        risk.roi(heat, flood, F.col("cost")).alias("roi_score"),
        F.round(lon, 5).alias("lon"), F.round(lat, 5).alias("lat"),
    )


def roi_map(risks: DataFrame, recommendations: DataFrame, ward_count: int = geo.WARD_COUNT) -> DataFrame:
    """ROI table with a point geometry, ready for the GeoJSON export."""
    table = roi_table(risks, recommendations, ward_count)
    return table.withColumn("geometry", point_geometry(F.col("lon"), F.col("lat"))).drop("lon", "lat")
