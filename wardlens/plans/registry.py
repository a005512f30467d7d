"""Model gate, promotion table and version comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.risk import metric_passes

# The gated metric, its threshold and direction per model.
MODEL_GATES = {
    "thermal_vision_lst": ("val_rmse", 3.5, False),
    "st_gnn_ward_risk": ("val_heat_rmse", 8.0, False),
    "rl_green_infra": ("ep_reward_mean", 50.0, True),
}


def gate_decisions(runs: DataFrame, gates: dict[str, tuple[str, float, bool]], experiments: dict[str, str] | None = None):
    """Best finished run per gated model and whether it passes. Experiment names default to the model names.

    One scan of ``runs``: each run meets the few gates of its experiment and metric, and the best run of a model is an
    aggregate; run_id breaks ties.
    """
    table = F.array(*[
        F.struct(F.lit(model).alias("model"), F.lit((experiments or {}).get(model, model)).alias("experiment"),
                 F.lit(metric).alias("metric"), F.lit(float(threshold)).alias("threshold"), F.lit(higher).alias("higher"))
        for model, (metric, threshold, higher) in gates.items()])
    own = F.filter(table, lambda g: (g["experiment"] == F.col("experiment")) & (g["metric"] == F.col("metric_name")))
    met = runs.filter((F.col("status") == "FINISHED") & F.col("metric_value").isNotNull()).select(
        "run_id", "metric_value", F.explode(own).alias("g"))
    signed = F.when(F.col("g.higher"), -F.col("metric_value")).otherwise(F.col("metric_value"))
    best = met.groupBy("g").agg(F.min(F.struct(signed.alias("_at"), "run_id", "metric_value")).alias("b"))
    passes = metric_passes(F.col("b.metric_value"), F.col("g.threshold"), F.col("g.higher"))
    return best.select("g.model", "b.run_id", "g.metric", "b.metric_value", "g.threshold", passes.alias("passes"))


def promote(registry: DataFrame, decisions: DataFrame) -> DataFrame:
    """Register each passing run as the model's next version in Production and archive the former Production version.

    ``registry`` has model, version (int), stage and run_id.
    """
    winners = decisions.filter("passes").select("model", F.col("run_id").alias("new_run"))
    marked = registry.join(winners.select("model", F.lit(True).alias("_new")), "model", "left")
    kept = marked.withColumn(
        "stage", F.when(F.col("_new") & (F.col("stage") == "Production"), "Archived").otherwise(F.col("stage"))
    ).drop("_new")
    last = registry.groupBy("model").agg(F.max("version").alias("last"))
    added = winners.join(last, "model", "left").select(
        "model", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version"), F.lit("Production").alias("stage"),
        F.col("new_run").alias("run_id"),
    )
    return kept.select("model", "version", "stage", "run_id").unionByName(added)


def archive(registry: DataFrame, model: str, version: int) -> DataFrame:
    hit = (F.col("model") == model) & (F.col("version") == version)
    return registry.withColumn("stage", F.when(hit, "Archived").otherwise(F.col("stage")))
