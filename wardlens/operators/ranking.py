"""Sorting, top-k, latest-per-key and budgeted selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.risk import combined_risk
from ..session import cut_lineage
from .running import running


def listing(df: DataFrame, sort_by: str | None, limit: int, key: str = "ward_id") -> DataFrame:
    """Descending sort by a column the frame has (an unknown name leaves key order), then the first rows."""
    order = [F.col(sort_by).desc(), F.col(key)] if sort_by in df.columns else [F.col(key)]
    return df.orderBy(*order).limit(limit)


def largest(df: DataFrame, column: str, n: int, key: str = "ward_id") -> DataFrame:
    return df.orderBy(F.col(column).desc(), F.col(key)).limit(n)


def most_recent(df: DataFrame, ts: str, n: int, key: str = "id") -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def ranked_top(df: DataFrame, score: Column, n: int, key: str = "ward_id", rank: str = "priority_rank") -> DataFrame:
    """The n best rows numbered 1..n. The global window runs over the n rows that survive the limit."""
    best = df.withColumn("_score", score).orderBy(F.col("_score").desc(), F.col(key)).limit(n)
    numbered = F.row_number().over(Window.orderBy(F.col("_score").desc(), F.col(key)))
    return best.withColumn(rank, numbered).drop("_score")


def top_per_group(df: DataFrame, group: str, score: Column, n: int, key: str, rank: str = "rank") -> DataFrame:
    """The n best rows of each group. Spark prunes each group to n rows before the shuffle."""
    order = Window.partitionBy(group).orderBy(score.desc(), F.col(key))
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key (DISTINCT ON ... ORDER BY ... DESC) as an aggregate that combines map-side."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def best_run(runs: DataFrame, metric: str, higher_is_better: bool) -> DataFrame:
    """Best finished run per experiment by one metric; run_id breaks ties."""
    sign = -1.0 if higher_is_better else 1.0
    done = runs.filter((F.col("status") == "FINISHED") & (F.col("metric_name") == metric))
    done = done.filter(F.col("metric_value").isNotNull())
    row = F.struct(*runs.columns)
    order = F.struct(F.col("metric_value") * sign, F.col("run_id"))
    return done.groupBy("experiment").agg(F.min_by(row, order).alias("_r")).select("_r.*")


# Heuristic catalogue, cheapest first (the order the fallback tries them in).
HEURISTIC_CATALOGUE = (
    ("tree_planting", 9.0, 0.0, 2),
    ("cool_pavement", 10.0, 0.0, 2),
    ("green_roof", 5.6, 0.0, 3),
    ("permeable_pavement", 0.0, 15.0, 4),
    ("urban_wetland", 3.0, 25.0, 6),
)


def heuristic_choice(heat: Column, flood: Column) -> Column:
    return (
        F.when((heat >= 70) & (flood < 40), "cool_pavement")
        .when(heat >= 60, "tree_planting")
        .when(flood >= 55, "urban_wetland")
        .when(flood >= 40, "permeable_pavement")
        .otherwise("green_roof")
    )


def _catalogue_struct(name: str, heat: float, flood: float, cost: int) -> Column:
    return F.struct(
        F.lit(name).alias("intervention_type"), F.lit(heat).alias("expected_heat_reduction"),
        F.lit(flood).alias("expected_flood_reduction"), F.lit(cost).alias("cost"),
    )


def _spend(wards: Column, budget: Column) -> Column:
    """Walk ranked wards and spend the budget.

    A ward takes its preferred intervention, else the cheapest affordable one; when nothing fits the walk stops. A ward
    is never passed over, so the walk sees at most top_k wards.
    """
    by_name = F.create_map(*[x for row in HEURISTIC_CATALOGUE for x in (F.lit(row[0]), _catalogue_struct(*row))])
    cheapest_first = F.array(*[_catalogue_struct(*row) for row in HEURISTIC_CATALOGUE])
    chosen_type = (
        "array<struct<ward_id: bigint, heat: double, flood: double, pick: struct<intervention_type: string, "
        "expected_heat_reduction: double, expected_flood_reduction: double, cost: int>>>"
    )
    start = F.struct(F.lit(0).alias("spent"), F.lit(False).alias("done"), F.array().cast(chosen_type).alias("out"))

    def step(state: Column, ward: Column) -> Column:
        left = budget - state["spent"]
        wanted = F.element_at(by_name, heuristic_choice(ward["heat"], ward["flood"]))
        fitting = F.get(F.filter(cheapest_first, lambda c: c["cost"] <= left), F.lit(0))
        pick = F.when(wanted["cost"] <= left, wanted).otherwise(fitting)
        stop = state["done"] | (left <= 0) | pick.isNull()
        entry = F.struct(
            ward["ward_id"].cast("bigint").alias("ward_id"), ward["heat"].alias("heat"), ward["flood"].alias("flood"),
            pick.alias("pick"),
        )
        return F.struct(
            F.when(stop, state["spent"]).otherwise(state["spent"] + pick["cost"]).alias("spent"),
            stop.alias("done"),
            F.when(stop, state["out"]).otherwise(F.concat(state["out"], F.array(entry))).alias("out"),
        )

    return F.aggregate(wards, start, step, lambda state: state["out"])


def greedy_recommendations(
    risks: DataFrame, budget: int | Column, top_k: int, group: str | None = None
) -> DataFrame:
    """Budgeted greedy plan over the highest combined risks (per group when given).

    Ranking prunes to top_k rows (per group) before anything is gathered, so the gathered list is never longer.
    """
    rows = risks.withColumn("_combined", combined_risk(F.col("heat_stress_score"), F.col("flood_risk_score")))
    keys = [] if group is None else [group]
    if group is None:
        best = rows.orderBy(F.col("_combined").desc(), F.col("ward_id")).limit(top_k)
    else:
        best = top_per_group(rows, group, F.col("_combined"), top_k, "ward_id", "_rank")
    entry = F.struct(
        (-F.col("_combined")).alias("order"), F.col("ward_id").cast("bigint").alias("ward_id"),
        F.col("heat_stress_score").alias("heat"), F.col("flood_risk_score").alias("flood"),
    )
    wards = best.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("wards"))
    limited = wards.withColumn("_budget", budget if isinstance(budget, Column) else F.lit(budget))
    plan = limited.select(*keys, F.posexplode(_spend(F.col("wards"), F.col("_budget"))).alias("pos", "r"))
    return plan.select(
        *keys,
        (F.col("pos") + 1).alias("priority_rank"),
        "r.ward_id",
        "r.pick.*",
        F.col("r.heat").alias("ward_heat_stress"),
        F.col("r.flood").alias("ward_flood_risk"),
    )


def greedy_plan(risks: DataFrame, budget: int) -> DataFrame:
    """The plan of ``greedy_recommendations`` over all wards and any budget, as running sums of many tasks.

    While its wish is affordable a ward's step only adds a cost, and adding is associative: the money spent before a ward
    is the running sum of the wishes before it, taken over ranges of the ranking. From the first wish that does not fit,
    less than the dearest intervention is left, so the rest of the walk is the next few wards.
    """
    cost = F.create_map(*[x for row in HEURISTIC_CATALOGUE for x in (F.lit(row[0]), F.lit(row[3]))])
    wish = heuristic_choice(F.col("heat"), F.col("flood"))
    rows = risks.select(
        (-combined_risk(F.col("heat_stress_score"), F.col("flood_risk_score"))).alias("order"),
        F.col("ward_id").cast("bigint").alias("ward_id"), F.col("heat_stress_score").alias("heat"),
        F.col("flood_risk_score").alias("flood"),
    ).withColumn("cost", F.element_at(cost, wish))
    ranked = cut_lineage(rows.repartitionByRange("order", "ward_id").withColumn("part", F.spark_partition_id()))
    placed = running(
        ranked, [], ["order", "ward_id"], F.col("part"),
        {"before": ("sum", F.col("cost")), "rank": ("sum", F.lit(1))}, include_current=False)
    placed = cut_lineage(placed.withColumns({
        "before": F.coalesce(F.col("before"), F.lit(0.0)).cast("long"), "rank": F.coalesce(F.col("rank"), F.lit(0.0)).cast("int")}))
    fits = F.col("before") + F.col("cost") <= budget
    by_name = F.create_map(*[x for row in HEURISTIC_CATALOGUE for x in (F.lit(row[0]), _catalogue_struct(*row))])
    wished = placed.filter(fits).select("rank", "ward_id", "heat", "flood", F.element_at(by_name, wish).alias("pick"))
    # each step costs at least the cheapest intervention, and less than the dearest is left
    costs = [row[3] for row in HEURISTIC_CATALOGUE]
    tail = placed.filter(~fits).orderBy("order", "ward_id").limit(max(costs) // min(costs) + 1)
    gathered = tail.agg(
        F.array_sort(F.collect_list(F.struct("order", "ward_id", "heat", "flood"))).alias("wards"),
        F.min("rank").alias("rank"), (F.lit(budget) - F.min("before")).cast("int").alias("left"))
    last = gathered.filter("rank is not null").select(
        "rank", F.posexplode(_spend(F.col("wards"), F.col("left"))).alias("pos", "r")).select(
        (F.col("rank") + F.col("pos")).alias("rank"), "r.*")
    return wished.unionByName(last).select(
        (F.col("rank") + 1).alias("priority_rank"), "ward_id", "pick.*",
        F.col("heat").alias("ward_heat_stress"), F.col("flood").alias("ward_flood_risk"))
