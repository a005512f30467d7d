"""Mixing sources to target weights: token budgets flow down a tree, documents fill each leaf's budget in seeded epochs.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import stored

# A leaf's seeded order is cut into 16^3 blocks; only the block where its budget ends is put in order.
BLOCK_DIGITS = 3
# What a child without weight counts while others have room.
NO_WEIGHT = 1e-9
_BETWEEN = "\x1f"


def _path_text(names: Sequence[str]) -> Column:
    return F.concat_ws(_BETWEEN, *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])


def leaf_budgets(
    leaves: DataFrame, path: Sequence[str], weights: Mapping[tuple[str, ...], float], total: Column
) -> DataFrame:
    """``leaves`` (path..., tokens, capacity) with ``budget``, the tokens that each leaf is to give.

    ``weights`` maps the path of a node to its weight among its siblings; a node that is not listed weighs 1, a weight
    of 0 or less counts as a billionth. ``total`` is what the root hands out, or all capacities if that is less. The
    path columns are strings without nulls.

    A parent shares its budget among its children in proportion to their weights. Where a child's subtree holds less,
    the rest goes to its siblings by weight; since no node gets more than its subtree holds, a shortage reaches an
    ancestor only when all siblings are full. In closed form: children are put in the order of capacity over weight;
    each is filled while its capacity is at most its share of what is left; the others share the rest by weight.
    """
    table = F.create_map(*[
        x for key, weight in weights.items()
        for x in (F.lit(_BETWEEN.join(key)), F.lit(float(weight)))]) if weights else None
    room = leaves.agg(F.coalesce(F.sum("capacity"), F.lit(0)).cast("double")).scalar()
    budgets, above = None, ["_root"]
    for depth in range(1, len(path) + 1):
        keys = ["_root", *path[:depth]]
        weight = F.coalesce(F.element_at(table, _path_text(path[:depth])), F.lit(1.0)) if weights else F.lit(1.0)
        nodes = (
            leaves.withColumn("_root", F.lit(1)).groupBy(*keys).agg(F.sum("capacity").cast("double").alias("_cap"))
            .withColumn("_w", F.when(weight > 0, weight).otherwise(NO_WEIGHT))
        )
        parent = Window.partitionBy(*above)
        order = parent.orderBy(F.col("_cap") / F.col("_w"), path[depth - 1])
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        ahead = order.rowsBetween(0, Window.unboundedFollowing)
        given = nodes.withColumn("_budget", F.least(total.cast("double"), room)) if budgets is None \
            else nodes.join(budgets, above)
        level = (
            given
            .withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
            .withColumn("_weights", F.sum("_w").over(ahead))
            .withColumn("_full", (F.sum("_cap").over(parent) <= F.col("_budget")) | (  # a whole parent is whole to the token
                F.col("_cap") * F.col("_weights") <= F.col("_left") * F.col("_w")))
            .withColumn("_rank", F.row_number().over(order))
            .withColumn("_rate", F.min(F.when(~F.col("_full"), F.struct(
                "_rank", (F.col("_left") / F.col("_weights")).alias("rate")))).over(parent))
        )
        open_ = F.col("_rate").isNotNull() & (F.col("_rank") >= F.col("_rate._rank"))
        budgets = level.select(*keys, F.when(open_, F.col("_rate.rate") * F.col("_w")).otherwise(F.col("_cap")).alias("_budget"))
        above = keys
    return leaves.join(budgets.drop("_root"), list(path)).select(
        *leaves.columns, F.floor(F.col("_budget") + 1e-6).cast("long").alias("budget"))


def order_key(doc_id: str, seed: int, epoch: str) -> Column:
    """Place of a document in an epoch's order: MD5 of seed, epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string"), F.coalesce(
        F.col(doc_id).cast("string"), F.lit(""))))


def mixed(
    docs: DataFrame, path: Sequence[str], tokens: Column, weights: Mapping[tuple[str, ...], float],
    share: float, max_epochs: int = 1, seed: int = 1, copies: str = "n_copies", at_least_once: bool = False,
) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, with the number of epochs each is taken in (column ``copies``).

    ``path`` names the tree's columns from the root down (domain, language, source); nulls count as the empty name.
    ``tokens`` is a document's size, ``share`` the part of all tokens that the root hands out, over 1 only with
    ``max_epochs`` over 1: a leaf can be read so many times. A leaf's budget is a number of whole epochs and a prefix of
    the next one, in an order seeded by epoch; the prefix ends before the first document that would pass the budget.
    ``at_least_once`` raises every leaf's budget to one whole epoch: no document is left out, and leaves below their
    weight catch up by repeats within ``max_epochs``.
    Documents that share a place (repeated ids) are taken together or not at all. Documents without tokens are taken
    with the prefix they stand in.

    Each leaf's prefix is found from counts per block of its order; only its last block is sorted, so a leaf with a
    third of all rows is as many tasks as any. The documents themselves only meet one small row per leaf. An empty
    table gives an empty result; extra columns stay, and may have any name but ``copies``.
    """
    names = [f"_p{k}" for k in range(len(path))]
    keyed = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(path, names)]
    narrow = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *keyed, F.coalesce(tokens.cast("long"), F.lit(0)).alias("tokens")),
        "sizes")
    leaves = stored(
        narrow.groupBy(*names).agg(F.sum("tokens").alias("tokens")).withColumn("capacity", F.col("tokens") * max_epochs),
        "leaves")
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(share))).scalar()
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    budget = F.greatest("budget", "tokens") if at_least_once else F.col("budget")
    # a leaf without tokens has no budget to fall short of
    epochs = F.greatest(epochs, F.lit(1)) if at_least_once else epochs
    plan = stored(
        leaf_budgets(leaves, names, weights, total).withColumn("budget", budget).withColumn("_epoch", epochs)
        .withColumn("_rest", F.col("budget") - F.col("_epoch") * F.col("tokens")).select(*names, "_epoch", "_rest"), "plan")

    placed = narrow.join(plan, names).withColumn("_at", order_key("doc_id", seed, "_epoch")).select(
        *names, "_rest", "_at", F.substring("_at", 1, BLOCK_DIGITS).alias("_block"), "tokens")
    totals = placed.groupBy(*names, "_rest", "_block").agg(F.sum("tokens").alias("_sum"), F.max("_at").alias("_top"))
    upto = Window.partitionBy(*names).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = stored(totals.withColumn("_upto", F.sum("_sum").over(upto)), "blocks")
    filled = blocks.filter("_upto <= _rest").groupBy(*names).agg(F.max("_top").alias("_limit"))
    last = blocks.filter("_upto > _rest").groupBy(*names).agg(
        F.min(F.struct("_block", (F.col("_upto") - F.col("_sum")).alias("_before"))).alias("_l")).select(
        *names, F.col("_l._block").alias("_block"), F.col("_l._before").alias("_before"))
    inside = Window.partitionBy(*names, "_block").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    partly = (
        placed.join(last, [*names, "_block"])
        .withColumn("_run", F.col("_before") + F.sum("tokens").over(inside)).filter("_run <= _rest")
        .groupBy(*names).agg(F.max("_at").alias("_limit"))
    )
    limits = filled.union(partly).groupBy(*names).agg(F.max("_limit").alias("_limit"))
    final = stored(plan.join(limits, names, "left"), "limits").select(
        F.struct(*[F.col(n) for n in names]).alias("__leaf"), F.col("_epoch").alias("__epoch"), F.col("_limit").alias("__limit"))
    marked = docs.withColumn("__own", F.struct(*keyed)).join(final, F.col("__own") == F.col("__leaf"))
    count = F.col("__epoch") + F.when(order_key("doc_id", seed, "__epoch") <= F.col("__limit"), 1).otherwise(0)
    return marked.withColumn(copies, count.cast("long")).filter(F.col(copies) > 0).drop(
        "__own", "__leaf", "__epoch", "__limit")
