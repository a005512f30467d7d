"""Quality rules whose cutoffs keep false rejection below a stated risk, proven on labelled documents.

DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import stored

_SPACE = r"[\x20\x09-\x0D]+"
# Terms of a binomial tail that are added one by one; the rest is bounded from above by a geometric series.
TAIL_TERMS = 4096


@dataclass(frozen=True)
class Rule:
    """Reject where ``measure`` is above a cutoff; the candidates run from ``mild`` down to ``strict`` in equal steps."""

    name: str
    measure: str
    mild: float
    strict: float
    steps: int = 40

    def cutoffs(self) -> list[float]:
        return [self.mild - (self.mild - self.strict) * k / (self.steps - 1) for k in range(self.steps)]


RULES = (
    Rule("symbols", "n_symbols / n_words", 2.0, 0.05),
    Rule("repeats", "n_repeat_words / n_words", 0.5, 0.1),
    Rule("repeated_lines", "n_dup_lines / n_lines", 0.98, 0.2),
    Rule("capitals", "n_capitals / word_chars", 0.95, 0.1),
    Rule("marks", "n_marks / n_words", 2.0, 0.05),
)


def measures(text: Column) -> dict[str, Column]:
    """First step of a document's measures: its words, its lines with a word, and counts of characters."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return {
        "_words": F.filter(F.split(whole, _SPACE), lambda w: w != ""),
        "_lines": F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
        "_capitals": F.regexp_count(whole, F.lit(r"[A-Z]")).cast("long"),
        "_marks": F.regexp_count(whole, F.lit(r"[!?]")).cast("long"),
    }


def _free(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def measured(docs: DataFrame, name: str = "measures") -> DataFrame:
    """``docs`` (text and any other columns) and a struct column ``name`` with the counts of the whole text.

    n_words, word_chars (code points in words), n_symbols, n_capitals, n_marks, n_lines (lines with a word),
    n_dup_lines (such lines equal to an earlier one), n_repeat_words (words inside three-word windows found at least
    twice, by their 64-bit hashes). All are long; a null text counts as empty.

    Repeated windows are neighbours after sorting (hash, place); the words they cover are counted from the sorted places,
    so a long text costs n log n and no row leaves its task.
    """
    first = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(
        *[v.alias(k) for k, v in measures(F.col("text")).items()]).alias("__a"))
    a = F.col("__a")
    windows = F.when(
        F.size(a["_words"]) > 3,
        F.transform(F.sequence(F.lit(0), F.size(a["_words"]) - 3), lambda i: F.xxhash64(
            F.get(a["_words"], i), F.get(a["_words"], i + 1), F.get(a["_words"], i + 2))))
    second = first.withColumn("__b", windows)
    b = F.col("__b")
    third = second.withColumn("__c", F.when(
        F.size(F.array_distinct(b)) < F.size(b),
        F.array_sort(F.transform(b, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    c = F.col("__c")
    fourth = third.withColumn("__d", F.array_sort(F.transform(F.filter(c, lambda x, i: (
        F.coalesce(F.get(c, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(c, i + 1)["h"] == x["h"], F.lit(False))
    )), lambda x: x["i"])))
    d = F.col("__d")
    covered = F.aggregate(
        F.transform(d, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(d, i + 1) - p, F.lit(3)))),
        F.lit(0), lambda s, x: s + x)
    return fourth.withColumn(name, F.struct(
        F.size(a["_words"]).cast("long").alias("n_words"),
        F.length(F.array_join(a["_words"], "")).cast("long").alias("word_chars"),
        a["_symbols"].alias("n_symbols"), a["_capitals"].alias("n_capitals"), a["_marks"].alias("n_marks"),
        F.size(a["_lines"]).cast("long").alias("n_lines"),
        (F.size(a["_lines"]) - F.size(F.array_distinct(a["_lines"]))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )).drop("__a", "__b", "__c", "__d")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1 by Stirling's series eight places further on; the error is below 1e-10."""
    z = x + 8.0
    series = 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z * z) + 1.0 / (1260.0 * F.pow(z, F.lit(5.0)))
    shift = F.log(x)
    for k in range(1, 8):
        shift = shift + F.log(x + float(k))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), from above; 1 where k >= n p (no bound of use lies there)."""
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)
                + k * math.log(p) + (n - k) * math.log1p(-p))
    down = F.sequence(k.cast("long"), F.greatest(F.lit(1), k.cast("long") - TAIL_TERMS), F.lit(-1).cast("long"))
    summed = F.aggregate(
        F.when(k >= 1, down), F.struct(top.alias("term"), top.alias("total")),
        lambda s, i: F.struct(
            (s["term"] * i * (1 - p) / ((n - i + 1) * p)).alias("term"),
            (s["total"] + s["term"] * i * (1 - p) / ((n - i + 1) * p)).alias("total")))
    left = F.greatest(F.lit(0.0), k - TAIL_TERMS)
    ratio = left * (1 - p) / ((n - left + 1) * p)
    rest = F.when(left > 0, summed["term"] * ratio / (1 - ratio)).otherwise(0.0)
    return F.when(k >= n * p, 1.0).when(k < 1, top).otherwise(summed["total"] + rest)


def cutoffs(
    labelled: DataFrame, rules: Sequence[Rule] = RULES, risk: float = 0.02, error: float = 0.05, price: float = 20.0
) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_false, n_junk): the proven cutoff of each rule; none where none is proven.

    ``labelled`` has stratum, quality (1 good, 0 junk) and the measures as columns. A stratum's risk of rejecting a
    good document is shared equally by the rules. A rule's candidates are tested from the mildest on: a candidate is
    proven when the exact binomial probability of at most as many false rejections, were the rate as high as the rule's
    share, is at most ``error`` / (strata * rules); testing ends at the first that is not. This holds for all proven
    cutoffs at once with probability 1 - ``error`` (fixed sequence inside a rule, Bonferroni over strata and rules).
    Of a rule's proven candidates the one with the most junk less ``price`` per false rejection is taken, the
    mildest of equals; it must reject some junk. Documents only enter as counts per stratum, rule and step.
    """
    share = risk / len(rules)

    def passed(rule: Rule) -> Column:
        ratio = F.try_divide(*map(F.col, rule.measure.split(" / ")))
        return F.size(F.filter(
            F.array(*map(F.lit, rule.cutoffs())), lambda cutoff: F.coalesce(ratio > cutoff, F.lit(False))))

    steps = F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), passed(r).alias("passed"), F.lit(r.steps).alias("steps")) for r in rules]))
    counted = (
        labelled.filter("quality in (0, 1)").select("stratum", "quality", steps.alias("_s"))
        .groupBy("stratum", F.col("_s.rule").alias("rule"), F.col("_s.steps").alias("steps"), F.col("_s.passed").alias("passed"))
        .agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
             F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("junk"))
    )
    # cutoffs fall from step to step: a document above j of them is above the last j
    per_rule = counted.groupBy("stratum", "rule", "steps").agg(
        F.sum("good").alias("n"), F.collect_list(F.struct("passed", "good", "junk")).alias("_at"))

    def above(what: str, step: Column) -> Column:
        return F.aggregate("_at", F.lit(0).cast("long"), lambda s, x: s + F.when(x["passed"] >= F.col("steps") - step, x[what]).otherwise(0))

    strata = F.greatest(F.lit(1), counted.select("stratum").distinct().agg(F.count(F.lit(1))).scalar())
    tried = per_rule.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("steps") - 1))).select(
        "stratum", "rule", "step", "n", above("good", F.col("step")).alias("n_false"),
        above("junk", F.col("step")).alias("n_junk"))
    tried = tried.withColumn(
        "proven", (F.col("n") > 0) & (binomial_tail(F.col("n_false"), F.col("n"), share) <= error / (strata * len(rules))))
    order = Window.partitionBy("stratum", "rule").orderBy("step")
    kept = tried.withColumn("_all", F.min("proven").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(
        "_all and n_junk > 0")
    value = F.element_at(F.element_at(F.create_map(*[
        x for r in rules for x in (F.lit(r.name), F.array(*map(F.lit, r.cutoffs())))]), F.col("rule")), F.col("step") + 1)
    best = F.max(F.struct(
        (F.col("n_junk") - price * F.col("n_false")).alias("gain"), (-F.col("step")).alias("mild"),
        F.struct(value.alias("cutoff"), "n", "n_false", "n_junk").alias("row")))
    return kept.groupBy("stratum", "rule").agg(best.alias("_b")).filter("_b.gain > 0").select(
        "stratum", "rule", F.col("_b.row.cutoff").alias("cutoff"), F.col("_b.row.n").alias("n_good"),
        F.col("_b.row.n_false").alias("n_false"), F.col("_b.row.n_junk").alias("n_junk"))


def judged(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: Sequence[Rule] = RULES, risk: float = 0.02,
    error: float = 0.05,
) -> tuple[DataFrame, str]:
    """``docs`` with one more struct column (its name is returned): the measures, base_failed and kept.

    ``docs`` has doc_id, text and the stratum column; ``labels`` has doc_id and quality. The measured table is stored
    once, labels meet its narrow columns only, and the proven cutoffs come back as one small row per stratum. Every
    row gets a verdict: not kept if the base rule fails, or if a proven cutoff of its stratum is passed.

    Null strata are one stratum. A document with labels that differ is junk; null labels and labels of unknown documents
    are ignored; of rows that share a doc_id one is counted. Without labels, or with too few to prove a cutoff, only the
    base rule rejects. Null and empty texts fail the base rule. An empty table gives an empty result.
    """
    name = _free(docs, "measures")
    table = stored(measured(docs, name), "measures", "zstd")
    m = F.col(name)
    group = F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")
    narrow = table.filter(F.col("doc_id").isNotNull() & ~base_failed(m["n_words"], m["n_repeat_words"])).select(
        F.col("doc_id").cast("long").alias("doc_id"), group, f"{name}.*")
    graded = labels.filter("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    once = narrow.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in narrow.columns if c != "doc_id"])
    chosen = stored(cutoffs(once.join(graded, "doc_id"), rules, risk, error), "cutoffs")
    limits = chosen.groupBy(F.col("stratum").alias("__stratum")).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__limits"))
    marked = table.withColumn("__own", group).join(limits, F.col("__own") == F.col("__stratum"), "left")
    passed = F.lit(False)
    for rule in rules:
        over, under = (m[x] for x in rule.measure.split(" / "))
        limit = F.element_at(F.col("__limits"), rule.name)
        passed = passed | F.coalesce(F.try_divide(over, under) > limit, F.lit(False))
    failed = base_failed(m["n_words"], m["n_repeat_words"])
    verdict = m.withField("base_failed", failed).withField("kept", ~failed & ~passed)
    return marked.withColumn(name, verdict).drop("__own", "__stratum", "__limits"), name
