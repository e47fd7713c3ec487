"""Scoring answers, routing and retrieval; budgets; log roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.costs import estimate
from evigraph.functions.text import ColumnLike, col, fingerprint, path_key
from evigraph.session import materialise

#: Ranges that a counting pass of a median has.
BINS = 4096

# Wordings of a refusal.
REFUSALS = (
    "don'?t have", "do not have", "not enough", "no (?:relevant )?information",
    "cannot (?:provide|answer|find)", "can'?t (?:provide|answer|find)",
    "could(?:n'?t| not) find", "do(?:es)? not contain", "isn'?t (?:any )?information",
    "no information (?:about|on|regarding)", "unable to", "not covered", "insufficient",
    "not (?:mentioned|available|provided|found|in the)", "out of scope", "no data",
)
CATEGORIES = ("single_hop", "two_hop", "three_hop", "aggregation", "out_of_scope")
#: (graph and vector, vector alone, questions) where no run has been recorded.
PUBLISHED = {"single_hop": (0.90, 0.70, 10), "two_hop": (0.25, 0.50, 4), "three_hop": (1.00, 0.00, 2), "aggregation": (0.60, 0.10, 10), "out_of_scope": (1.00, 1.00, 10)}
# End of fixed values.

REFUSAL = rf"(?i)({'|'.join(REFUSALS)})"


def score(answer: ColumnLike, kind: ColumnLike, values: ColumnLike) -> Column:
    """Whether an answer meets its expectation."""
    a, k, v = col(answer), col(kind), col(values)
    low = F.lower(a)
    number = F.regexp_like(a, F.concat(F.lit(r"\b"), F.element_at(v, 1), F.lit(r"\b")))
    return F.coalesce(
        F.when(k == "refuse", a.rlike(REFUSAL)).when(k == "number", number).when(k == "contains_any", F.exists(v, lambda x: low.contains(F.lower(x)))).when(k == "contains_all", F.forall(v, lambda x: low.contains(F.lower(x)))),
        F.lit(False),
    )


def _accuracy() -> list[Column]:
    n = F.count(F.lit(1))
    ours, other = F.sum(F.col("ours").cast("long")), F.sum(F.col("vanilla").cast("long"))
    return [n.alias("n"), ours.alias("ours_correct"), other.alias("vanilla_correct"), (ours / n).alias("ours_accuracy"), (other / n).alias("vanilla_accuracy"), ((ours - other) / n * 100).alias("delta_points")]


def accuracy_by_category(rows: DataFrame) -> DataFrame:
    """Counts, accuracies and their difference in points for each category."""
    return rows.groupBy("cat").agg(*_accuracy())


def accuracy_overall(rows: DataFrame) -> DataFrame:
    return rows.agg(*_accuracy())


def upper_median(c: ColumnLike) -> Column:
    """The middle value, of two the larger; exact, from value counts merged map-side."""
    # percentile_disc of the descending order is the larger of two middle values.
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")


def upper_medians(rows: DataFrame, by: str, value: str, bins: int = BINS) -> DataFrame:
    """(by, median): the middle value of each group, of two the larger, by counting passes.

    A pass deals the values that are still in question of every group to ``bins`` ranges
    and counts them map-side; the range that holds the middle is all that the next one
    looks at, until its ends are equal. No task holds a group's values, however many
    there are. Nulls don't count; infinite values and then NaN are the largest; a group
    without values has none.
    """
    v = materialise(rows.select(F.col(by).alias("k"), F.col(value).alias("v")).where("v IS NOT NULL"), "values")
    number = F.col("v").cast("double")
    finite = ~F.isnan(number) & (F.abs(number) < float("inf"))
    ends = (F.min(F.when(finite, F.col("v"))).alias("lo"), F.max(F.when(finite, F.col("v"))).alias("hi"))
    state = v.groupBy("k").agg((F.floor(F.count(F.lit(1)) / 2) + 1).alias("need"), *ends)
    state = materialise(state.select("k", "need", "lo", "hi", F.lit(False).alias("found"), F.lit(None).cast(v.schema["v"].dataType).alias("median")), "medians")
    while not (open_ := state.where("NOT found")).isEmpty():
        some = v.join(open_.select(F.col("k").alias("g"), "need", "lo", "hi"), F.col("k").eqNullSafe(F.col("g")))
        some = some.where(~finite | ((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))))
        low, high = F.col("lo").cast("double") / 2, F.col("hi").cast("double") / 2  # halved, so that no difference is infinite
        within = F.least(F.lit(bins - 2), F.greatest(F.lit(1), F.floor(F.try_divide(number / 2 - low, high - low) * bins)))
        place = F.when(F.isnan(number), bins + 1).when(number == float("inf"), bins).when(number == float("-inf"), -1)
        # The ends have ranges of their own, so every pass leaves less.
        place = place.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), bins - 1).otherwise(within)
        counted = some.groupBy("k", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("need").alias("need"))
        upto = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # bins + 3 rows at most
        chosen = counted.withColumn("upto", F.sum("n").over(upto)).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        done = F.col("lo") == F.col("hi")
        more = chosen.select("k", (F.col("need") - F.col("upto") + F.col("n")).alias("need"), "lo", "hi", done.alias("found"), F.when(done, F.col("lo")).alias("median"))
        # Values outside a chosen finite range are behind; infinite ones would else be counted again.
        v = materialise(v.join(more.where("NOT found").select(F.col("k").alias("g"), F.col("lo").alias("from"), F.col("hi").alias("upto")), F.col("k").eqNullSafe(F.col("g"))).where("v >= from AND v <= upto").select("k", "v"), "values")
        state = materialise(state.where("found").unionByName(more), "medians")
    return state.select(F.col("k").alias(by), "median")


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median, mean) of a latency."""
    mean = rows.groupBy(F.col(by).alias("_k")).agg(F.avg(value).alias("mean"))
    both = mean.join(upper_medians(rows, by, value), F.col("_k").eqNullSafe(F.col(by)), "left")
    return both.select(F.col("_k").alias(by), "median", "mean")


def confusion(rows: DataFrame, expected: str = "expected", used: str = "used") -> DataFrame:
    """(expected, used, n, ok): ``expected`` is an array of acceptable paths."""
    e = F.array_join(F.array_sort(expected), "/")
    return rows.groupBy(e.alias("expected"), F.col(used).alias("used")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.array_contains(expected, F.col(used))).alias("ok"))


def routing_accuracy(rows: DataFrame, expected: str = "expected", used: str = "used") -> DataFrame:
    hit = F.array_contains(expected, F.col(used)).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.avg(hit).alias("accuracy"))


def log_summary(log: DataFrame) -> DataFrame:
    """Decisions by path, with how many fell back and their mean latency."""
    return log.groupBy("classified", path_key("path_used").alias("path")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("low_confidence").cast("long")).alias("fallbacks"), F.avg("latency_ms").alias("mean_ms")
    )


def budget(docs: DataFrame, cached: DataFrame | None = None, price_in: float = 0.0, price_out: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Estimates for each document, and whether the manifest has it already (K5)."""
    out = docs.select(F.col(id_col), fingerprint(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), *[c.alias(k) for k, c in estimate(text_col, price_in, price_out).items()])
    if cached is None:
        return out.withColumn("cached", F.lit(False))
    have = cached.select("hash").distinct().withColumn("cached", F.lit(True))
    return out.join(have, "hash", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def budget_totals(estimates: DataFrame) -> DataFrame:
    """One row: totals over all documents and over those still to do."""
    todo = ~F.col("cached")
    sums = [F.sum(c).alias(c) for c in ("chunks", "in_tokens", "out_tokens", "cost")]
    return estimates.agg(F.count(F.lit(1)).alias("docs"), *sums, F.sum(F.when(todo, F.col("chunks")).otherwise(0)).alias("chunks_todo"), F.sum(F.when(todo, F.col("cost")).otherwise(0.0)).alias("cost_todo"))


def gate(cost_todo: float, ceiling: float, confirmed: bool) -> str:
    """'pass' if free, 'block' above the ceiling, 'hold' until confirmed, else 'pass' (C11)."""
    if cost_todo == 0:
        return "pass"
    if cost_todo > ceiling:
        return "block"
    return "pass" if confirmed else "hold"


def gate_of(cost_todo: ColumnLike, ceiling: ColumnLike, confirmed: ColumnLike) -> Column:
    """The same for a column of costs (C11)."""
    cost = col(cost_todo)
    return F.when(cost == 0, "pass").when(cost > col(ceiling), "block").when(col(confirmed), "pass").otherwise("hold")


def published(spark) -> DataFrame:
    """The recorded accuracies, for when there is no result file (K2)."""
    return spark.createDataFrame([(k, *PUBLISHED[k]) for k in CATEGORIES], "cat string, ours_accuracy double, vanilla_accuracy double, n long")
