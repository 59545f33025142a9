"""Counts, rates, percentiles, calibration and retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.graph import cut


def median_place(n: Column) -> Column:
    """Of n sorted values, from 1: the upper one of the two in the middle."""
    return F.floor(n / 2) + 1


def nearest_place(p: float) -> Callable[[Column], Column]:
    """The last of the first p * n values, at least the first."""
    return lambda n: F.greatest(F.lit(1), F.floor(n * p))


def index_place(p: float) -> Callable[[Column], Column]:
    """The one after the first p * n values, at most the last."""
    return lambda n: F.least(n, F.floor(n * p) + 1)


def placed(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, place, n): every value's place among the ``n`` of its group, from 1. Values are sorted in ranges,
    so no task and no row holds a group."""
    tie = F.xxhash64(F.monotonically_increasing_id())
    ranges = rows.where(F.col(value).isNotNull()).select(group, value, tie.alias("tie")).repartitionByRange(group, value, "tie")
    parts = cut(ranges.withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy(group, "part").agg(F.count(F.lit(1)).alias("c"))
    so_far = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(group, "part", F.coalesce(F.sum("c").over(so_far), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy(group)).alias("n"))
    rn = F.row_number().over(Window.partitionBy(group, "part").orderBy(value, "tie"))
    # One row per group and range.
    return parts.withColumn("rn", rn).join(F.broadcast(before), [group, "part"]).select(group, value, (F.col("before") + F.col("rn")).alias("place"), "n")


def percentiles(rows: DataFrame, group: str, value: str, wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per group with a column per wanted percentile: the value at the place that its function of n gives."""
    at = placed(rows, group, value)
    return at.groupBy(group).agg(*(F.max(F.when(F.col("place") == place(F.col("n")), F.col(value))).alias(name) for name, place in wanted.items()))


def laplace(ok: Column, n: Column) -> tuple[Column, Column]:
    """(smoothed success, confidence)."""
    return (ok + 1) / (n + 2), F.least(F.lit(0.95), n / (n + 5))


def health(total: Column, stale: Column, never: Column) -> Column:
    return F.when(total == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - 0.5 * F.try_divide(stale, total) - 0.3 * F.try_divide(never, total)))


def skill_status(n: Column, rate: Column, now: Column) -> Column:
    return F.when((n >= 10) & (rate >= 0.8), "mastered").when(n >= 3, "active").otherwise(now)


def competency_trend(level: Column, n: Column) -> Column:
    return F.when(n < 3, "unknown").when((level > 0.7) & (n >= 5), "improving").when(level <= 0.3, "declining").when(level <= 0.5, "stable_low").otherwise("stable")


def retrieval_metrics(hits: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Per query: recall, whether any and all wanted were found, reciprocal rank, NDCG; ``hits`` has rank from 1."""
    top = hits.where(F.col("rank") <= k).join(wanted.withColumn("rel", F.lit(1)), ["qid", "id"], "left")
    per = top.groupBy("qid").agg(F.count("rel").alias("found"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rel") == 1, 1.0 / F.log2(F.col("rank") + 1.0))).alias("dcg"))
    n = wanted.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    all_q = n.join(per, "qid", "left").fillna(0, ["found", "dcg"])
    return all_q.select("qid", (F.col("found") / F.col("n")).alias("recall"), (F.col("found") > 0).alias("any"), (F.col("found") == F.col("n")).alias("all"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), (F.col("dcg") / ideal).alias("ndcg"))


def calibration_error(rows: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error: equal-width bins, the last one closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    per = rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("conf"), F.avg(label).alias("acc"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def youden(rows: DataFrame, p: str, label: str, steps: int = 19) -> DataFrame:
    """The grid threshold with the best true-positive less false-positive rate: one pass over a fixed grid."""
    grid = F.explode(F.array(*(F.lit((i + 1) / (steps + 1)) for i in range(steps)))).alias("t")
    g = rows.select(p, label, grid)
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    hit, miss = F.count_if((F.col(label) == 1) & (F.col(p) >= F.col("t"))), F.count_if((F.col(label) == 0) & (F.col(p) >= F.col("t")))
    j = g.groupBy("t").agg((F.try_divide(hit, pos) - F.try_divide(miss, neg)).alias("j"))
    return j.agg(F.max_by("t", F.struct("j", -F.col("t"))).alias("threshold"), F.max("j").alias("j"))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token arrays as multisets."""
    vocabulary = F.array_distinct(a)
    count = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    both = F.aggregate(F.transform(vocabulary, lambda w: F.least(count(a, w), count(b, w))), F.lit(0), lambda s, x: s + x)
    return F.when(both == 0, 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def weekly_trend(rows: DataFrame, time: str, as_of: Column, weeks: int = 4) -> DataFrame:
    """Rows of each of the last ``weeks`` weeks; whole weeks back are counted to the microsecond."""
    back = F.floor((F.unix_micros(as_of) - F.unix_micros(F.col(time).cast("timestamp"))) / (7 * 86400 * 1_000_000))
    return rows.withColumn("week", back).where(F.col("week").between(0, weeks - 1)).groupBy("week").agg(F.count(F.lit(1)).alias("n"))


def ranked(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", n).where(F.col("rank") <= k)
