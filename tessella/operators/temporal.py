"""Bi-temporal facts, intervals and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assert_facts(log: DataFrame, arrival: str = "fact_id") -> DataFrame:
    """An ordered log to validity periods: a repeat of the open fact changes nothing, another object closes it."""
    w = Window.partitionBy("subject", "predicate").orderBy("valid_from", arrival)
    changed = log.withColumn("before", F.lag("object").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("object")))
    return changed.select(arrival, "subject", "predicate", "object", "valid_from", F.lead("valid_from").over(w).alias("valid_to"), F.lead(arrival).over(w).alias("superseded_by"))


def holds_at(t: Column) -> Column:
    """Half-open: [valid_from, valid_to)."""
    return (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))


def at(facts: DataFrame, t: Column) -> DataFrame:
    return facts.where(holds_at(t))


def invalidate(facts: DataFrame, closures: DataFrame) -> DataFrame:
    """Open facts that ``closures`` (subject, predicate, object, closed_at) name are closed."""
    joined = facts.join(closures, ["subject", "predicate", "object"], "left")
    return joined.withColumn("valid_to", F.coalesce("valid_to", F.when(F.col("closed_at") >= F.col("valid_from"), F.col("closed_at")))).drop("closed_at")


def diff(facts: DataFrame, t1: Column, t2: Column) -> DataFrame:
    """(subject, predicate, before, after, change) between two instants."""
    a, b = at(facts, t1).select("subject", "predicate", F.col("object").alias("before")), at(facts, t2).select("subject", "predicate", F.col("object").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return a.join(b, ["subject", "predicate"], "full").where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("change", change)


def allen(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The one of 13 relations that two half-open intervals stand in."""
    return (
        F.when((s1 == s2) & (e1 == e2), "eq")
        .when((s1 == s2) & (e1 < e2), "s")
        .when((s1 == s2) & (e1 > e2), "si")
        .when((e1 == e2) & (s1 > s2), "f")
        .when((e1 == e2) & (s1 < s2), "fi")
        .when((s1 > s2) & (e1 < e2), "d")
        .when((s1 < s2) & (e1 > e2), "di")
        .when(e1 == s2, "m")
        .when(s1 == e2, "mi")
        .when((s1 < s2) & (e1 > s2), "o")
        .when((s1 > s2) & (s1 < e2), "oi")
        .when(e1 < s2, "b")
        .otherwise("bi")
    )


def _relation(s1: int, e1: int, s2: int, e2: int) -> str:
    """The relation of two intervals of integers."""
    if e1 < s2 or e2 < s1:
        return "b" if e1 < s2 else "bi"
    if e1 == s2 or e2 == s1:
        return "m" if e1 == s2 else "mi"
    start, end = (s1 > s2) - (s1 < s2), (e1 > e2) - (e1 < e2)
    return {(0, 0): "eq", (0, -1): "s", (0, 1): "si", (1, 0): "f", (-1, 0): "fi", (1, -1): "d", (-1, 1): "di", (-1, -1): "o", (1, 1): "oi"}[start, end]


def _compositions() -> dict[tuple[str, str], str]:
    """Pairs of relations that leave one relation of first to third: found by trying all orders of six end points."""
    spans = [(s, e) for s in range(6) for e in range(s + 1, 6)]
    results: dict[tuple[str, str], set[str]] = {}
    for x in spans:
        for y in spans:
            for z in spans:
                results.setdefault((_relation(*x, *y), _relation(*y, *z)), set()).add(_relation(*x, *z))
    return {k: next(iter(v)) for k, v in results.items() if len(v) == 1}


COMPOSE = _compositions()


def compose(a: Column, b: Column) -> Column:
    """The relation of first to third, where the two given ones leave only one; else null.

    Some pairs are commonly given one result though the end points allow several (before and during) or another
    one (met-by and contains, which can only be after): here they are null, or what the end points say.
    """
    pairs = F.create_map(*(F.lit(x) for (p, q), r in COMPOSE.items() for x in (f"{p} {q}", r)))
    return F.try_element_at(pairs, F.concat_ws(" ", a, b))


def overlap_join(points: DataFrame, spans: DataFrame, bucket: int = 86400, by: list[str] | None = None) -> DataFrame:
    """Rows of both sides (s1, e1) and (s2, e2) whose closed ranges overlap, and agree on the columns ``by``.

    Ranges are cut into buckets of so many seconds (about the length of a usual range) and joined on the bucket;
    a pair counts in the first bucket they share, so there is no non-equi join and no pair twice.
    """
    slot = lambda c: F.floor(F.unix_timestamp(c) / bucket)
    a = points.withColumn("bucket", F.explode(F.sequence(slot(F.col("s1")), slot(F.col("e1")))))
    b = spans.withColumn("bucket", F.explode(F.sequence(slot(F.col("s2")), slot(F.col("e2")))))
    hit = (F.col("s1") <= F.col("e2")) & (F.col("e1") >= F.col("s2")) & (F.col("bucket") == slot(F.greatest("s1", "s2")))
    return a.join(b, ["bucket", *(by or [])]).where(hit).drop("bucket")


def overlap_counts(points: DataFrame, spans: DataFrame, key: str, bucket: int = 86400) -> DataFrame:
    """(key, n): how many ``spans`` (s2, e2) each of ``points`` (key, s1, e1) overlaps, of those that overlap any.

    Equal spans and equal points are joined once and counted, so no pair of rows is made.
    """
    p, s = (rows.groupBy(*c).agg(F.count(F.lit(1)).alias("c")) for rows, c in ((points, ["s1", "e1"]), (spans, ["s2", "e2"])))
    hits = overlap_join(p.drop("c"), s, bucket).groupBy("s1", "e1").agg(F.sum("c").alias("n"))
    return points.join(hits, ["s1", "e1"]).groupBy(key).agg(F.sum("n").alias("n"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, time: str, right_time: str, value: str) -> DataFrame:
    """``left`` with the latest ``value`` of the same key at or before its time: one sorted pass over both."""
    tagged = left.select("*", F.lit(1).alias("__side"), F.col(time).alias("__t"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    other = right.select(*(F.col(key) if c == key else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.lit(0).alias("__side"), F.col(right_time).alias("__t"), F.struct(value).alias("__v0")[value].alias("__v"))
    w = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = tagged.unionByName(other).withColumn("__last", F.last(F.when(F.col("__side") == 0, F.struct(F.col("__v").alias("v"))), ignorenulls=True).over(w))
    return filled.where("__side = 1").select(*left.columns, F.col("__last.v").alias(value))


def whole_months(a: Column, b: Column) -> Column:
    """Whole months between two times, whichever is earlier; the day is clamped to the month's end."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    m = ((F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo)).cast("int")
    return m - F.when(lo + F.make_interval(F.lit(0), m) > hi, 1).otherwise(0)


def whole_days(a: Column, b: Column) -> Column:
    return F.floor(F.abs(F.unix_timestamp(a) - F.unix_timestamp(b)) / 86400)


def proximity(days: Column, reach: int = 180) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.greatest(days, F.lit(0)) / reach)
