"""Sessions, streaks and ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessionise(rows: DataFrame, key: str, time: str, gap: int = 3600, order: str | None = None) -> DataFrame:
    """``rows`` with ``session`` (from 0 per key): a new one after more than ``gap`` seconds."""
    w = Window.partitionBy(key).orderBy(time, *([order] if order else []))
    apart = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp")) > gap * 1_000_000
    return rows.withColumn("session", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def streaks(rows: DataFrame, key: str, time: str, gap: int = 86400, order: str | None = None) -> DataFrame:
    """``rows`` with ``streak``: touches so far without a pause longer than ``gap``."""
    s = sessionise(rows, key, time, gap, order)
    return s.withColumn("streak", F.row_number().over(Window.partitionBy(key, "session").orderBy(time, *([order] if order else [])))).drop("session")


def clamped_fold(events: Column, start: float, steps: dict[str, float], other: float = 0.0) -> Column:
    """A level that outcomes raise or lower, kept within 0 and 1 and rounded to four digits at every step."""
    step = F.lit(other)

    def delta(e: Column) -> Column:
        out = step
        for name, d in steps.items():
            out = F.when(e == name, d).otherwise(out)
        return out

    return F.aggregate(events, F.lit(start), lambda a, e: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a + delta(e))) * 10000 + 0.5) / 10000)


def version_chain(records: DataFrame) -> DataFrame:
    """(id, last, steps): the end of each record's chain of ``superseded_by``. Every round doubles the jumps, so a chain of n
    records takes log n rounds; records on a ring, or whose chain leads into one, have no end (null)."""
    from tessella.operators.graph import cut

    known = records.select(F.col("id").alias("nxt")).distinct()
    hop = records.where(F.col("superseded_by").isNotNull()).select("id", F.col("superseded_by").alias("nxt"))
    # A successor that is no record is an end.
    ends = hop.join(known, "nxt", "left_anti").select(F.col("nxt").alias("id")).distinct()
    first = records.select("id", F.coalesce("superseded_by", "id").alias("last"), F.col("superseded_by").isNotNull().cast("long").alias("steps"))
    jump = cut(first.unionByName(ends.select("id", F.col("id").alias("last"), F.lit(0).cast("long").alias("steps"))))
    rounds = max(1, jump.count()).bit_length()
    for _ in range(rounds):
        far = jump.select(F.col("id").alias("last"), F.col("last").alias("further"), F.col("steps").alias("more"))
        step = jump.join(far, "last").select("id", F.col("further").alias("last"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved"))
        nxt = cut(step)
        jump = nxt.drop("moved")
        if not nxt.where("moved").limit(1).count():
            return records.select("id").join(jump, "id")
    # What still moves after so many doublings goes round.
    far = jump.select(F.col("id").alias("last"), F.col("steps").alias("more"))
    ring = F.col("more") > 0
    return records.select("id").join(jump, "id").join(far, "last").select("id", F.when(~ring, F.col("last")).alias("last"), F.when(~ring, F.col("steps")).alias("steps"))


def error_fix_pairs(events: DataFrame, key: str, time: str, kind: str, error: str, fix: str) -> DataFrame:
    """Each fix with the latest error before it of the same key."""
    w = Window.partitionBy(key).orderBy(time, "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(kind) == error, F.col("event_id")), ignorenulls=True).over(w)
    return events.withColumn("error_id", last).where(F.col(kind) == fix)
