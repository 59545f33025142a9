"""Work queues as tables: claiming, finishing, retries, stale work, health. Each step gives a new table.

A queue has id, status (pending, processing, done, failed), attempts, enqueued_at, started_at, finished_at, last_error.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attempts before a task fails for good, seconds until work counts as stale, tasks claimed at a time.
MAX_ATTEMPTS, STALE_AFTER, BATCH = 3, 60, 5
STALE = "reclaimed: previous worker did not finish in time"


def reclaim(queue: DataFrame, now: Column, stale_after: int = STALE_AFTER) -> DataFrame:
    """Work that was begun too long ago is pending again."""
    stale = F.coalesce((F.col("status") == "processing") & (F.col("started_at") < now - F.make_interval(secs=F.lit(stale_after))), F.lit(False))
    return queue.withColumns({"status": F.when(stale, "pending").otherwise(F.col("status")), "last_error": F.when(stale, STALE).otherwise(F.col("last_error"))})


def claim(queue: DataFrame, now: Column, limit: int = BATCH) -> DataFrame:
    """The oldest pending tasks are processing, with one more attempt; ``claimed`` marks them. The limit is the feature:
    what a worker takes at a time."""
    oldest = queue.where(F.col("status") == "pending").orderBy("enqueued_at", "id").limit(limit).select("id", F.lit(True).alias("claimed"))
    got = F.coalesce("claimed", F.lit(False))
    marked = queue.join(oldest, "id", "left").withColumn("claimed", got)
    mine = F.col("claimed")
    return marked.withColumns({"status": F.when(mine, "processing").otherwise(F.col("status")), "attempts": F.col("attempts") + mine.cast("int"), "started_at": F.when(mine, now).otherwise(F.col("started_at"))})


def finish(queue: DataFrame, results: DataFrame, now: Column, most: int = MAX_ATTEMPTS) -> DataFrame:
    """``results`` (id, ok, error) of claimed tasks: done, pending again, or failed after the last attempt."""
    done = queue.join(results.select("id", "ok", "error"), "id", "left")
    ok, worked = F.col("ok"), F.col("ok").isNotNull()
    status = F.when(~worked, F.col("status")).when(ok, "done").when(F.col("attempts") >= most, "failed").otherwise("pending")
    ended = F.when(worked & (status != "pending"), now).otherwise(F.col("finished_at"))
    error = F.when(worked & ok, F.lit(None).cast("string")).when(worked, F.substring("error", 1, 500)).otherwise(F.col("last_error"))
    return done.withColumns({"status": status, "finished_at": ended, "last_error": error}).drop("ok", "error")


def run_once(queue: DataFrame, process, now: Column, limit: int = BATCH, most: int = MAX_ATTEMPTS, stale_after: int = STALE_AFTER) -> DataFrame:
    """Reclaim, claim, process (claimed rows to (id, ok, error)), finish."""
    taken = claim(reclaim(queue, now, stale_after), now, limit)
    return finish(taken, process(taken.where("claimed")), now, most).drop("claimed")


def replay(log: DataFrame, now: Column, most: int = MAX_ATTEMPTS, stale_after: int = STALE_AFTER) -> DataFrame:
    """A log (id, seq, at, event) of enqueued, claimed, done and failed to the state of each task: one grouped pass."""
    last = F.max_by(F.struct("event", "at"), F.struct("at", "seq")).alias("last")
    tasks = log.groupBy("id").agg(F.count_if(F.col("event") == "claimed").cast("int").alias("attempts"), F.min(F.when(F.col("event") == "enqueued", F.col("at"))).alias("enqueued_at"), last)
    e, stale = F.col("last.event"), F.col("last.at") < now - F.make_interval(secs=F.lit(stale_after))
    status = F.when(e == "done", "done").when((e == "failed") & (F.col("attempts") >= most), "failed").when((e == "claimed") & ~stale, "processing").otherwise("pending")
    return tasks.select("id", status.alias("status"), "attempts", "enqueued_at", F.col("last.at").alias("changed_at"))


def health(queue: DataFrame, now: Column, recent: int = 100, failures: int = 5) -> DataFrame:
    """One row: counts by status, tasks done in the last minute, age of the oldest pending task in seconds, median and 95th
    percentile of the last ``recent`` done tasks (``ms``), ids of the last failures. ``queue`` has id, status, at, ms."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    lately = (F.col("status") == "done") & (F.col("at") > now - F.expr("INTERVAL 60 SECOND")) & (F.col("at") <= now)
    oldest = F.floor((F.unix_micros(now) - F.unix_micros(F.min(F.when(F.col("status") == "pending", F.col("at"))))) / 1_000_000)
    counts = queue.agg(n("pending"), n("processing"), n("done"), n("failed"), F.count_if(lately).alias("per_minute"), oldest.alias("oldest"))
    # Both lists are short by their definition.
    newest = lambda s, k: queue.where(F.col("status") == s).orderBy(F.desc("id")).limit(k)
    ms = newest("done", recent).agg(F.sort_array(F.collect_list("ms")).alias("m"))
    at = lambda i: F.get("m", i.cast("int"))
    speed = ms.select(at(F.floor(F.size("m") / 2)).alias("p50"), at(F.greatest(F.lit(0), F.floor(F.size("m") * 0.95) - 1)).alias("p95"))
    failed = newest("failed", failures).agg(F.array_join(F.transform(F.sort_array(F.collect_list("id"), asc=False), lambda i: i.cast("string")), ",").alias("last_failures"))
    return counts.crossJoin(speed).crossJoin(failed)  # one row each


@contextmanager
def lock(spark: SparkSession, folder: str, name: str, stale_after: int = 3600) -> Iterator[bool]:
    """Whether this driver holds the named lock: a marker in a shared folder that only one can create. A marker older than
    ``stale_after`` seconds belongs to a driver that is gone and is taken over."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    marker = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.lock")
    fs = marker.getFileSystem(conf)
    if fs.exists(marker) and time.time() * 1000 - fs.getFileStatus(marker).getModificationTime() > stale_after * 1000:
        fs.delete(marker, False)
    try:
        fs.create(marker, False).close()
    except Exception as held:
        if "FileAlreadyExists" not in str(held):
            raise
        yield False
        return
    try:
        yield True
    finally:
        fs.delete(marker, False)
