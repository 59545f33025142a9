"""Structured Streaming forms of the windowed and stateful operators. Batch results are their reference."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def observations(stream: DataFrame, keep: str = "30 days") -> DataFrame:
    """Append-only stream whose state forgets what is older than ``keep``; repeats of an id are dropped."""
    return stream.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["event_id"])


def sessions(stream: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select("user_id", "n", "first_ts", "last_ts")


#: Pauses that end an episode, make a project idle, and keep it active.
PAUSES = {"episode": "1 hour", "idle": "30 minutes", "active": "5 minutes"}


def activity(stream: DataFrame, kind: str, late: str = "10 minutes") -> DataFrame:
    """Sessions by one of the three pauses."""
    return sessions(stream, PAUSES[kind], late)


def error_bursts(stream: DataFrame, least: int = 3, wide: str = "30 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    e = stream.where("event_type = 'error'").withWatermark("ts", late)
    return e.groupBy(F.window("ts", wide, step).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("user_id", F.col("w.start").alias("start"), "n")


def weekly(stream: DataFrame, late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "7 days").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def touch_counter(stream: DataFrame, gap: int = 86400, late: str = "2 days") -> DataFrame:
    """Touches of each user since a pause longer than ``gap`` seconds: one number and one time of state per user."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for t, e in zip(rows.ts, rows.event_id, strict=True):
            s = t.timestamp()
            n = n + 1 if last is not None and s - last <= gap else 1
            last = s
            out.append((e, n))
        state.update((n, last))
        yield pd.DataFrame(out, columns=["event_id", "streak"])

    rows = stream.withWatermark("ts", late).select("user_id", "ts", "event_id")
    return rows.groupBy("user_id").applyInPandasWithState(update, "event_id long, streak long", "n long, last double", "append", GroupStateTimeout.NoTimeout)


def sink_once(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda d: d):
    """Exactly once into one folder per micro-batch: a repeated batch overwrites its own folder."""

    def batch(df: DataFrame, n: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def prompts_once(stream: DataFrame, window: str = "5 minutes") -> DataFrame:
    """User prompts (session, prompt, ts): the same prompt again in its session within the window is dropped; empty ones are no
    prompts."""
    filled = stream.where(F.btrim("prompt") != "").withColumn("prompt_hash", F.sha2("prompt", 256))
    return filled.withWatermark("ts", window).dropDuplicatesWithinWatermark(["session", "prompt_hash"])


def change_feed(spark: SparkSession, tables: dict[str, tuple[str, str]], files: int = 4) -> DataFrame:
    """(table, id, ts) of new rows of several tables {name: (path, schema)}, one stream each under one query: every source keeps its own
    offsets in the checkpoint, so each table has its own cursor. Poll with a trigger of two seconds."""
    feeds = [event_stream(spark, path, schema, files).select(F.lit(name).alias("table"), F.col("id"), F.col("ts")) for name, (path, schema) in tables.items()]
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f)
    return out


def worker(stream: DataFrame, process: Callable[[DataFrame], DataFrame], queue: str, checkpoint: str, most: int = 3):
    """Enrichment worker: each micro-batch of tasks (id, ..) is processed to (id, ok, error) together with what is left to retry, and
    the state after it is written as a generation of ``queue``. A repeated batch writes its own generation again."""

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        new = df.select("id").distinct().withColumns({"attempts": F.lit(0), "status": F.lit("pending"), "last_error": F.lit(None).cast("string")})
        try:
            old = spark.read.parquet(f"{queue}/generation={n - 1}") if n else new.limit(0)
        except Exception as missing:  # the first batch of a fresh queue
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            old = new.limit(0)
        every = old.unionByName(new.join(old.select("id"), "id", "left_anti"))
        results = process(every.where("status = 'pending'").select("id"))
        done = every.join(results, "id", "left")
        worked, tries = F.col("ok").isNotNull(), F.col("attempts") + 1
        status = F.when(~worked, F.col("status")).when(F.col("ok"), "done").when(tries >= most, "failed").otherwise("pending")
        state = done.select("id", F.when(worked, tries).otherwise(F.col("attempts")).alias("attempts"), status.alias("status"), F.when(worked, F.col("error")).otherwise(F.col("last_error")).alias("last_error"))
        state.write.mode("overwrite").parquet(f"{queue}/generation={n}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def idle_projects(activity: DataFrame, now, idle: str = "30 MINUTES", cooldown: str = "6 HOURS") -> DataFrame:
    """Projects (project, touched, consolidated) that idle-time consolidation may take: untouched for a while, not consolidated
    lately, and not the one that was touched last; the longest idle first. The engine's own scheduler replaces the lock."""
    newest = activity.agg(F.max_by("project", F.struct("touched", "project")).alias("latest"))  # one row
    rest = (F.col("touched") < now - F.expr(f"INTERVAL {idle}")) & (F.col("consolidated").isNull() | (F.col("consolidated") < now - F.expr(f"INTERVAL {cooldown}")))
    return activity.crossJoin(newest).where(rest & (F.col("project") != F.col("latest"))).select("project", "touched").orderBy("touched", "project")
