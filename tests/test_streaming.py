"""Streams give what the batch operators give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.operators import sequence
from tessella.sources import readers
from tessella.streaming import streams


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("s") / "events")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    far = e.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).withColumn("event_id", F.lit(10**9).cast("long"))  # closes all windows
    e.orderBy("ts").coalesce(1).write.parquet(d)
    far.write.mode("append").parquet(d)
    return d


def run(df, spark, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_sessions(spark, folder, tmp_path):
    got = run(streams.sessions(streams.event_stream(spark, folder)), spark, "sess", tmp_path).where("first_ts < '2029-01-01'")
    batch = sequence.sessionise(spark.read.parquet(folder), "user_id", "ts", 3600, "event_id")
    want = batch.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n")).join(spark.range(1), F.lit(True)).count()
    assert got.count() == want - 1


def test_weekly_counts(spark, folder, tmp_path):
    got = run(streams.weekly(streams.event_stream(spark, folder)), spark, "weekly", tmp_path).agg(F.sum("n")).first()[0]
    assert got == spark.read.parquet(folder).count() - 1


def test_touch_counter(spark, folder, tmp_path):
    got = {r.event_id: r.streak for r in run(streams.touch_counter(streams.event_stream(spark, folder, files=100)), spark, "touch", tmp_path).collect()}
    want = {r.event_id: r.streak for r in sequence.streaks(spark.read.parquet(folder), "user_id", "ts", 86400, "event_id").collect()}
    assert got == want


def test_bursts_and_dedup(spark, folder, tmp_path):
    assert run(streams.error_bursts(streams.event_stream(spark, folder)), spark, "bursts", tmp_path).count() > 0
    assert run(streams.observations(streams.event_stream(spark, folder)), spark, "obs", tmp_path).count() == spark.read.parquet(folder).count()


def test_sink_once(spark, folder, tmp_path):
    q = streams.sink_once(streams.event_stream(spark, folder), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(folder).count()


def test_transcripts_and_notes(spark, tmp_path):
    lines = ['{"type":"user","timestamp":"2024-01-01T00:00:00Z","message":{"role":"user","content":"hi"}}', '{"message":{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"tool","text":"x"},{"type":"text","text":"b"}]}}', "not json"]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    got = [(r.role, r.text) for r in readers.transcripts(spark, str(tmp_path / "t.jsonl")).collect()]
    assert got == [("user", "hi"), ("assistant", "a\nb")]
    note = spark.createDataFrame([("---\ntitle: A: b\ntags: x\n---\nbody\n",)], "value string")
    r = readers.frontmatter(note).first()
    assert r.meta == {"title": "A: b", "tags": "x"} and r.body == "body\n"


def test_exports(spark, sf_dir, tmp_path):
    from tessella import model

    r = model.records(spark, sf_dir)
    readers.export_json(r, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == r.where("status = 'active'").count()


def run_to_files(df, spark, tmp_path, name):
    """As ``run``, into files: a query that is started again goes on where it stopped. Gives the rows of this start."""
    out, n = tmp_path / f"{name}-out", len(list(tmp_path.glob(f"{name}-start*")))
    (tmp_path / f"{name}-start{n}").touch()
    batch = lambda d, k: d.write.mode("overwrite").parquet(f"{out}/start={n}/batch={k}")
    df.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start().awaitTermination(120)
    return [r for r in spark.read.parquet(str(out)).collect() if r.start == n]


def events_in(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def at(minutes):
    import datetime as dt

    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_prompts_once(spark, tmp_path):
    schema, path = "session string, prompt string, ts timestamp", str(tmp_path / "p")
    go = lambda: sorted((r.session, r.prompt) for r in run_to_files(streams.prompts_once(streams.event_stream(spark, path, schema)), spark, tmp_path, "prompts"))
    events_in(spark, path, [("a", "hi", at(0)), ("a", "hi", at(2)), ("b", "hi", at(2)), ("a", " ", at(3)), ("a", "other", at(3))], schema)
    assert go() == [("a", "hi"), ("a", "other"), ("b", "hi")]
    events_in(spark, path, [("a", "hi", at(4)), ("z", "later", at(100))], schema)
    assert go() == [("z", "later")]
    # Long after the window the same prompt counts again.
    events_in(spark, path, [("a", "hi", at(120))], schema)
    assert go() == [("a", "hi")]


def test_change_feed_has_a_cursor_per_table(spark, tmp_path):
    schema = "id long, ts timestamp"
    tables = {n: (str(tmp_path / n), schema) for n in ("one", "two")}
    go = lambda: sorted((r.table, r.id) for r in run_to_files(streams.change_feed(spark, tables), spark, tmp_path, "feed"))
    events_in(spark, tables["one"][0], [(1, at(0))], schema)
    events_in(spark, tables["two"][0], [(7, at(0))], schema)
    assert go() == [("one", 1), ("two", 7)]
    events_in(spark, tables["two"][0], [(8, at(1))], schema)
    assert go() == [("two", 8)]


def test_worker_retries_and_fails(spark, tmp_path):
    path, queue = str(tmp_path / "tasks"), str(tmp_path / "queue")
    process = lambda d: d.select("id", (F.col("id") % 2 == 0).alias("ok"), F.when(F.col("id") % 2 == 1, "odd").alias("error"))
    for n, ids in enumerate(([1, 2], [3], [4], [6])):
        events_in(spark, path, [(i, at(0)) for i in ids], "id long, ts timestamp")
        q = streams.worker(streams.event_stream(spark, path, "id long, ts timestamp"), process, queue, str(tmp_path / "cp"))
        q.awaitTermination(60)
        state = {r.id: (r.status, r.attempts) for r in spark.read.parquet(f"{queue}/generation={n}").collect()}
    assert state == {1: ("failed", 3), 2: ("done", 1), 3: ("failed", 3), 4: ("done", 1), 6: ("done", 1)}


def test_late_rows(spark, tmp_path):
    """Rows behind the watermark are left out; those before it count in their session."""
    path = str(tmp_path / "e")
    row = lambda i, m: (i, at(m), 1, "view", 1.0, "")
    go = lambda: [r.n for r in run_to_files(streams.sessions(streams.event_stream(spark, path)), spark, tmp_path, "late")]
    events_in(spark, path, [row(1, 0), row(2, 10)], streams.EVENTS)
    assert go() == []  # the session is open
    events_in(spark, path, [row(3, 300)], streams.EVENTS)
    assert go() == [2]
    events_in(spark, path, [row(4, 20), row(5, 600)], streams.EVENTS)
    assert go() == [1]  # row 4 came too late for any session


def test_activity_windows(spark, folder, tmp_path):
    n = {k: run(streams.activity(streams.event_stream(spark, folder), k), spark, f"act_{k}", tmp_path).count() for k in streams.PAUSES}
    assert n["active"] >= n["idle"] >= n["episode"] > 0


def test_idle_projects(spark):
    rows = [("a", at(0), None), ("b", at(10), at(9)), ("c", at(500), None), ("d", at(5), at(-500))]
    p = spark.createDataFrame(rows, "project string, touched timestamp, consolidated timestamp")
    assert [r.project for r in streams.idle_projects(p, F.lit("2024-01-01 05:00:00").cast("timestamp")).collect()] == ["a", "d"]
