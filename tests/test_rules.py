"""Rules by cases: what they say about single texts, in English and Russian."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.functions import rules as U
from tessella.operators import phrases as P
from tessella.operators import temporal as T


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text, clean",
    [
        ("key sk_abcdefghij0123456789 end", "key [REDACTED] end"),
        ("passwd: x1 and PWD=y", "[REDACTED] and [REDACTED]"),
        ("ASIAABCDEFGHIJKLMNOP", "[REDACTED]"),
        ("authorization abc x, Authorization: y", "[REDACTED] x, Authorization: y"),
        ("a@b.example.com or 1234 5678 9012 3456 or 12345678901234567", "[REDACTED] or [REDACTED] or 12345678901234567"),
        ("eyJ" + "a" * 20 + "." + "b" * 20, "[REDACTED]"),
        ("nothing to hide", "nothing to hide"),
    ],
)
def test_secrets(spark, text, clean):
    assert one(spark, text, U.redact_secrets) == clean


@pytest.mark.parametrize(
    "query, kind, confidence, entities",
    [
        ("who works with Alice and Bob", "relational", 1.0, ["alice", "bob"]),
        ("Кто использует Redis", "relational", 0.9, ["redis"]),
        ("relation between web-service and open_orders", "relational", 0.8, ["web-service", "open_orders"]),
        ("my-app", "semantic", 1.0, []),
        ("list Redis", "semantic", 0.9, ["redis"]),
        ("where is it", "hybrid", 0.65, []),
        ("  ", "hybrid", 0.0, []),
        ("What and Which", "hybrid", 0.65, []),
    ],
)
def test_router(spark, query, kind, confidence, entities):
    r = one(spark, query, U.route)
    assert r.kind == kind and r.confidence == pytest.approx(confidence) and r.entities == entities


@pytest.mark.parametrize("query, intent", [("сборка не работает", "debug"), ("какой порт у сервиса", "factual"), ("how to fix it", "debug"), ("pattern of calls", "architecture"), ("как настроить", "solution"), ("notes", "search"), ("What crashed", "debug"), ("how is the architecture", "architecture")])
def test_intents(spark, query, intent):
    assert one(spark, query, U.query_intent) == intent


@pytest.mark.parametrize(
    "text, path, kind",
    [
        ("whatever", "a/b.RS", "code"),
        ("whatever", "Dockerfile", "config"),
        ("whatever", ".env.local", "env"),
        ("Exception in thread\n  at org.a.B.run(B.java:10)\n", None, "stacktrace"),
        ("  at f (/a/b.js:1:2)", None, "stacktrace"),
        ('{"a": 1}', None, "json"),
        ('{"a": 1} and more', None, "text"),
        ("a: 1\nb: 2\nc: 3", None, "yaml"),
        ("A=1\n#x\nB=2", None, "env"),
        ("if x\nfor y\n", None, "shell"),
        ("func (s *S) Run(a int) error {", None, "code"),
        ("const f = async (x) => x", None, "code"),
        ("# a\nx\n# b", None, "markdown"),
        ("```\nx\n```", None, "shell"),
        ("plain words", "notes", "text"),
    ],
)
def test_content_types(spark, text, path, kind):
    row = spark.createDataFrame([(text, path)], "t string, p string").select(U.content_type(F.col("t"), F.col("p")).alias("k")).first()
    assert row.k == kind


def test_filters(spark):
    run = "platform linux\ncollected 2 items\n\x1b[31mFAILED\x1b[0m a.py::test_b\nnoise\nE   assert 1 == 2\n1 failed, 1 passed, see https://h.example/log."
    assert one(spark, run, lambda x: U.filter_output(x, U.FILTERS["pytest"])) == "FAILED a.py::test_b\nE   assert 1 == 2\n1 failed, 1 passed, see https://h.example/log."
    assert one(spark, "noise in /var/log/x\nmore", lambda x: U.filter_output(x, U.FILTERS["pytest"])) == "(all tests passed)\npreserved: /var/log/x"
    assert one(spark, "noise in /var/log/x", lambda x: U.filter_output(x, U.FILTERS["pytest"], strict=False)) == "(all tests passed)"
    assert one(spark, "a\nb\nc\nd", lambda x: U.filter_output(x, {"head": 3, "tail": 2}, strict=False)) == "b\nc"
    assert one(spark, "abcdefghij", lambda x: U.filter_output(x, {"truncate_chars": 6, "replace": (("a", "z"),)}, strict=False)) == "zbc..."


def test_filter_detection(spark):
    trace = 'Traceback (most recent call last):\n  File "a.py", line 1, in f\nValueError: x\n' + "y" * 100
    assert one(spark, trace, U.detect_filter) == "stack_trace"
    assert one(spark, "short", U.detect_filter) is None
    doc = "Some prose that tells about things.\n```\n" + "INFO a\n" * 30 + "```\n"
    assert one(spark, doc, U.detect_filter) is None  # a document that quotes a log
    assert one(spark, "GET /a HTTP/1.1\nGET /b HTTP/1.1\n" + "x\n" * 50, U.detect_filter) == "http_log"


@pytest.mark.parametrize("text, level", [("Fix typo", 1), ("add the /users endpoint", 2), ("migrate and fix", 3), ("a new microservice", 4), ("w " * 20, 2), ("w " * 45, 3), ("w " * 61, 4), ("hello", 1)])
def test_task_levels(spark, text, level):
    assert one(spark, text, U.task_level) == level


@pytest.mark.parametrize("text, found", [("Спасибо, ОТЛИЧНО", (False, False, True)), ("нет, не так", (True, False, False)), ("попробуй ещё", (False, True, False)), ("it doesnt work", (False, True, False)), ("undo, thanks", (True, False, True)), ("hm", (False, False, False))])
def test_signals(spark, text, found):
    assert tuple(one(spark, text, U.message_signals)) == found


@pytest.mark.parametrize("counts, want", [((3, 0, 0), ("failure", 0.0)), ((1, 1, 2), ("breakthrough", 0.3)), ((0, 0, 3), ("discovery", 0.6)), ((0, 0, 0), ("routine", 0.3)), ((2, 0, 2), ("breakthrough", 0.5))])
def test_outcomes(spark, counts, want):
    row = spark.createDataFrame([counts], "c long, r long, a long")
    three = tuple(F.col(c) for c in "cra")
    got = row.select(U.outcome(*three).alias("o"), U.impact(*three, F.lit(4)).alias("i")).first()
    assert (got.o, got.i) == want


def test_languages(spark):
    assert one(spark, "сборка ok", U.language) == "ru" and one(spark, "build сб", U.language) == "en" and one(spark, "123", U.language) == "en"
    assert one(spark, "maybe we should?", U.content_category) == "discussion" and one(spark, "zzz", U.content_category) == "other"


def test_kept_by(spark):
    before = "# A\n- x\n- y\n- z\n`run` /etc/a/b https://h.example/x.\n```\nls\n```"
    row = lambda after: spark.createDataFrame([(before, after)], "b string, a string").select(U.kept_by(F.col("b"), F.col("a")).alias("k")).first().k
    assert row(before).ok and row(before).items == "ok"
    lost = row("# A\n- x\n- y\n- z")
    assert (lost.blocks, lost.urls, lost.paths, lost.spans, lost.titles_kept, lost.ok) == (["ls\n"], ["https://h.example/x"], ["/a/b"], ["run"], True, False)
    assert row(before.replace("- y\n- z\n", "")).items == "error" and row(before + "\n- more").items == "warning"


def test_composition_leaves_open_what_the_end_points_leave_open(spark):
    pairs = {("b", "o"): "b", ("o", "b"): "b", ("bi", "mi"): "bi", ("mi", "mi"): "bi", ("eq", "d"): "d", ("m", "m"): "b", ("b", "d"): None, ("m", "d"): None, ("mi", "di"): "bi"}
    rows = spark.createDataFrame(list(pairs), "a string, b string").select("a", "b", T.compose(F.col("a"), F.col("b")).alias("c")).collect()
    assert {(r.a, r.b): r.c for r in rows} == pairs


@pytest.mark.parametrize("phrase, want", [("март 2023", "2023-03-01"), ("на этой неделе", "2024-05-13"), ("один день назад", "2024-05-14"), ("12 месяцев назад", "2023-05-15"), ("Feb", "2024-02-01"), ("December", "2023-12-01"), ("в следующий четверг", "2024-05-16"), ("next wednesday", "2024-05-22"), ("10 zz ago", None), ("", None)])
def test_phrases(spark, phrase, want):
    anchor = F.lit("2024-05-15 10:00:00").cast("timestamp")  # a Wednesday
    got = one(spark, phrase, lambda x: P.phrase_date(x, anchor))
    assert (got and got.at) == (want and dt.datetime.fromisoformat(want))


def test_leap_day(spark):
    anchor = F.lit("2024-02-29 10:00:00").cast("timestamp")
    assert one(spark, "1 year ago", lambda x: P.phrase_date(x, anchor)).at == dt.datetime(2023, 2, 28)


@pytest.mark.parametrize("seconds, en, ru", [(0, "0 seconds", "0 секунд"), (61, "1 minute", "1 минута"), (3600 * 5, "5 hours", "5 часов"), (86400 * 21, "3 weeks", "3 недели"), (86400 * 400, "1 year 1 month", "1 год 1 месяц"), (-90000, "1 day 1 hour", "1 день 1 час"), (86400 * 45, "1 month 15 days", "1 месяц 15 дней")])
def test_durations(spark, seconds, en, ru):
    row = spark.createDataFrame([(seconds,)], "s long").select(P.humanised(F.col("s")).alias("en"), P.humanised(F.col("s"), "ru").alias("ru")).first()
    assert (row.en, row.ru) == (en, ru)
