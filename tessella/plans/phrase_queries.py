"""Dates in words, deadlines, durations in words, composition of interval relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import model as M
from tessella.operators import phrases as P
from tessella.operators import temporal as T
from tessella.plans.registry import query
from tessella.plans.rule_queries import listed, quoted
from tessella.session import table

#: Phrases with what they mean at anchor ``a`` (date arithmetic of the other engine), kind and confidence.
PHRASES = (
    ("Yesterday", "date_trunc('day', a) - INTERVAL 1 DAY", "day", 1.0),
    ("послезавтра", "date_trunc('day', a) + INTERVAL 2 DAY", "day", 1.0),
    ("3 days ago", "date_trunc('day', a) - INTERVAL 3 DAY", "day", 0.95),
    ("two weeks ago", "date_trunc('day', a) - INTERVAL 14 DAY", "week", 0.95),
    ("5 months ago", "date_trunc('day', a) - INTERVAL 5 MONTH", "month", 0.95),
    ("a year ago", "date_trunc('day', a) - INTERVAL 1 YEAR", "year", 0.95),
    ("три недели назад", "date_trunc('day', a) - INTERVAL 21 DAY", "week", 0.95),
    ("last week", "date_trunc('week', a) - INTERVAL 7 DAY", "week", 0.9),
    ("next month", "date_trunc('month', a) + INTERVAL 1 MONTH", "month", 0.9),
    ("this year", "date_trunc('year', a)", "year", 0.9),
    ("на прошлой неделе", "date_trunc('week', a) - INTERVAL 7 DAY", "week", 0.9),
    ("в следующем году", "date_trunc('year', a) + INTERVAL 1 YEAR", "year", 0.9),
    ("next Tuesday", "date_trunc('day', a) + to_days(CASE WHEN isodow(a) < 2 THEN 2 - isodow(a) ELSE 9 - isodow(a) END::int)", "day", 0.95),
    ("last fri", "date_trunc('day', a) - to_days(CASE WHEN isodow(a) > 5 THEN isodow(a) - 5 ELSE isodow(a) + 2 END::int)", "day", 0.95),
    ("this wednesday", "date_trunc('week', a) + INTERVAL 2 DAY", "day", 0.95),
    ("в прошлую пятницу", "date_trunc('day', a) - to_days(CASE WHEN isodow(a) > 5 THEN isodow(a) - 5 ELSE isodow(a) + 2 END::int)", "day", 0.95),
    ("in March 2024", "timestamp '2024-03-01'", "month", 1.0),
    ("в марте", "make_timestamp(list_sort([[abs(floor(epoch(make_timestamp(year(a) + -1, 3, 15, 0, 0, 0) - a) / 86400))::bigint, 0, year(a) + -1], [abs(floor(epoch(make_timestamp(year(a) + 0, 3, 15, 0, 0, 0) - a) / 86400))::bigint, 1, year(a) + 0], [abs(floor(epoch(make_timestamp(year(a) + 1, 3, 15, 0, 0, 0) - a) / 86400))::bigint, 2, year(a) + 1]])[1][3], 3, 1, 0, 0, 0)", "month", 0.7),
    ("2023-05-06", "timestamp '2023-05-06'", "day", 1.0),
    ("2023-05-06T07:08", "timestamp '2023-05-06 07:08:00'", "exact", 1.0),
    ("someday soon", "NULL", None, None),
    ("zz days ago", "NULL", None, None),
)
_CASE = " ".join(f"WHEN {n} THEN {x}" for n, (_, x, _, _) in enumerate(PHRASES))


@query(
    f"WITH o AS (SELECT o_orderkey AS id, o_orderkey % {len(PHRASES)} AS n, o_orderdate::timestamp + to_hours((o_orderkey % 24)::bigint) AS a FROM orders) SELECT id, (CASE n {_CASE} END)::timestamp AS at,"
    f" ([{', '.join('NULL' if k is None else quoted(k) for _, _, k, _ in PHRASES)}])[(n + 1)::int] AS kind, ([{', '.join('NULL' if c is None else str(c) for *_, c in PHRASES)}]::double[])[(n + 1)::int] AS confidence FROM o"
)
def d12_relative_phrases(spark, sf_dir):
    k = F.col("o_orderkey")
    anchor = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + k % 24 * 3600)
    o = table(spark, sf_dir, "orders").select(k.alias("id"), P.phrase_date(M.pick(tuple(p for p, *_ in PHRASES), k % len(PHRASES)), anchor).alias("d"))
    return o.select("id", "d.at", "d.kind", "d.confidence")


@query(
    """WITH e AS (SELECT o_orderkey AS id, o_orderdate::date AS d, o_orderkey % 7 AS n FROM orders), r AS (
 SELECT id, 'dmy' AS kind, d::timestamp AS "from", d::timestamp + INTERVAL 1 DAY AS "to" FROM e WHERE n = 0 UNION ALL SELECT id, 'my', date_trunc('month', d)::timestamp, date_trunc('month', d)::timestamp + INTERVAL 1 MONTH - INTERVAL 1 SECOND FROM e WHERE n IN (0, 2)
 UNION ALL SELECT id, 'mdy', d::timestamp, d::timestamp + INTERVAL 1 DAY FROM e WHERE n = 1 UNION ALL SELECT id, 'iso', d::timestamp, d::timestamp + INTERVAL 1 DAY FROM e WHERE n = 3
 UNION ALL SELECT id, 'season', make_timestamp(year(d), 12, 1, 0, 0, 0), make_timestamp(year(d) + 1, 2, 28, 0, 0, 0) FROM e WHERE n = 4 UNION ALL SELECT id, 'season', make_timestamp(year(d), 6, 1, 0, 0, 0), make_timestamp(year(d), 8, 28, 0, 0, 0) FROM e WHERE n = 4
 UNION ALL SELECT id, 'year', make_timestamp(year(d), 1, 1, 0, 0, 0), make_timestamp(year(d), 12, 31, 0, 0, 0) FROM e WHERE n = 5) SELECT * FROM r"""
)
def d13_query_dates(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    said = lambda f: F.date_format(d, f)
    text = (
        F.when(k % 7 == 0, F.concat(F.lit("met on "), said("d MMMM yyyy"), F.lit(" there")))
        .when(k % 7 == 1, F.concat(F.lit("before "), said("MMM d, yyyy")))
        .when(k % 7 == 2, F.concat(F.lit("in "), said("MMMM yyyy")))
        .when(k % 7 == 3, F.concat(F.lit("since "), said("yyyy-M-d"), F.lit(", 2020-13-45")))
        .when(k % 7 == 4, F.concat(F.lit("Winter "), said("yyyy"), F.lit(" and summer "), said("yyyy")))
        .when(k % 7 == 5, F.concat(F.lit("during "), said("yyyy"), F.lit(" and 31 February 2023x")))
        .otherwise("no date")
    )
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.explode(P.query_dates(text)).alias("r")).select("id", "r.*")


#: Tasks with their deadline at ``a`` and what is left as title.
TASKS = (
    ("tomorrow call home", "date_trunc('day', a) + INTERVAL 172799 SECOND", "call home"),
    ("in 4 days prepare the talk", "date_trunc('day', a) + INTERVAL 4 DAY + INTERVAL 86399 SECOND", "prepare the talk"),
    ("через 2 недели отчёт", "date_trunc('day', a) + INTERVAL 14 DAY + INTERVAL 86399 SECOND", "отчёт"),
    ("in 3 hours look again", "a + INTERVAL 3 HOUR", "look again"),
    ("by friday ship it", "date_trunc('day', a) + to_days(CASE WHEN isodow(a) < 5 THEN 5 - isodow(a) ELSE 12 - isodow(a) END::int) + INTERVAL 86399 SECOND", "ship it"),
    ("к пятнице сдать", "date_trunc('day', a) + to_days(CASE WHEN isodow(a) < 5 THEN 5 - isodow(a) ELSE 12 - isodow(a) END::int) + INTERVAL 86399 SECOND", "сдать"),
    ("2031-04-15 renew", "timestamp '2031-04-15 23:59:59'", "renew"),
    ("25 апреля выступить", "CASE WHEN a <= make_timestamp(year(a), 4, 25, 23, 59, 59) THEN make_timestamp(year(a), 4, 25, 23, 59, 59) ELSE make_timestamp(year(a) + 1, 4, 25, 23, 59, 59) END", "выступить"),
    ("May 5 pay", "CASE WHEN a <= make_timestamp(year(a), 5, 5, 23, 59, 59) THEN make_timestamp(year(a), 5, 5, 23, 59, 59) ELSE make_timestamp(year(a) + 1, 5, 5, 23, 59, 59) END", "pay"),
    ("just a title", "NULL", "just a title"),
)
_DUE = " ".join(f"WHEN {n} THEN {x}" for n, (_, x, _) in enumerate(TASKS))


@query(f"WITH o AS (SELECT o_orderkey AS id, o_orderkey % {len(TASKS)} AS n, o_orderdate::timestamp + to_hours((o_orderkey % 24)::bigint) AS a FROM orders) SELECT id, (CASE n {_DUE} END)::timestamp AS due, ({listed([t for *_, t in TASKS])})[(n + 1)::int] AS title FROM o")
def d18_deadlines(spark, sf_dir):
    k = F.col("o_orderkey")
    now = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + k % 24 * 3600)
    o = table(spark, sf_dir, "orders").select(k.alias("id"), P.deadline_and_title(M.pick(tuple(t for t, *_ in TASKS), k % len(TASKS)), now).alias("d"))
    return o.select("id", "d.due", "d.title")


_EN = "(({n})::varchar || ' {u}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END)"
_RU = "(({n})::varchar || ' ' || CASE WHEN {n} % 100 BETWEEN 11 AND 14 THEN '{c}' WHEN {n} % 10 = 1 THEN '{a}' WHEN {n} % 10 BETWEEN 2 AND 4 THEN '{b}' ELSE '{c}' END)"
_UNITS = {"year": ("год", "года", "лет"), "month": ("месяц", "месяца", "месяцев"), "week": ("неделя", "недели", "недель"), "day": ("день", "дня", "дней"), "hour": ("час", "часа", "часов"), "minute": ("минута", "минуты", "минут"), "second": ("секунда", "секунды", "секунд")}


def _human_sql(said) -> str:
    two = lambda n, u, m, v: f"{said(n, u)} || CASE WHEN {m} > 0 THEN ' ' || {said(m, v)} ELSE '' END"
    return (
        f"CASE WHEN d >= 365 THEN {two('(d // 365)', 'year', '(floor((d % 365) / 30.4375)::bigint)', 'month')} WHEN d >= 30 THEN {two('(floor(d / 30.4375)::bigint)', 'month', '(d - floor(floor(d / 30.4375) * 30.4375)::bigint)', 'day')}"
        f" WHEN d >= 7 THEN {two('(d // 7)', 'week', '(d % 7)', 'day')} WHEN d >= 1 THEN {two('d', 'day', '(r // 3600)', 'hour')} WHEN r >= 3600 THEN {two('(r // 3600)', 'hour', '(r % 3600 // 60)', 'minute')} WHEN r >= 60 THEN {said('(r // 60)', 'minute')} ELSE {said('r', 'second')} END"
    )


_HUMAN_EN = _human_sql(lambda n, u: _EN.format(n=n, u=u))
_HUMAN_RU = _human_sql(lambda n, u: _RU.format(n=n, a=_UNITS[u][0], b=_UNITS[u][1], c=_UNITS[u][2]))


@query(f"WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id * 7919 % 90000000 WHEN 1 THEN event_id * 7919 % 4000000 WHEN 2 THEN event_id * 31 % 90000 ELSE event_id % 130 END AS sec FROM events), p AS (SELECT event_id, sec, sec // 86400 AS d, sec % 86400 AS r FROM s) SELECT event_id, {_HUMAN_EN} AS english, {_HUMAN_RU} AS russian FROM p")
def d11_human_duration(spark, sf_dir):
    i = F.col("event_id")
    s = F.when(i % 4 == 0, i * 7919 % 90000000).when(i % 4 == 1, i * 7919 % 4000000).when(i % 4 == 2, i * 31 % 90000).otherwise(i % 130)
    return table(spark, sf_dir, "events").select("event_id", P.humanised(s).alias("english"), P.humanised(s, "ru").alias("russian"))


@query(
    """WITH n AS (SELECT unnest(range(6)) AS v), s AS (SELECT a.v AS s, b.v AS e FROM n a JOIN n b ON a.v < b.v), t AS (SELECT x.s AS xs, x.e AS xe, y.s AS ys, y.e AS ye, z.s AS zs, z.e AS ze FROM s x, s y, s z),
 k AS (SELECT CASE WHEN xe < ys THEN 'b' WHEN xe = ys THEN 'm' WHEN ye < xs THEN 'bi' WHEN ye = xs THEN 'mi' WHEN xs = ys AND xe = ye THEN 'eq' WHEN xs = ys AND xe < ye THEN 's' WHEN xs = ys THEN 'si' WHEN xe = ye AND xs > ys THEN 'f' WHEN xe = ye THEN 'fi' WHEN xs > ys AND xe < ye THEN 'd' WHEN xs < ys AND xe > ye THEN 'di' WHEN xs < ys THEN 'o' ELSE 'oi' END AS r1,
  CASE WHEN ye < zs THEN 'b' WHEN ye = zs THEN 'm' WHEN ze < ys THEN 'bi' WHEN ze = ys THEN 'mi' WHEN ys = zs AND ye = ze THEN 'eq' WHEN ys = zs AND ye < ze THEN 's' WHEN ys = zs THEN 'si' WHEN ye = ze AND ys > zs THEN 'f' WHEN ye = ze THEN 'fi' WHEN ys > zs AND ye < ze THEN 'd' WHEN ys < zs AND ye > ze THEN 'di' WHEN ys < zs THEN 'o' ELSE 'oi' END AS r2,
  CASE WHEN xe < zs THEN 'b' WHEN xe = zs THEN 'm' WHEN ze < xs THEN 'bi' WHEN ze = xs THEN 'mi' WHEN xs = zs AND xe = ze THEN 'eq' WHEN xs = zs AND xe < ze THEN 's' WHEN xs = zs THEN 'si' WHEN xe = ze AND xs > zs THEN 'f' WHEN xe = ze THEN 'fi' WHEN xs > zs AND xe < ze THEN 'd' WHEN xs < zs AND xe > ze THEN 'di' WHEN xs < zs THEN 'o' ELSE 'oi' END AS r3 FROM t)
 SELECT r1, r2, CASE WHEN count(DISTINCT r3) = 1 THEN min(r3) END AS relation FROM k GROUP BY r1, r2"""
)
def d8_allen_composition(spark, sf_dir):
    names = spark.createDataFrame([(x,) for x in ("eq", "s", "si", "f", "fi", "d", "di", "m", "mi", "o", "oi", "b", "bi")], "r1 string")
    return names.crossJoin(names.withColumnRenamed("r1", "r2")).select("r1", "r2", T.compose(F.col("r1"), F.col("r2")).alias("relation"))
