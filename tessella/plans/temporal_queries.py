"""Facts, intervals, dates, sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella import model as M
from tessella.operators import sequence as Q
from tessella.operators import temporal as T
from tessella.plans.registry import query
from tessella.session import table

R = M.rounded_sql
SCD = f"""{M.FACTS_SQL}, chg AS (SELECT *, lag(object) OVER (PARTITION BY subject, predicate ORDER BY valid_from, fact_id) AS before FROM facts),
 scd AS (SELECT fact_id, subject, predicate, object, valid_from, lead(valid_from) OVER (PARTITION BY subject, predicate ORDER BY valid_from, fact_id) AS valid_to,
 lead(fact_id) OVER (PARTITION BY subject, predicate ORDER BY valid_from, fact_id) AS superseded_by FROM chg WHERE before IS NULL OR before <> object)"""


def ts(s: str):
    return F.lit(s).cast("timestamp")


def scd(spark, sf_dir):
    return T.assert_facts(M.facts(spark, sf_dir))


@query(f"WITH {SCD} SELECT * FROM scd")
def d1_assert_facts(spark, sf_dir):
    return scd(spark, sf_dir)


@query(f"""WITH {SCD}, c AS (SELECT DISTINCT subject, predicate, object FROM scd WHERE valid_to IS NULL AND subject % 3 = 0)
 SELECT s.fact_id, s.subject, coalesce(s.valid_to, CASE WHEN c.subject IS NOT NULL AND timestamp '2002-01-01' >= s.valid_from THEN timestamp '2002-01-01' END) AS valid_to FROM scd s LEFT JOIN c ON c.subject = s.subject AND c.object = s.object""")
def d2_invalidate(spark, sf_dir):
    s = scd(spark, sf_dir)
    c = s.where("valid_to IS NULL AND subject % 3 = 0").select("subject", "predicate", "object").distinct().withColumn("closed_at", ts("2002-01-01"))
    return T.invalidate(s, c).select("fact_id", "subject", "valid_to")


@query(f"WITH {SCD} SELECT fact_id, subject, object FROM scd WHERE valid_from <= timestamp '1998-06-01' AND (valid_to IS NULL OR valid_to > timestamp '1998-06-01')")
def d3_query_at(spark, sf_dir):
    return T.at(scd(spark, sf_dir), ts("1998-06-01")).select("fact_id", "subject", "object")


@query(f"WITH {SCD} SELECT subject, object, valid_from, row_number() OVER (PARTITION BY subject ORDER BY valid_from, fact_id) AS n FROM scd")
def d4_timeline(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("subject").orderBy("valid_from", "fact_id")).cast("long")
    return scd(spark, sf_dir).select("subject", "object", "valid_from", n.alias("n"))


@query(f"""WITH {SCD}, a AS (SELECT subject, object FROM scd WHERE valid_from <= timestamp '1997-01-01' AND (valid_to IS NULL OR valid_to > timestamp '1997-01-01')),
 b AS (SELECT subject, object FROM scd WHERE valid_from <= timestamp '1999-01-01' AND (valid_to IS NULL OR valid_to > timestamp '1999-01-01'))
 SELECT coalesce(a.subject, b.subject) AS subject, a.object AS before, b.object AS after, CASE WHEN a.object IS NULL THEN 'added' WHEN b.object IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM a FULL JOIN b ON a.subject = b.subject WHERE a.object IS DISTINCT FROM b.object""")
def d5_diff(spark, sf_dir):
    return T.diff(scd(spark, sf_dir), ts("1997-01-01"), ts("1999-01-01")).select("subject", "before", "after", "change")


@query(f"WITH {SCD} SELECT count(*) AS total, count(*) FILTER (valid_to IS NULL) AS open, count(valid_to) AS closed, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects FROM scd")
def d6_facts_statistics(spark, sf_dir):
    return scd(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("valid_to").isNull()).alias("open"), F.count("valid_to").alias("closed"), F.count_distinct("subject").alias("subjects"), F.count_distinct("object").alias("objects"))


SPANS_SQL = "spans AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate::timestamp AS s, greatest(max(l_shipdate)::timestamp, o_orderdate::timestamp + INTERVAL 1 DAY) AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate)"
ALLEN_SQL = """CASE WHEN s1=s2 AND e1=e2 THEN 'eq' WHEN s1=s2 AND e1<e2 THEN 's' WHEN s1=s2 AND e1>e2 THEN 'si' WHEN e1=e2 AND s1>s2 THEN 'f' WHEN e1=e2 AND s1<s2 THEN 'fi' WHEN s1>s2 AND e1<e2 THEN 'd' WHEN s1<s2 AND e1>e2 THEN 'di'
 WHEN e1=s2 THEN 'm' WHEN s1=e2 THEN 'mi' WHEN s1<s2 AND e1>s2 THEN 'o' WHEN s1>s2 AND s1<e2 THEN 'oi' WHEN e1<s2 THEN 'b' ELSE 'bi' END"""


def spans(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    last = li.groupBy("l_orderkey").agg(F.max("l_shipdate").cast("timestamp").alias("last"))
    start = F.col("o_orderdate").cast("timestamp")
    return o.join(last, o.o_orderkey == last.l_orderkey).select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), start.alias("s"), F.greatest("last", start + F.expr("INTERVAL 1 DAY")).alias("e"))


@query(f"WITH {SPANS_SQL}, p AS (SELECT a.k AS k1, b.k AS k2, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2 FROM spans a JOIN spans b ON a.c = b.c AND a.k < b.k) SELECT k1, k2, {ALLEN_SQL} AS relation FROM p")
def d7_allen_relation(spark, sf_dir):
    s = spans(spark, sf_dir)
    a, b = s.select("c", *(F.col(x).alias(f"{x}1") for x in "kse")), s.select("c", *(F.col(x).alias(f"{x}2") for x in "kse"))
    return a.join(b, "c").where("k1 < k2").select("k1", "k2", T.allen(*(F.col(x) for x in ("s1", "e1", "s2", "e2"))).alias("relation"))


@query(f"WITH {SPANS_SQL} SELECT k, floor(epoch(e - s) / 86400)::bigint AS days, floor(floor(epoch(e - s) / 86400) / 7)::bigint AS weeks FROM spans")
def d9_durations(spark, sf_dir):
    d = T.whole_days(F.col("s"), F.col("e"))
    return spans(spark, sf_dir).select("k", d.alias("days"), F.floor(d / 7).alias("weeks"))


MONTHS = "((year(e) - year(s)) * 12 + month(e) - month(s))"


@query(f"WITH {SPANS_SQL}, m AS (SELECT k, {MONTHS} - CASE WHEN s + to_months({MONTHS}::int) > e THEN 1 ELSE 0 END AS months FROM spans) SELECT k, months::bigint AS months, floor(months / 12)::bigint AS years FROM m")
def d10_whole_months(spark, sf_dir):
    m = T.whole_months(F.col("s"), F.col("e")).cast("long")
    return spans(spark, sf_dir).select("k", m.alias("months"), F.floor(m / 12).alias("years"))


@query(f"WITH {M.RECORDS_SQL} SELECT id, {R(f'greatest(0.0, 1.0 - floor(epoch(timestamp {chr(39)}{M.AS_OF}{chr(39)} - created_at) / 86400) / 180.0)')} AS proximity FROM records")
def d17_date_proximity(spark, sf_dir):
    r = M.records(spark, sf_dir)
    return r.select("id", M.rounded(T.proximity(T.whole_days(F.lit(M.AS_OF).cast("timestamp"), F.col("created_at")))).alias("proximity"))


@query("""WITH p AS (SELECT event_id, ts AS s1, ts + INTERVAL 1 HOUR AS e1 FROM events), q AS (SELECT o_orderkey AS k, timestamp '2024-01-01' + to_hours((o_orderkey % 720)::bigint) AS s2 FROM orders WHERE o_orderstatus = 'P')
 SELECT event_id, count(*) AS hits FROM p JOIN q ON s1 <= s2 + INTERVAL 30 MINUTE AND e1 >= s2 GROUP BY event_id""")
def j12_interval_overlap_join(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("s1"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("e1"))
    s2 = F.timestamp_seconds(F.unix_timestamp(ts("2024-01-01")) + F.col("o_orderkey") % 720 * 3600)
    q = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"), s2.alias("s2")).withColumn("e2", F.col("s2") + F.expr("INTERVAL 30 MINUTES"))
    return T.overlap_counts(p, q, "event_id", 3600).withColumnRenamed("n", "hits")


@query("""WITH v AS (SELECT user_id, ts AS at, event_id AS last_error FROM events WHERE event_type = 'error')
 SELECT e.event_id, arg_max(v.last_error, (v.at, v.last_error)) AS last_error FROM events e LEFT JOIN v ON v.user_id = e.user_id AND v.at <= e.ts WHERE e.event_type = 'purchase' GROUP BY e.event_id""")
def j13_as_of_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    errors = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("last_error")).orderBy("at", "last_error")
    return T.as_of_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), errors, "user_id", "ts", "at", "last_error").select("event_id", "last_error")


@query(f"""WITH {M.RECORDS_SQL}, r AS (SELECT id, session_id, lag(id, 1) OVER w AS before1, lag(id, 2) OVER w AS before2, lead(id, 1) OVER w AS after1, lead(id, 2) OVER w AS after2 FROM records WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id)) SELECT * FROM r""")
def j14_neighbours_in_time(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    return M.records(spark, sf_dir).select("id", "session_id", *(f("id", n).over(w).alias(f"{name}{n}") for name, f in (("before", F.lag), ("after", F.lead)) for n in (1, 2)))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000 THEN 1 ELSE 0 END AS b FROM events),
 s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
 SELECT user_id, session::bigint AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session""")
def w3_sessions(spark, sf_dir):
    s = Q.sessionise(table(spark, sf_dir, "events"), "user_id", "ts", 3600, "event_id")
    return s.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE UNBOUNDED PRECEDING) AS ordinal FROM orders")
def w4_session_ordinal(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate").rangeBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.count(F.lit(1)).over(w).alias("ordinal"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def w6_newest_per_group(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf_dir, "events").withColumn("n", n).where("n <= 20").select("user_id", "event_id")


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 86400000000 THEN 1 ELSE 0 END AS b FROM events),
 s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
 SELECT event_id, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS streak FROM s""")
def w7_touch_counter(spark, sf_dir):
    return Q.streaks(table(spark, sf_dir, "events"), "user_id", "ts", 86400, "event_id").select("event_id", F.col("streak").cast("long").alias("streak"))


@query("SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations QUALIFY next_turn IS NOT NULL AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3")
def w8_adjacent_pairs(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lead("turn").over(w).alias("next_turn"), F.row_number().over(w).alias("n"))
    return c.where("next_turn IS NOT NULL AND n <= 3").drop("n")


@query("SELECT conv_id, arg_max(text, turn) AS last_text, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id")
def w9_latest_row(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_text"), F.max("turn").alias("turn"))


@query(f"""WITH RECURSIVE {M.RECORDS_SQL}, c(id, last, steps) AS (SELECT id, id, 0 FROM records UNION ALL SELECT c.id, r.superseded_by, c.steps + 1 FROM c JOIN records r ON r.id = c.last AND r.superseded_by IS NOT NULL WHERE c.steps < 100)
 SELECT id, arg_max(last, steps) AS last, max(steps) AS steps FROM c GROUP BY id""")
def w10_version_chain(spark, sf_dir):
    return Q.version_chain(M.records(spark, sf_dir))


@query("""WITH e AS (SELECT *, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS error_id FROM events) SELECT event_id, error_id FROM e WHERE event_type = 'purchase'""")
def y26_error_fix_pairs(spark, sf_dir):
    return Q.error_fix_pairs(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "error", "purchase").select("event_id", "error_id")


_FOLD = "list_reduce(list_prepend(0.5::double, list_transform(l, lambda e: CASE e WHEN 'purchase' THEN 0.02 WHEN 'signup' THEN 0.01 WHEN 'view' THEN 0.005 WHEN 'error' THEN -0.01 ELSE 0.0 END::double)), lambda a, d: floor(greatest(0.0, least(1.0, a + d)) * 10000 + 0.5) / 10000)"


@query(f"SELECT user_id, {_FOLD} AS level FROM (SELECT user_id, list(event_type ORDER BY ts, event_id) AS l FROM events GROUP BY user_id)")
def a14_competency_fold(spark, sf_dir):
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda s: s["event_type"])
    per_user = table(spark, sf_dir, "events").groupBy("user_id").agg(ordered.alias("l"))
    return per_user.select("user_id", Q.clamped_fold(F.col("l"), 0.5, {"purchase": 0.02, "signup": 0.01, "view": 0.005, "error": -0.01}).alias("level"))
