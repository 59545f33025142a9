"""Queries of answers, competency, predictors, bundles, bridges, phases, listings and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella import model as M
from tessella.operators import answers as W
from tessella.operators import phrases as P
from tessella.operators import reports as Z
from tessella.plans.registry import query
from tessella.plans.rule_queries import listed, probe, probe_sql
from tessella.session import table

R = M.rounded_sql
REC = M.RECORDS_SQL
AS_OF = f"timestamp '{M.AS_OF}'"


def rec(spark, sf_dir):
    return M.records(spark, sf_dir)


def as_of():
    return F.lit(M.AS_OF).cast("timestamp")


# --- answers -----------------------------------------------------------------------------------------

GOLDS = ("Berlin", "no information", "She moved to Rome in May", "", "blue, green")
ANSWERS = ("She lives in Berlin", "I don't know", "Berlin!", "That is not mentioned anywhere", "she moved to rome in may", "Blue green", "Paris", "unknown", "No evidence of that", "Berl")


@query(
    "WITH d AS (SELECT doc_id AS id, " + probe_sql(ANSWERS, "doc_id") + " AS a, " + probe_sql(GOLDS, "(doc_id // 10)") + r""" AS g, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE 1 END AS r, (doc_id * 7 % 100) / 100.0 AS f FROM documents),
 n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(a), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS na, trim(regexp_replace(regexp_replace(lower(g), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS ng, regexp_matches(a, '(?i)\b(not (mentioned|stated|provided)|no (information|evidence)|i (don''t|do not) (know|have)|unknown|unclear)\b') AS ref, g = '' OR regexp_matches(g, '(?i)\b(no information|unknown|none)\b') AS none FROM d)
 SELECT id, CASE WHEN r = 0 THEN 'retrieval_miss' WHEN ref AND NOT none THEN 'over_cautious' WHEN na <> '' AND ng <> '' AND (na = ng OR ((contains(na, ng) OR contains(ng, na)) AND least(length(na), length(ng)) * 2 >= greatest(length(na), length(ng)))) THEN 'format_drift' WHEN f >= 0.6 THEN 'judge_disagree' WHEN NOT ref THEN 'hallucination' ELSE 'unknown' END AS bucket FROM n"""
)
def a34_failure_buckets(spark, sf_dir):
    i = F.col("doc_id")
    retrieved, f1 = F.when(i % 9 == 0, 0).otherwise(1), i * 7 % 100 / 100.0
    kind = W.failure_kind(probe(ANSWERS, i), probe(GOLDS, F.floor(i / 10)), retrieved, f1, F.lit(0.0))
    return table(spark, sf_dir, "documents").select(i.alias("id"), kind.alias("bucket"))


@query("WITH r AS (SELECT doc_id AS question, 'g' || doc_id % 3 AS gold, doc_id % 4 <> 0 AS was, doc_id % 5 <> 0 AS now FROM documents) SELECT question, gold, CASE WHEN now THEN 'gain' ELSE 'regression' END AS change FROM r WHERE was <> now")
def a34_run_difference(spark, sf_dir):
    i = F.col("doc_id")
    run = lambda n: table(spark, sf_dir, "documents").select(i.alias("question"), F.concat(F.lit("g"), (i % 3).cast("string")).alias("gold"), (i % n != 0).alias("correct"))
    return W.run_difference(run(4), run(5))


@query("WITH g AS (SELECT user_id, avg(value) FILTER (ts < timestamp '2024-01-15') / 100 AS b, avg(value) FILTER (ts >= timestamp '2024-01-15') / 100 AS c, count(*) FILTER (ts < timestamp '2024-01-15') AS sl, count(*) FILTER (ts >= timestamp '2024-01-15') AS nw FROM events GROUP BY user_id) SELECT user_id, CASE WHEN c - b >= -0.01 THEN 'PASS' ELSE 'FAIL' END AS verdict, sl > 0 AND nw - sl >= sl * 0.25 AS warning FROM g WHERE b IS NOT NULL AND c IS NOT NULL")
def a35_regression_gate(spark, sf_dir):
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp")
    g = table(spark, sf_dir, "events").groupBy("user_id").agg((F.avg(F.when(~late, F.col("value"))) / 100).alias("b"), (F.avg(F.when(late, F.col("value"))) / 100).alias("c"), F.count_if(~late).alias("sl"), F.count_if(late).alias("nw"))
    out = g.where("b IS NOT NULL AND c IS NOT NULL").select("user_id", W.gate(F.col("b"), F.col("c"), F.col("sl"), F.col("nw")).alias("g"))
    return out.select("user_id", "g.verdict", "g.warning")


_NLI = "n AS (SELECT doc_id AS id, (doc_id * 7 % 100) / 100.0::double AS e, (doc_id * 13 % 100) / 100.0::double AS u, (doc_id * 31 % 100) / 100.0::double AS c FROM documents)"
_STRICT = "CASE WHEN c > 0.6 THEN 'contradict' WHEN e >= 0.5 AND e >= u AND e >= c THEN 'entail' ELSE 'neutral' END"


def nli(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(i.alias("id"), (i * 7 % 100 / 100.0).alias("e"), (i * 13 % 100 / 100.0).alias("u"), (i * 31 % 100 / 100.0).alias("c"))


@query(f"WITH {_NLI} SELECT id, {_STRICT} AS strict, CASE WHEN c >= 0.4 AND c - e >= 0 THEN 'contradict' WHEN e >= 0.65 AND e >= u AND e >= c THEN 'entail' ELSE 'neutral' END AS calibrated FROM n")
def r41_verifier_decision(spark, sf_dir):
    three = tuple(F.col(c) for c in "euc")
    return nli(spark, sf_dir).select("id", W.verified(*three).alias("strict"), W.verified(*three, W.CALIBRATED).alias("calibrated"))


CATEGORIES = ("single-hop", "multi-hop", "Temporal", "open-domain", "adversarial", "other")


@query(
    f"WITH {_NLI}, v AS (SELECT *, {_STRICT} AS d, " + probe_sql(CATEGORIES, "id") + """ AS cat, (id * 17 % 100) / 100.0::double AS p, id % 3 <> 0 AS ans, id % 5 < 2 AS part, id % 4 AS rounds, id % 29 = 0 AS contra FROM n),
 t AS (SELECT *, CASE lower(cat) WHEN 'single-hop' THEN 0.4 WHEN 'multi-hop' THEN 0.5 WHEN 'temporal' THEN 0.45 WHEN 'open-domain' THEN 0.4 WHEN 'adversarial' THEN 0.7 ELSE 0.45 END::double AS t FROM v)
 SELECT id, CASE WHEN d = 'contradict' AND c >= 0.7 THEN 'idk' WHEN contra THEN 'idk' WHEN ans AND p >= t THEN 'answer' WHEN part AND p >= t * 0.7 THEN 'answer_with_caveat' WHEN cat = 'open-domain' AND ans AND p >= t * 0.5 AND p < t THEN 'hybrid' WHEN rounds < 3 THEN 'search_more' ELSE 'idk' END AS action FROM t"""
)
def r39_answer_routing(spark, sf_dir):
    i = F.col("id")
    n = nli(spark, sf_dir)
    action = W.route(W.verified(F.col("e"), F.col("u"), F.col("c")), F.col("c"), i % 29 == 0, i * 17 % 100 / 100.0, probe(CATEGORIES, i), i % 3 != 0, i % 5 < 2, i % 4, F.lit(3))
    return n.select("id", action.alias("action"))


# --- competency, prediction, deadlines ---------------------------------------------------------------

_COMP = "co AS (SELECT p_partkey % 50 AS k, avg(p_retailprice) / 2000 AS level, count(*) / 100.0::double AS confidence FROM part WHERE p_partkey % 50 < 40 GROUP BY 1), qs AS (SELECT n_nationkey AS qid, unnest([n_nationkey, n_nationkey + 10, n_nationkey * 2, 45 + n_nationkey % 5]) AS k FROM nation), sp AS (SELECT o_orderkey AS id, o_custkey % 60 AS k FROM orders WHERE o_orderkey % 40 = 1)"


@query(f"WITH {_COMP}, kn AS (SELECT qid, avg(level) AS level, avg(confidence) AS confidence FROM qs LEFT JOIN co USING (k) GROUP BY qid), bl AS (SELECT qid, count(DISTINCT id) AS spots FROM qs JOIN sp USING (k) GROUP BY qid) SELECT qid, {R('coalesce(level, 0.5)', 3)} AS level, {R('coalesce(confidence, 0)', 3)} AS confidence, coalesce(spots, 0) AS spots, CASE WHEN level IS NULL THEN 'Unknown' WHEN level > 0.8 THEN 'Strong' WHEN level > 0.5 THEN 'Moderate' ELSE 'Weak' END AS note FROM kn LEFT JOIN bl USING (qid)")
def a16_competency_assess(spark, sf_dir):
    k, n = F.col("p_partkey") % 50, F.col("n_nationkey").cast("long")
    co = table(spark, sf_dir, "part").where(k < 40).groupBy(k.alias("domain")).agg((F.avg("p_retailprice") / 2000).alias("level"), (F.count(F.lit(1)) / 100.0).alias("confidence"))
    qs = table(spark, sf_dir, "nation").select(n.alias("qid"), F.explode(F.array(n, n + 10, n * 2, 45 + n % 5)).alias("concept"))
    sp = table(spark, sf_dir, "orders").where("o_orderkey % 40 = 1").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 60).alias("domain"))
    return Z.assess(qs, co, sp)


@query(f"""WITH RECURSIVE o AS (SELECT user_id AS domain, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events WHERE event_type IN ('purchase', 'error')),
 f(domain, n, c, level, trend) AS (SELECT domain, n, c, CASE WHEN ok THEN 0.5 ELSE 0.3 END::double, 'unknown' FROM o WHERE n = 1 UNION ALL SELECT o.domain, o.n, o.c, greatest(0.0, least(1.0, level + CASE WHEN ok THEN 0.02 ELSE -0.03 END))::double,
  CASE WHEN greatest(0.0, least(1.0, level + CASE WHEN ok THEN 0.02 ELSE -0.03 END))::double - level > 0.01 THEN 'improving' WHEN greatest(0.0, least(1.0, level + CASE WHEN ok THEN 0.02 ELSE -0.03 END))::double - level < -0.01 THEN 'declining' WHEN greatest(0.0, least(1.0, level + CASE WHEN ok THEN 0.02 ELSE -0.03 END))::double < 0.3 THEN 'stable_low' ELSE 'stable' END FROM f JOIN o ON o.domain = f.domain AND o.n = f.n + 1)
 SELECT domain, {R('level')} AS level, {R('least(1.0, 0.3 + 0.01 * (c - 1))')} AS confidence, c AS n, trend FROM f WHERE n = c""")
def a39_competency_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    out = Z.competency_fold(e.select(F.col("user_id").alias("domain"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok")))
    return out.select("domain", M.rounded(F.col("level")).alias("level"), M.rounded(F.col("confidence")).alias("confidence"), F.col("n").cast("long").alias("n"), "trend")


@query(f"""WITH {REC}, r AS (SELECT project, created_at FROM records WHERE status = 'active'), d AS (SELECT project, count(*) AS n FROM r WHERE created_at > {AS_OF} - INTERVAL 30 DAY AND isodow(created_at) = isodow({AS_OF}) GROUP BY project), l AS (SELECT project, count(*) AS n FROM r WHERE created_at > {AS_OF} - INTERVAL 3 DAY GROUP BY project ORDER BY n DESC, project LIMIT 10),
 s AS (SELECT project, 0.4 * n / max(n) OVER () AS s FROM d UNION ALL SELECT project, 0.35 * n / max(n) OVER () FROM l), t AS (SELECT project, sum(s)::double AS s FROM s GROUP BY project) SELECT project, {R("least(1.0, s + CASE WHEN project IN ('src1', 'src2') THEN 0.25 ELSE 0 END)")} AS score FROM t""")
def a29_next_project(spark, sf_dir):
    due = spark.createDataFrame([("src1",), ("src2",), ("src1",)], "project string")
    return Z.next_project(rec(spark, sf_dir), due, as_of()).select("project", M.rounded(F.col("score")).alias("score"))


@query(f"""WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'open' END AS status, {AS_OF} - to_hours((o_orderkey * 7 % 2000)::bigint) AS updated, CASE WHEN o_orderkey % 5 <> 0 THEN {AS_OF} + to_hours((o_orderkey % 200 - 40)::bigint) END AS due FROM orders WHERE o_orderkey % 20 < 4 AND o_orderkey < 3000),
 v AS (SELECT count(*) FILTER (status = 'done' AND updated > {AS_OF} - INTERVAL 14 DAY) / 14.0::double AS v FROM t) SELECT id, {R(f'epoch(due - {AS_OF}) / 86400')} AS days, (epoch(due - {AS_OF}) / 86400 < 1) OR (epoch(due - {AS_OF}) / 86400 < 2 AND v < 1) AS risk FROM t, v WHERE status <> 'done' AND due >= {AS_OF}""")
def a31_deadline_velocity(spark, sf_dir):
    k = F.col("o_orderkey")
    at = lambda h: F.timestamp_seconds(F.unix_timestamp(as_of()) + h * 3600)
    t = table(spark, sf_dir, "orders").where("o_orderkey % 20 < 4 AND o_orderkey < 3000").select(k.alias("id"), F.when(k % 3 == 0, "done").otherwise("open").alias("status"), at(-(k * 7 % 2000)).alias("updated_at"), F.when(k % 5 != 0, at(k % 200 - 40)).alias("deadline"))
    return Z.deadlines(t, as_of()).select("id", M.rounded(F.col("days")).alias("days"), "risk")


@query(f"WITH t AS (SELECT o_orderkey AS id, o_orderdate AS due, o_orderkey % 4 AS rec, o_orderstatus AS st FROM orders) SELECT id, CASE WHEN st <> 'F' AND due < timestamp '1998-01-01' THEN 'overdue' WHEN st <> 'F' AND due >= timestamp '1998-01-01' AND due <= timestamp '1998-01-08' THEN 'upcoming' ELSE 'other' END AS state, CASE WHEN st = 'F' AND rec = 1 THEN due + INTERVAL 1 DAY WHEN st = 'F' AND rec = 2 THEN due + INTERVAL 7 DAY WHEN st = 'F' AND rec = 3 THEN due + INTERVAL 1 MONTH END::timestamp AS next_due FROM t")
def d19_task_states(spark, sf_dir):
    """Overdue and coming tasks, and when a finished daily, weekly or monthly task is due again."""
    ts = lambda s: F.lit(s).cast("timestamp")
    due, open_, every = F.col("o_orderdate").cast("timestamp"), F.col("o_orderstatus") != "F", F.col("o_orderkey") % 4
    state = F.when(open_ & (due < ts("1998-01-01")), "overdue").when(open_ & (due <= ts("1998-01-08")), "upcoming").otherwise("other")
    again = F.when(every == 1, due + F.expr("INTERVAL 1 DAY")).when(every == 2, due + F.expr("INTERVAL 7 DAYS")).when(every == 3, F.add_months(due.cast("date"), 1).cast("timestamp"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), state.alias("state"), F.when(~open_, again).alias("next_due"))


DATED = ("met on 2023-05-06 and in March 2024", "nothing", "spring 2022 then", "[3:05 pm on 7 June, 2023] said hello")
DATE_TAGS = ("2023-04", "2022", "Q2-2021", "x")


@query(
    "WITH r AS (SELECT doc_id AS id, doc_id % 4 AS c, (doc_id // 4) % 4 AS t FROM documents) SELECT id, CASE c WHEN 0 THEN timestamp '2023-05-06' WHEN 2 THEN timestamp '2022-03-01' WHEN 3 THEN timestamp '2023-06-07 15:05:00' ELSE CASE t WHEN 0 THEN timestamp '2023-04-01' WHEN 1 THEN timestamp '2022-01-01' WHEN 2 THEN timestamp '2021-04-01' END END AS ts_from,"
    " CASE c WHEN 0 THEN timestamp '2024-03-31 23:59:59' WHEN 2 THEN timestamp '2022-05-28' WHEN 3 THEN timestamp '2023-06-07 16:05:00' ELSE CASE t WHEN 0 THEN timestamp '2023-04-30 23:59:59' WHEN 1 THEN timestamp '2022-12-31 23:59:59' WHEN 2 THEN timestamp '2021-06-30 23:59:59' END END AS ts_to,"
    " CASE c WHEN 0 THEN 'content_regex' WHEN 2 THEN 'content_regex' WHEN 3 THEN 'entry_prefix' ELSE CASE WHEN t < 3 THEN 'tag' END END AS source FROM r"
)
def d16_index_record_dates(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(i.alias("id"), probe(DATED, i).alias("content"), F.array(probe(DATE_TAGS, F.floor(i / 4))).alias("tags"))
    return d.select("id", P.record_range(F.col("content"), F.col("tags")).alias("r")).select("id", F.col("r.from").alias("ts_from"), F.col("r.to").alias("ts_to"), F.col("r.source").alias("source"))


# --- bundles, warnings, bridges ----------------------------------------------------------------------


@query(f"WITH {REC}, s AS (SELECT id % 5 AS qid, ['knowledge', 'episodes', 'skills', 'rules', 'meta'][(id % 7 % 5 + 1)::int] AS section, id, confidence AS score, least(n_chars, 900) AS size FROM records WHERE status = 'active'), u AS (SELECT *, sum(greatest(1, size // 4)) OVER (PARTITION BY qid, section ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM s) SELECT qid, section, id, used::bigint AS used FROM u WHERE used <= CASE section WHEN 'knowledge' THEN 1600 WHEN 'episodes' THEN 800 WHEN 'skills' THEN 600 WHEN 'rules' THEN 600 ELSE 400 END")
def r45_context_bundle(spark, sf_dir):
    i = F.col("id")
    s = rec(spark, sf_dir).where("status = 'active'").select((i % 5).alias("qid"), M.pick(tuple(Z.SHARES), i % 7 % 5).alias("section"), "id", F.col("confidence").alias("score"), F.least("n_chars", F.lit(900)).alias("size"))
    return Z.bundle(s).withColumn("used", F.col("used").cast("long"))


_LAYERS = f"""l AS (SELECT id, 0 AS layer, n_chars, row_number() OVER (ORDER BY recall_count DESC, id) AS n FROM records WHERE status = 'active' UNION ALL SELECT id, 1, n_chars, row_number() OVER (ORDER BY confidence DESC, id) FROM records WHERE status = 'active' AND type = 'convention' UNION ALL SELECT id, 2, n_chars, row_number() OVER (ORDER BY created_at DESC, id) FROM records WHERE status = 'active' AND type = 'decision' AND created_at >= {AS_OF} - INTERVAL 7 DAY)"""


@query(f"WITH {REC}, {_LAYERS}, t AS (SELECT *, sum(least(n_chars, 300)) OVER (ORDER BY layer, n ROWS UNBOUNDED PRECEDING) AS used FROM l WHERE n <= 10) SELECT layer, id, used::bigint AS used FROM t WHERE used <= 5000")
def r47_layered_start_up(spark, sf_dir):
    """The ten most recalled, the ten surest conventions, the decisions of a week: together within a budget."""
    r = rec(spark, sf_dir).where("status = 'active'")
    layer = lambda d, n, order: d.orderBy(*order).limit(10).select("id", F.lit(n).alias("layer"), F.least("n_chars", F.lit(300)).alias("size"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("n"))
    week = F.col("created_at") >= as_of() - F.expr("INTERVAL 7 DAYS")
    every = layer(r, 0, [F.desc("recall_count"), "id"]).unionByName(layer(r.where("type = 'convention'"), 1, [F.desc("confidence"), "id"])).unionByName(layer(r.where((F.col("type") == "decision") & week), 2, [F.desc("created_at"), "id"]))
    used = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("layer", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # thirty rows at most
    return every.withColumn("used", used).where("used <= 5000").select("layer", "id", F.col("used").cast("long").alias("used"))


@query(f"""WITH {REC}, w AS (SELECT id, created_at, CASE WHEN id % 10 = 1 THEN content || ' see src/app/main.py now' WHEN id % 10 = 2 THEN content || ' main.py' WHEN id % 10 = 3 THEN content || ' amain.pyc' ELSE content END AS c, CASE WHEN id % 10 = 4 THEN 'file:src/app/main.py' WHEN id % 10 = 5 THEN 'util.go' ELSE 'tag' END AS tag FROM records),
 h AS (SELECT 'src/app/main.py' AS path, id, created_at FROM w WHERE id % 10 IN (1, 2, 4) UNION ALL SELECT 'lib\\Util.go', id, created_at FROM w WHERE id % 10 = 5) SELECT path, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY created_at DESC, id) AS rank FROM h) WHERE rank <= 5""")
def r46_file_warnings(spark, sf_dir):
    i = F.col("id")
    more = F.when(i % 10 == 1, " see src/app/main.py now").when(i % 10 == 2, " main.py").when(i % 10 == 3, " amain.pyc").otherwise("")
    r = rec(spark, sf_dir).select("id", "created_at", F.concat("content", more).alias("content"), F.array(F.when(i % 10 == 4, "file:src/app/main.py").when(i % 10 == 5, "util.go").otherwise("tag")).alias("tags"))
    return Z.file_warnings(spark.createDataFrame([("src/app/main.py",), ("lib\\Util.go",)], "path string"), r)


@query("""WITH nd AS (SELECT p_partkey AS node, p_name AS name FROM part), e AS (SELECT ps AS source, t AS target, ['uses', 'part_of'][(ps % 2 + 1)::int] AS relation, (ps * 13 % 100 + t % 7)::double AS weight FROM (SELECT DISTINCT l_partkey AS ps, (l_partkey * 3 + l_suppkey) % 200 AS t FROM lineitem)),
 k AS (SELECT n_nationkey AS qid, (SELECT substring(p_name, 1, 5) FROM part WHERE p_partkey = n_nationkey * 7) AS s, ['use', lower((SELECT substring(p_name, 1, 4) FROM part WHERE p_partkey = n_nationkey * 3))] AS a FROM nation),
 f AS (SELECT qid, a, node, lower(name) AS name, row_number() OVER (PARTITION BY qid ORDER BY lower(name), node) AS n FROM k JOIN nd ON starts_with(lower(name), lower(s))), o AS (SELECT f.qid, a, e.*, row_number() OVER (PARTITION BY f.qid ORDER BY weight DESC, source, relation, target) AS n2 FROM f JOIN e ON e.source = f.node WHERE f.n <= 5),
 s AS (SELECT qid, source, relation, target, weight, list_sum(list_transform(a, lambda x: CASE WHEN contains(relation, x) THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(nd.name), x) THEN 1.0 ELSE 0 END))::double AS score FROM o JOIN nd ON nd.node = o.target WHERE n2 <= 100)
 SELECT qid, source, relation, target, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, weight DESC, source, relation, target) AS rank FROM s) WHERE rank <= 12""")
def r35_subject_predicate(spark, sf_dir):
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    nodes = p.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"))
    pair = li.select(F.col("l_partkey").alias("source"), ((F.col("l_partkey") * 3 + F.col("l_suppkey")) % 200).alias("target")).distinct()
    edges = pair.select("source", "target", M.pick(("uses", "part_of"), F.col("source") % 2).alias("relation"), (F.col("source") * 13 % 100 + F.col("target") % 7).cast("double").alias("weight"))
    k = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("qid"))
    head = lambda n, c, name: p.select((F.col("p_partkey") / n).alias("qid"), F.substring("p_name", 1, c).alias(name)).where("qid = floor(qid)").withColumn("qid", F.col("qid").cast("long"))
    keys = k.join(head(7, 5, "subject"), "qid").join(head(3, 4, "a"), "qid").select("qid", "subject", F.array(F.lit("use"), F.lower("a")).alias("actions"))
    return Z.triples_of(keys, nodes, edges)


@query(
    f"""WITH {REC}, s AS (SELECT id, project, list_filter(list_distinct(list_concat(tags, ['solution', 'k' || id % 4, 'm' || id % 3])), lambda t: t NOT IN ('solution', 'auto', 'reusable')) AS tags, list_filter(list_distinct(regexp_extract_all(lower(content), '[a-z_]{{3,}}')), lambda w: NOT list_contains({listed(('the', 'are', 'was', 'for', 'with', 'and', 'not', 'this', 'that', 'from', 'but', 'has', 'had', 'have', 'you', 'use', 'using', 'used', 'can', 'will', 'were'))}, w)) AS w FROM records WHERE status = 'active' AND type = 'solution'),
 p AS (SELECT least(a.project, b.project) AS project_a, greatest(a.project, b.project) AS project_b, list_sort(list_intersect(a.tags, b.tags)) AS tags, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM s a JOIN s b ON a.project <> b.project AND a.id < b.id)
 SELECT DISTINCT project_a, project_b, CASE WHEN len(tags) = 0 THEN 'keyword-match' ELSE array_to_string(tags, ',') END AS tags FROM p WHERE len(tags) >= 2 OR (i > 0 AND i > 0.3 * (n - i))"""
)
def y5_pattern_bridge(spark, sf_dir):
    i = F.col("id")
    tags = F.concat("tags", F.array(F.lit("solution"), F.concat(F.lit("k"), (i % 4).cast("string")), F.concat(F.lit("m"), (i % 3).cast("string"))))
    return Z.pattern_bridge(rec(spark, sf_dir).where("status = 'active' AND type = 'solution'").withColumn("tags", tags))


@query("""WITH RECURSIVE l AS (SELECT conv_id AS task, (conv_id % 4 + 1)::int AS level, turn AS seq, ['plan', 'creative', 'build', 'reflect', 'archive', 'van', 'zzz'][((turn * 3 + conv_id) % 7 + 1)::int] AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations),
 p AS (SELECT 1 AS level, ['van', 'build', 'reflect', 'archive'] AS p UNION ALL SELECT 2, ['van', 'plan', 'build', 'reflect', 'archive'] UNION ALL SELECT 3, ['van', 'plan', 'creative', 'build', 'reflect', 'archive'] UNION ALL SELECT 4, ['van', 'plan', 'creative', 'build', 'reflect', 'archive']),
 f(task, n, pos, no) AS (SELECT DISTINCT task, 0::bigint, 0, 0 FROM l UNION ALL SELECT f.task, l.n, CASE WHEN p.p[f.pos + 2] = l.w THEN f.pos + 1 ELSE f.pos END, CASE WHEN p.p[f.pos + 2] = l.w THEN f.no ELSE f.no + 1 END FROM f JOIN l ON l.task = f.task AND l.n = f.n + 1 JOIN p ON p.level = l.level)
 SELECT f.task, p.p[f.pos + 1] AS phase, f.pos + 1 AS entered, f.no AS rejected FROM f JOIN (SELECT DISTINCT task, level, c FROM l) k ON k.task = f.task AND k.c = f.n JOIN p ON p.level = k.level""")
def z9_y38_task_phases(spark, sf_dir):
    k, t = F.col("conv_id"), F.col("turn")
    wanted = M.pick(("plan", "creative", "build", "reflect", "archive", "van", "zzz"), (t * 3 + k) % 7)
    return Z.phases(table(spark, sf_dir, "conversations").select(k.alias("task"), (k % 4 + 1).cast("int").alias("level"), t.alias("seq"), wanted.alias("wanted")))


# --- composition -------------------------------------------------------------------------------------

_MEM = "mem AS (SELECT n_nationkey AS qid, doc_id AS id, text AS content FROM nation JOIN documents ON doc_id % 25 = n_nationkey WHERE doc_id < 200), con AS (SELECT n_nationkey AS qid, unnest(['The', 'tag' || n_nationkey % 3, 'die', 'xx']) AS concept FROM nation), nam AS (SELECT doc_id AS id, 'TAG' || doc_id % 3 AS name FROM documents WHERE doc_id % 2 = 0), li AS (SELECT DISTINCT m.qid, m.id, concept FROM mem m JOIN nam USING (id) JOIN con ON con.qid = m.qid AND lower(con.concept) = lower(nam.name)), cov AS (SELECT * FROM li UNION ALL SELECT m.qid, m.id, concept FROM mem m JOIN con ON con.qid = m.qid AND contains(lower(m.content), lower(concept)) WHERE NOT EXISTS (SELECT 1 FROM li WHERE li.qid = m.qid AND li.id = m.id))"


def covered(spark, sf_dir):
    d, n = table(spark, sf_dir, "documents"), table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("qid"))
    mem = d.where("doc_id < 200").select((F.col("doc_id") % 25).alias("qid"), F.col("doc_id").alias("id"), F.col("text").alias("content")).join(n, "qid", "left_semi")
    con = n.select("qid", F.explode(F.array(F.lit("The"), F.concat(F.lit("tag"), (F.col("qid") % 3).cast("string")), F.lit("die"), F.lit("xx"))).alias("concept"))
    named = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("TAG"), (F.col("doc_id") % 3).cast("string")).alias("name"))
    return Z.coverage(mem, con, named)


@query(f"WITH {_MEM} SELECT qid, id, concept FROM cov")
def y6_coverage_matrix(spark, sf_dir):
    return covered(spark, sf_dir)


@query(f"WITH {REC}, {_MEM}, g AS (SELECT qid, concept, count(*) AS sources, count(DISTINCT type) AS t, max(confidence) - min(confidence) AS apart FROM cov JOIN records USING (id) GROUP BY qid, concept HAVING count(*) >= 2) SELECT qid, concept, sources, CASE WHEN t > 1 THEN 'most specific' WHEN apart > 0.3 THEN 'higher confidence' ELSE 'merge' END AS advice FROM g")
def y7_composition_conflicts(spark, sf_dir):
    return Z.conflicts(covered(spark, sf_dir), rec(spark, sf_dir))


# --- rules and skills for concepts -------------------------------------------------------------------

_RULES = "ru AS (SELECT p_partkey AS id, lower(p_name) AS c, p_partkey % 7 AS priority, CASE WHEN p_partkey % 5 = 0 THEN 'global' ELSE 'project' END AS scope, p_partkey % 4 AS project, p_partkey % 9 <> 0 AS active FROM part), wd AS (SELECT n_nationkey AS qid, n_nationkey % 4 AS project, unnest((SELECT string_split(lower(p_name), ' ') FROM part WHERE p_partkey = n_nationkey * 5 + 1)) AS w FROM nation)"


def wanted(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey % 5 = 1").select(F.floor(F.col("p_partkey") / 5).alias("qid"), F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("qid"))
    return p.join(n, "qid").withColumn("project", F.col("qid") % 4)


@query(f"WITH {_RULES}, h AS (SELECT DISTINCT qid, ru.id, priority FROM wd JOIN ru ON contains(ru.c, wd.w) WHERE active AND (scope = 'global' OR ru.project = wd.project)) SELECT qid, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY priority DESC, id) AS rank FROM h) WHERE rank <= 5")
def y1_rules_for_concepts(spark, sf_dir):
    from tessella.operators.search import containing

    k = F.col("p_partkey")
    r = table(spark, sf_dir, "part").where(k % 9 != 0).select(k.alias("id"), F.col("p_name").alias("content"), (k % 7).alias("priority"), (k % 5 == 0).alias("everywhere"), (k % 4).alias("own"))
    w = wanted(spark, sf_dir)
    hits = containing(r, w.select(F.col("w").alias("term"))).withColumnRenamed("term", "w").join(w, "w").join(r.drop("content"), "id").where(F.col("everywhere") | (F.col("own") == F.col("project")))
    return Z.best(hits.select("qid", "id", "priority").distinct(), ["qid"], [F.desc("priority"), "id"], 5).select("qid", "id", "rank")


@query(f"WITH {_RULES}, sk AS (SELECT id, c, ['new', 'active', 'mastered', 'deprecated'][(id % 4 + 1)::int] AS status, id % 13 AS uses FROM ru), h AS (SELECT DISTINCT qid, sk.id, uses FROM wd JOIN sk ON contains(sk.c, wd.w) WHERE status IN ('active', 'mastered')) SELECT qid, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY uses DESC, id) AS rank FROM h) WHERE rank <= 5")
def y3_skills_for_concepts(spark, sf_dir):
    from tessella.operators.search import containing

    k = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_name").alias("content"), M.pick(("new", "active", "mastered", "deprecated"), k % 4).alias("status"), (k % 13).alias("uses")).where("status IN ('active', 'mastered')")
    w = wanted(spark, sf_dir).select("qid", "w")
    hits = containing(s, w.select(F.col("w").alias("term"))).withColumnRenamed("term", "w").join(w, "w").join(s.select("id", "uses"), "id")
    return Z.best(hits.select("qid", "id", "uses").distinct(), ["qid"], [F.desc("uses"), "id"], 5).select("qid", "id", "rank")


# --- listings and summaries --------------------------------------------------------------------------


@query(f"WITH {REC}, u AS (SELECT project, 'convention' AS part, id, row_number() OVER (PARTITION BY project ORDER BY confidence DESC, id) AS rank FROM records WHERE status = 'active' AND type = 'convention' UNION ALL SELECT project, 'lesson', id, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id) FROM records WHERE status = 'active' AND type = 'lesson') SELECT project, part, id, rank FROM u WHERE rank <= CASE part WHEN 'convention' THEN 10 ELSE 5 END")
def y4_project_context(spark, sf_dir):
    r = rec(spark, sf_dir).where("status = 'active'")
    part = lambda t, order, k: Z.best(r.where(F.col("type") == t), ["project"], [*order, "id"], k).select("project", F.lit(t).alias("part"), "id", "rank")
    return part("convention", [F.desc("confidence")], 10).unionByName(part("lesson", [F.desc("created_at")], 5))


@query(f"WITH RECURSIVE {REC}, c(id, last, steps) AS (SELECT id, id, 0 FROM records UNION ALL SELECT c.id, r.superseded_by, c.steps + 1 FROM c JOIN records r ON r.id = c.last AND r.superseded_by IS NOT NULL WHERE c.steps < 100), e AS (SELECT id, arg_max(last, steps) AS newest, max(steps) AS versions FROM c GROUP BY id), s AS (SELECT a.id, count(b.id) - 1 AS related FROM records a JOIN records b ON a.session_id = b.session_id GROUP BY a.id) SELECT id, 'k-' || id || ' (' || project || ', ' || type || ')' AS citation, newest, versions, related FROM records JOIN e USING (id) JOIN s USING (id)")
def y11_record_citation(spark, sf_dir):
    """A record with its newest version, how many versions lie between, and how many records share its session."""
    from tessella.operators.sequence import version_chain

    r = rec(spark, sf_dir)
    n = r.groupBy("session_id").agg((F.count(F.lit(1)) - 1).alias("related"))
    text = F.concat(F.lit("k-"), F.col("id").cast("string"), F.lit(" ("), "project", F.lit(", "), "type", F.lit(")"))
    return r.join(version_chain(r).select("id", F.col("last").alias("newest"), F.col("steps").alias("versions")), "id").join(n, "session_id").select("id", text.alias("citation"), "newest", "versions", "related")


@query(f"WITH {M.LINKS_SQL}, n AS (SELECT node, count(*) AS records, sum(strength) AS s FROM links GROUP BY node), t AS (SELECT node, records FROM n ORDER BY floor(s * 1e6 + 0.5) DESC, node LIMIT 20), e AS (SELECT a.node AS source, b.node AS target, count(*) AS w FROM links a JOIN links b ON a.record = b.record AND a.node < b.node GROUP BY ALL) SELECT t.node, records, (SELECT count(*) FROM e JOIN t x ON x.node = e.source JOIN t y ON y.node = e.target WHERE (e.source = t.node OR e.target = t.node) AND w >= 2) AS degree FROM t")
def y13_graph_overview(spark, sf_dir):
    """The twenty most important nodes, their records, and their edges among themselves."""
    from tessella.operators import graph as G

    links = M.links(spark, sf_dir)
    top = links.groupBy("node").agg(F.count(F.lit(1)).alias("records"), F.sum("strength").alias("s")).orderBy(F.desc(M.rounded(F.col("s"))), "node").limit(20).select("node", "records")
    pairs = G.co_occurrence(links, 2).select(F.col("a").alias("source"), F.col("b").alias("target"))
    inner = G.both_ways(G.induced(pairs, top)).groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return top.join(inner, "node", "left").select("node", "records", F.coalesce("degree", F.lit(0)).alias("degree"))


_LISTS = (("insight", "confidence DESC"), ("rule", "recall_count DESC"), ("episode", "created_at DESC"), ("skill", "n_chars DESC"), ("reflection", "created_at"))


@query(f"WITH {REC}, k AS (SELECT *, ['insight', 'rule', 'episode', 'skill', 'reflection'][(id % 5 + 1)::int] AS kind FROM records WHERE status = 'active'), r AS (" + " UNION ALL ".join(f"SELECT kind, id, row_number() OVER (ORDER BY {o}, id) AS rank FROM k WHERE kind = '{k}'" for k, o in _LISTS) + ") SELECT kind, id, rank FROM r WHERE rank <= 20")
def y14_listings(spark, sf_dir):
    orders = {"insight": F.desc("confidence"), "rule": F.desc("recall_count"), "episode": F.desc("created_at"), "skill": F.desc("n_chars"), "reflection": F.asc("created_at")}
    r = rec(spark, sf_dir).where("status = 'active'").withColumn("kind", M.pick(tuple(orders), F.col("id") % 5))
    out = None
    for kind, order in orders.items():
        top = r.where(F.col("kind") == kind).orderBy(order, "id").limit(20)
        one = top.select("kind", "id", F.row_number().over(Window.partitionBy("kind").orderBy(order, "id")).alias("rank"))
        out = one if out is None else out.unionByName(one)
    return out


_KEYWORD_STOPS = ("the", "and", "for", "with", "that", "this", "from", "der", "die", "und", "les", "des", "que", "los")


@query(f"WITH {REC}, w AS (SELECT id, unnest(list_filter(regexp_extract_all(lower(content), '[a-zЀ-ӿ]{{3,}}'), lambda w: NOT list_contains({listed(_KEYWORD_STOPS)}, w))) AS word FROM records WHERE recall_count >= 2 AND length(content) >= 50), s AS (SELECT id, word, length(word) * 0.3 + least(count(*), 3) * 0.5 AS score FROM w GROUP BY id, word) SELECT id, word, {R('score')} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, word) AS rank FROM s) WHERE rank <= 5")
def y23_x19_test_keywords(spark, sf_dir):
    r = rec(spark, sf_dir).where((F.col("recall_count") >= 2) & (F.length("content") >= 50))
    return Z.keyword_scores(r, list(_KEYWORD_STOPS)).withColumn("score", M.rounded(F.col("score")))


_METHODS = "hit AS (SELECT o_custkey AS qid, o_orderkey AS id, m, row_number() OVER (PARTITION BY m, o_custkey ORDER BY CASE m WHEN 'price' THEN -o_totalprice WHEN 'age' THEN epoch(o_orderdate) ELSE o_orderkey % 97 END, o_orderkey) AS rank FROM orders, (SELECT unnest(['price', 'age', 'mixed']) AS m)), want AS (SELECT o_custkey AS qid, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F')"


@query(f"WITH {_METHODS}, f AS (SELECT m, h.qid, min(rank) AS first FROM hit h JOIN want w ON w.qid = h.qid AND w.id = h.id GROUP BY m, h.qid), q AS (SELECT DISTINCT qid FROM want), a AS (SELECT m, qid FROM q, (SELECT unnest(['price', 'age', 'mixed']) AS m)), g AS (SELECT m, qid, first FROM a LEFT JOIN f USING (m, qid)) SELECT m AS method, {R('avg(CASE WHEN first <= 1 THEN 1 ELSE 0 END)')} AS r1, {R('avg(CASE WHEN first <= 5 THEN 1 ELSE 0 END)')} AS r5, {R('avg(coalesce(1.0 / first, 0))')} AS mrr FROM g GROUP BY m")
def y24_method_comparison(spark, sf_dir):
    """Recall at 1 and 5 and reciprocal rank of three ways to rank the same wanted ones."""
    o = table(spark, sf_dir, "orders")
    orders = {"price": -F.col("o_totalprice"), "age": F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double"), "mixed": (F.col("o_orderkey") % 97).cast("double")}
    out = None
    for m, key in orders.items():
        ranked = o.select(F.col("o_custkey").alias("qid"), "o_orderstatus", F.row_number().over(Window.partitionBy("o_custkey").orderBy(key, "o_orderkey")).alias("rank"))
        first = ranked.where("o_orderstatus = 'F'").groupBy("qid").agg(F.min("rank").alias("first"))
        hit = lambda k: M.rounded(F.avg((F.col("first") <= k).cast("double")))
        one = first.agg(hit(1).alias("r1"), hit(5).alias("r5"), M.rounded(F.avg(1.0 / F.col("first"))).alias("mrr")).select(F.lit(m).alias("method"), "r1", "r5", "mrr")
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH d AS (SELECT l_orderkey AS id, 'opt' || l_linenumber % 3 AS option, sum(l_linenumber % 6) AS total, bool_or(l_linenumber % 3 = 1) AS selected FROM lineitem WHERE l_orderkey <= 500 GROUP BY 1, 2) SELECT id, option AS selected, total::double AS total, 'Chose ' || option AS summary FROM d WHERE selected")
def y25_decision_records(spark, sf_dir):
    n = F.col("l_linenumber")
    li = table(spark, sf_dir, "lineitem").where("l_orderkey <= 500").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("opt"), (n % 3).cast("string")).alias("option"), F.concat(F.lit("c"), n.cast("string")).alias("criterion"), (n % 6).cast("double").alias("rating"), (n % 3 == 1).alias("selected"))
    return Z.decisions(li).select("id", "selected", "total", "summary")


@query("WITH e AS (SELECT user_id % 10 AS project, CASE WHEN value < 20 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS category, count(*) AS n FROM events WHERE event_type = 'error' AND ts > timestamp '2024-01-31' - INTERVAL 30 DAY GROUP BY ALL HAVING count(*) >= 3) SELECT project, category, n, CASE WHEN project % 3 = 0 THEN 'upvoted' ELSE 'created' END AS action FROM e")
def y27_error_insights(spark, sf_dir):
    """Categories with three errors in 30 days: an insight that is there gets a vote, another is made."""
    v = F.col("value")
    e = table(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.col("ts") > F.lit("2024-01-31").cast("timestamp") - F.expr("INTERVAL 30 DAYS")))
    n = e.groupBy((F.col("user_id") % 10).alias("project"), F.when(v < 20, "low").when(v < 50, "mid").otherwise("high").alias("category")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    known = spark.createDataFrame([(p, c, True) for p in range(0, 10, 3) for c in ("low", "mid", "high")], "project long, category string, there boolean")
    return n.join(known, ["project", "category"], "left").select("project", "category", "n", F.when(F.col("there"), "upvoted").otherwise("created").alias("action"))


@query("SELECT conv_id % 5 AS project, count(DISTINCT conv_id) AS sessions, count(*) AS messages, max(turn) AS longest, sum(length(text))::bigint AS chars FROM conversations GROUP BY 1")
def y30_session_summaries(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 5).alias("project")).agg(F.count_distinct("conv_id").alias("sessions"), F.count(F.lit(1)).alias("messages"), F.max("turn").alias("longest"), F.sum(F.length("text")).alias("chars"))


@query("WITH s AS (SELECT o_custkey AS session, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 8), t AS (SELECT session, n FROM s WHERE session % 7 <> 0 ORDER BY n DESC, session LIMIT 50), r AS (SELECT session, o_orderkey AS id, row_number() OVER (PARTITION BY session ORDER BY o_orderdate DESC, o_orderkey) AS k FROM t JOIN orders ON o_custkey = session) SELECT session, id, k AS rank FROM r WHERE k <= 200")
def y31_compression_candidates(spark, sf_dir):
    """The 50 longest sessions without a summary (those whose key is no multiple of seven), 200 records of each."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("id"), "o_orderdate")
    top = o.groupBy("session").agg(F.count(F.lit(1)).alias("n")).where("n > 8 AND session % 7 <> 0").orderBy(F.desc("n"), "session").limit(50)
    return Z.best(o.join(top, "session"), ["session"], [F.desc("o_orderdate"), "id"], 200).select("session", "id", "rank")


@query(f"WITH {REC} SELECT id, trim(regexp_extract(content, '^[^.!?\\n]*[.!?]?')) AS summary, length(content) > 0 AS there FROM records")
def y35_enrichment_views(spark, sf_dir):
    """Views that need no model: the first sentence (keywords and the compressed text are tested apart)."""
    r = rec(spark, sf_dir).select("id", Z.view_texts(F.col("content")).alias("v"), "content")
    return r.select("id", "v.summary", (F.length("content") > 0).alias("there"))


@query("WITH i AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, text FROM conversations WHERE role = 'user' AND trim(text) <> '') SELECT id, rank FROM (SELECT id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM i WHERE contains(lower(text), 'th')) WHERE rank <= 3")
def y37_intent_search(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where((F.col("role") == "user") & (F.trim("text") != "") & F.lower("text").contains("th"))
    return Z.best(c, ["conv_id"], [F.desc("turn")], 3).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "rank")


@query(f"WITH {REC}, p AS (SELECT project AS name, count(*) AS n FROM records WHERE status = 'active' AND created_at > {AS_OF} - INTERVAL 90 DAY GROUP BY project ORDER BY n DESC, name LIMIT 10), t AS (SELECT lower(unnest(tags)) AS name FROM records WHERE status = 'active'), u AS (SELECT name, count(*) AS n FROM t WHERE name <> 'auto' GROUP BY name ORDER BY n DESC, name LIMIT 20) SELECT 'project' AS part, name, n FROM p UNION ALL SELECT 'tag', name, n FROM u")
def y39_user_profile(spark, sf_dir):
    r = rec(spark, sf_dir).where("status = 'active'")
    top = lambda d, k: d.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(k)
    projects = top(r.where(F.col("created_at") > as_of() - F.expr("INTERVAL 90 DAYS")).select(F.col("project").alias("name")), 10)
    tags = top(r.select(F.explode("tags").alias("t")).select(F.lower("t").alias("name")).where("name <> 'auto'"), 20)
    return projects.select(F.lit("project").alias("part"), "name", "n").unionByName(tags.select(F.lit("tag").alias("part"), "name", "n"))


@query(f"WITH {REC}, t AS (SELECT created_at > {AS_OF} - INTERVAL 30 DAY AS new, unnest(tags) AS tag FROM records), n AS (SELECT tag, count(*) FILTER (new) AS a, count(*) FILTER (NOT new) AS b FROM t GROUP BY tag), s AS (SELECT tag, coalesce(b / nullif((SELECT sum(b) FROM n), 0)::double, 0) AS before, coalesce(a / nullif((SELECT sum(a) FROM n), 0)::double, 0) AS lately FROM n) SELECT tag, {R('before')} AS before, {R('lately')} AS lately, CASE WHEN lately > before * 1.2 THEN 'more' WHEN lately < before * 0.8 THEN 'less' ELSE 'same' END AS change FROM s")
def y40_style_change(spark, sf_dir):
    out = Z.style_change(rec(spark, sf_dir), as_of())
    return out.select("tag", M.rounded(F.col("before")).alias("before"), M.rounded(F.col("lately")).alias("lately"), "change")


@query("SELECT k AS version, CASE WHEN k % 3 = 0 THEN 'pending' ELSE 'applied' END AS state FROM (SELECT unnest(range(1, 21)) AS k)")
def y42_schema_versions(spark, sf_dir):
    """Versions that are known against those that were applied."""
    known, applied = spark.range(1, 21).select(F.col("id").alias("version")), spark.range(1, 21).where("id % 3 <> 0").select(F.col("id").alias("version"), F.lit("applied").alias("state"))
    return known.join(applied, "version", "left").select("version", F.coalesce("state", F.lit("pending")).alias("state"))


@query("SELECT ['cargo', 'pytest', 'git_status', 'generic_logs'][(doc_id % 4 + 1)::int] AS filter, count(*) AS uses, sum((length(text) - length(text) * (doc_id % 50 + 10) // 100) // 4)::bigint AS tokens, floor(avg(100.0 - 100.0 * (length(text) * (doc_id % 50 + 10) // 100) / length(text)) * 1e4 + 0.5) / 1e4 AS saved FROM documents WHERE length(text) > 0 GROUP BY 1")
def a20_filter_savings(spark, sf_dir):
    i, n = F.col("doc_id"), F.length("text")
    kept = F.floor(n * (i % 50 + 10) / 100)
    d = table(spark, sf_dir, "documents").where(n > 0).groupBy(M.pick(("cargo", "pytest", "git_status", "generic_logs"), i % 4).alias("filter"))
    return d.agg(F.count(F.lit(1)).alias("uses"), F.sum(F.floor((n - kept) / 4)).alias("tokens"), M.rounded(F.avg(100.0 - 100.0 * kept / n), 4).alias("saved"))


@query(f"WITH {REC}, e AS (SELECT id, ['t' || id % 5, 't' || id % 3] AS topics, ['Ent' || id % 4, 'ENT' || id % 7] AS entities, ['ask', 'tell', 'do'][(id % 3 + 1)::int] AS intent FROM records WHERE id % 10 <> 9) SELECT id FROM records JOIN e USING (id) WHERE len(list_intersect(topics, ['t1', 't4'])) > 0 AND len(list_filter(entities, lambda x: lower(x) IN ('ent2', 'ent3'))) > 0 AND intent = 'tell'")
def p6_enrichment_filter(spark, sf_dir):
    """Topics or topics, entities or entities, and the intent; records without enrichment are left out."""
    i = F.col("id")
    name = lambda p, n: F.concat(F.lit(p), (i % n).cast("string"))
    e = rec(spark, sf_dir).where("id % 10 <> 9").select("id", F.array(name("t", 5), name("t", 3)).alias("topics"), F.array(name("Ent", 4), name("ENT", 7)).alias("entities"), M.pick(("ask", "tell", "do"), i % 3).alias("intent"))
    some = lambda c, *v: F.arrays_overlap(F.transform(c, F.lower), F.array(*(F.lit(x) for x in v)))
    return rec(spark, sf_dir).select("id").join(e, "id").where(some("topics", "t1", "t4") & some("entities", "ent2", "ent3") & (F.col("intent") == "tell")).select("id")


@query("WITH w AS (SELECT p_partkey AS id, p_partkey % 6 AS project, p_size AS size, CASE WHEN p_partkey % 5 = 0 THEN 'deprecated' ELSE 'active' END AS status FROM part), r AS (SELECT l_partkey AS wf, count(*) AS runs FROM lineitem GROUP BY 1) SELECT project, count(*) AS workflows, count(*) FILTER (status = 'active') AS active, coalesce(sum(runs), 0)::bigint AS runs FROM w LEFT JOIN r ON wf = id GROUP BY project")
def y17_workflow_statistics(spark, sf_dir):
    k = F.col("p_partkey")
    w = table(spark, sf_dir, "part").select(k.alias("id"), (k % 6).alias("project"), F.when(k % 5 == 0, "deprecated").otherwise("active").alias("status"))
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("runs"))
    return w.join(r, "id", "left").groupBy("project").agg(F.count(F.lit(1)).alias("workflows"), F.count_if(F.col("status") == "active").alias("active"), F.coalesce(F.sum("runs"), F.lit(0)).alias("runs"))


@query("SELECT l_partkey AS workflow, l_orderkey AS run, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rank FROM lineitem WHERE l_partkey % 100 = 0) WHERE rank <= 20")
def y17_recent_runs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_partkey % 100 = 0")
    return Z.best(li, ["l_partkey"], [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")], 20).select(F.col("l_partkey").alias("workflow"), F.col("l_orderkey").alias("run"), "rank")


@query("WITH s AS (SELECT p_partkey AS id, ['new', 'active', 'mastered', 'deprecated'][(p_partkey % 4 + 1)::int] AS status, p_size AS uses, (p_partkey % 100) / 100.0::double AS rate, string_split(p_name, ' ') AS stack FROM part), f AS (SELECT * FROM s WHERE list_contains(stack, (SELECT string_split(p_name, ' ')[1] FROM part WHERE p_partkey = 1)) OR id % 2 = 0) SELECT status, count(*) AS n, floor(avg(rate) * 1000 + 0.5) / 1000 AS rate, sum(uses)::bigint AS uses FROM f GROUP BY status")
def y18_skill_statistics(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    word = p.where("p_partkey = 1").select(F.get(F.split("p_name", " "), F.lit(0)).alias("w"))  # one row
    s = p.crossJoin(word).where(F.array_contains(F.split("p_name", " "), F.col("w")) | (k % 2 == 0))
    return s.groupBy(M.pick(("new", "active", "mastered", "deprecated"), k % 4).alias("status")).agg(F.count(F.lit(1)).alias("n"), (F.floor(F.avg(k % 100 / 100.0) * 1000 + 0.5) / 1000).alias("rate"), F.sum("p_size").alias("uses"))


@query(f"WITH {REC} SELECT count(*) AS records, count(*) FILTER (status = 'active') AS active, count(*) FILTER (superseded_by IS NOT NULL AND superseded_by NOT IN (SELECT id FROM records)) AS dangling, floor(epoch({AS_OF} - max(created_at)) / 86400)::bigint AS newest_days, count(DISTINCT session_id) AS sessions FROM records")
def y41_health_check(spark, sf_dir):
    """Counts, references that lead nowhere, and how fresh the newest record is."""
    r = rec(spark, sf_dir)
    lost = r.where("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("id")).join(r.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("dangling"))  # one row
    days = F.floor((F.unix_timestamp(as_of()) - F.unix_timestamp(F.max("created_at"))) / 86400)
    return r.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("status") == "active").alias("active"), days.alias("newest_days"), F.count_distinct("session_id").alias("sessions")).crossJoin(lost).select("records", "active", "dangling", "newest_days", "sessions")
