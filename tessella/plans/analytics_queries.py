"""Dashboards, rates, metrics, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import model as M
from tessella.functions import text as X
from tessella.operators import analytics as A
from tessella.plans.registry import query
from tessella.session import table

R = M.rounded_sql
REC = M.RECORDS_SQL


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def ended():
    return F.lit(M.EVENTS_AS_OF).cast("timestamp")


@query(f"WITH {REC} SELECT id, type FROM records WHERE status = 'active' AND confidence >= 0.5")
def s1_scan_with_predicate(spark, sf_dir):
    return M.records(spark, sf_dir).where("status = 'active' AND confidence >= 0.5").select("id", "type")


@query("SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'stored' END AS status, count(*) AS n FROM events GROUP BY 1")
def s4_ingest_queue_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.when(F.col("event_type") == "error", "error").otherwise("stored").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {REC} SELECT project, type, count(*) AS n, string_agg(id::varchar, ',' ORDER BY id) AS ids FROM records WHERE status = 'active' GROUP BY ALL")
def s11_export_per_project(spark, sf_dir):
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda i: i.cast("string")), ",")
    return M.records(spark, sf_dir).where("status = 'active'").groupBy("project", "type").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))


@query(f"WITH {REC} SELECT project, type, id FROM records WHERE type IN ('decision', 'solution', 'convention') AND status = 'active' QUALIFY row_number() OVER (PARTITION BY project, type ORDER BY created_at DESC, id) <= 5")
def s13_project_wiki(spark, sf_dir):
    r = M.records(spark, sf_dir).where(F.col("type").isin("decision", "solution", "convention") & (F.col("status") == "active"))
    return A.ranked(r, ["project", "type"], [F.desc("created_at"), "id"], 5).select("project", "type", "id")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j1_inner_joins(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def j3_left_join_concat(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    p = F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",")
    return c.join(o, o.o_custkey == c.c_custkey, "left").groupBy("c_custkey").agg(F.nullif(p, F.lit("")).alias("priorities"))


@query("SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE last IS NULL OR last < timestamp '2001-01-01'")
def j4_idle_projects(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    idle = F.col("last").isNull() | (F.col("last") < F.lit("2001-01-01").cast("timestamp"))
    return table(spark, sf_dir, "customer").join(last, "c_custkey", "left").where(idle).select("c_custkey")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def j6_not_exists(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_anti").select("o_orderkey")


@query("SELECT DISTINCT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l_quantity > 49) OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l_discount > 0.09)")
def j7_exists_either(spark, sf_dir):
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    hit = li.where("l_quantity > 49").select("l_partkey").union(li.where("l_discount > 0.09D").select("l_partkey"))
    return p.join(hit, p.p_partkey == hit.l_partkey, "left_semi").select("p_partkey")


@query(f"WITH {M.EDGES_SQL} SELECT e.source, e.target, s_name, relation FROM edges e JOIN supplier ON s_suppkey = e.source WHERE weight > 1.5")
def j9_triple_join_with_names(spark, sf_dir):
    e, s = M.edges(spark, sf_dir).where("weight > 1.5"), table(spark, sf_dir, "supplier")
    return e.join(s, e.source == s.s_suppkey).select("source", "target", "s_name", "relation")


@query(f"WITH {M.LINKS_SQL} SELECT node, arg_max(record, (strength, -record)) AS best FROM links GROUP BY node")
def j10_best_linked_record(spark, sf_dir):
    return M.links(spark, sf_dir).groupBy("node").agg(F.max_by("record", F.struct("strength", -F.col("record"))).alias("best"))


@query(f"WITH {M.EDGES_SQL}, b AS (SELECT source, target FROM edges UNION ALL SELECT target, source FROM edges) SELECT source AS node, count(DISTINCT target) AS neighbours FROM b GROUP BY source")
def j11_u2_undirected_neighbours(spark, sf_dir):
    from tessella.operators.graph import both_ways

    return both_ways(M.edges(spark, sf_dir).select("source", "target")).groupBy(F.col("source").alias("node")).agg(F.count_distinct("target").alias("neighbours"))


@query(f"WITH {REC} SELECT type, project, status, count(*) AS n FROM records GROUP BY ALL")
def a1_counts(spark, sf_dir):
    return M.records(spark, sf_dir).groupBy("type", "project", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 50) AS large, count(*) AS n FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'error') >= 3")
def a2_a3_conditional_counts(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 50).alias("large"), F.count(F.lit(1)).alias("n"))
    return e.where("errors >= 3")


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS events FROM events GROUP BY event_type")
def a4_count_distinct(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_id").alias("events"))


@query(f"SELECT count(*) AS n, {R('coalesce(avg(value), 0)', 4)} AS mean, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def a6_global_aggregates(spark, sf_dir):
    return events(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), M.rounded(F.coalesce(F.avg("value"), F.lit(0.0)), 4).alias("mean"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"""WITH {REC}, s AS (SELECT project, count(*) AS total, count(*) FILTER (coalesce(last_recalled, created_at) < timestamp '2024-03-03') AS stale, count(*) FILTER (recall_count = 0) AS never FROM records GROUP BY project)
 SELECT project, {R('greatest(0.0, 1.0 - 0.5 * stale / total::double - 0.3 * never / total::double)')} AS health FROM s""")
def a7_health(spark, sf_dir):
    stale = F.coalesce("last_recalled", "created_at") < F.lit("2024-03-03").cast("timestamp")
    s = M.records(spark, sf_dir).groupBy("project").agg(F.count(F.lit(1)).alias("total"), F.count_if(stale).alias("stale"), F.count_if(F.col("recall_count") == 0).alias("never"))
    return s.select("project", M.rounded(A.health(F.col("total"), F.col("stale"), F.col("never"))).alias("health"))


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS l FROM events GROUP BY event_type)
 SELECT event_type, l[len(l) // 2 + 1] AS p50, l[greatest(0, floor(len(l) * 0.95)::bigint - 1) + 1] AS p95, l[least(len(l) - 1, floor(len(l) * 0.99)::bigint) + 1] AS p99 FROM s""")
def a8_a40_percentile_ranks(spark, sf_dir):
    return A.percentiles(events(spark, sf_dir), "event_type", "value", {"p50": A.median_place, "p95": A.nearest_place(0.95), "p99": A.index_place(0.99)})


@query(f"SELECT event_type, {R('quantile_cont(value, 0.5)')} AS p50, {R('quantile_cont(value, 0.95)')} AS p95 FROM events GROUP BY event_type")
def a9_percentile_interpolated(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(M.rounded(F.percentile("value", 0.5)).alias("p50"), M.rounded(F.percentile("value", 0.95)).alias("p95"))


@query("SELECT week::bigint AS week, count(*) AS n FROM (SELECT floor(epoch(timestamp '2024-01-31' - ts) / 604800) AS week FROM events) WHERE week BETWEEN 0 AND 3 GROUP BY week")
def a10_weekly_trend(spark, sf_dir):
    return A.weekly_trend(events(spark, sf_dir), "ts", ended())


@query(f"""WITH s AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS ok, count(*) AS n, sum(value) AS v FROM events GROUP BY user_id)
 SELECT user_id, n, {R('(ok + 1) / (n + 2)::double')} AS p, {R('least(0.95, n / (n + 5)::double)')} AS confidence, CASE WHEN n >= 10 AND ok / n::double >= 0.8 THEN 'mastered' WHEN n >= 3 THEN 'active' ELSE 'learning' END AS status,
 CASE WHEN n < 3 THEN 'unknown' WHEN ok / n::double > 0.7 AND n >= 5 THEN 'improving' WHEN ok / n::double <= 0.3 THEN 'declining' WHEN ok / n::double <= 0.5 THEN 'stable_low' ELSE 'stable' END AS trend FROM s""")
def a11_a13_a15_success_rates(spark, sf_dir):
    s = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("ok"), F.count(F.lit(1)).alias("n"))
    rate, n = F.col("ok") / F.col("n"), F.col("n")
    p, confidence = A.laplace(F.col("ok"), n)
    return s.select("user_id", "n", M.rounded(p).alias("p"), M.rounded(confidence).alias("confidence"), A.skill_status(n, rate, F.lit("learning")).alias("status"), A.competency_trend(rate, n).alias("trend"))


@query(f"SELECT event_type, count(*) AS times_run, count(*) FILTER (value > 20) AS ok, {R('count(*) FILTER (value > 20) / count(*)::double')} AS rate, floor(avg(value))::bigint AS avg_duration FROM events GROUP BY event_type")
def a12_success_refresh(spark, sf_dir):
    ok = F.count_if(F.col("value") > 20)
    return events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("times_run"), ok.alias("ok"), M.rounded(ok / F.count(F.lit(1))).alias("rate"), F.floor(F.avg("value")).alias("avg_duration"))


@query(f"WITH {REC} SELECT tag, count(*) AS n, max(created_at) AS last_seen FROM (SELECT unnest(tags) AS tag, created_at FROM records) GROUP BY tag")
def a17_pattern_frequency(spark, sf_dir):
    return M.records(spark, sf_dir).select(F.explode("tags").alias("tag"), "created_at").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_seen"))


@query("""WITH e AS (SELECT user_id, count(*) AS n, arg_max(event_id, (ts, event_id)) AS sample FROM events WHERE event_type = 'error' AND ts >= timestamp '2024-01-01' GROUP BY user_id HAVING count(*) >= 3)
 SELECT user_id, n, sample FROM e WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 90)""")
def a18_a19_error_rules(spark, sf_dir):
    e = events(spark, sf_dir)
    repeated = e.where("event_type = 'error' AND ts >= timestamp_ntz'2024-01-01'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("sample")).where("n >= 3")
    ruled = e.where("event_type = 'signup' AND value > 90").select("user_id")
    return repeated.join(ruled, "user_id", "left_anti")


_AS_OF = f"timestamp '{M.EVENTS_AS_OF}'"


@query(
    f"""WITH q AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status, ts AS fin, value FROM events),
 d AS (SELECT floor(value * 1000 + 0.5) AS ms FROM q WHERE status = 'done' ORDER BY id DESC LIMIT 100), l AS (SELECT list_sort(list(ms)) AS l FROM d), f AS (SELECT list(id ORDER BY id DESC) AS ids FROM (SELECT id FROM q WHERE status = 'failed' ORDER BY id DESC LIMIT 5))
 SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'done' AND fin > {_AS_OF} - INTERVAL 60 SECOND AND fin <= {_AS_OF}) AS per_minute,
 floor(epoch_us({_AS_OF} - min(fin) FILTER (status = 'pending')) / 1000000.0)::bigint AS oldest, any_value(l[len(l) // 2 + 1])::double AS p50, any_value(l[greatest(0, floor(len(l) * 0.95)::bigint - 1) + 1])::double AS p95, array_to_string(any_value(ids), ',') AS last_failures FROM q, l, f"""
)
def a21_queue_health(spark, sf_dir):
    from tessella.operators import queues

    k = F.col("event_type")
    status = F.when(k == "view", "pending").when(k == "purchase", "done").when(k == "error", "failed").otherwise("processing")
    q = events(spark, sf_dir).select(F.col("event_id").alias("id"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"), F.floor(F.col("value") * 1000 + 0.5).cast("double").alias("ms"))
    return queues.health(q, ended())


HITS = "hits AS (SELECT o_custkey AS qid, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), wanted AS (SELECT o_custkey AS qid, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F')"


@query(f"""WITH {HITS}, n AS (SELECT qid, count(*) AS n FROM wanted GROUP BY qid),
 f AS (SELECT h.qid, count(*) AS found, min(rank) AS first, sum(1.0 / log2(rank + 1.0)) AS dcg FROM hits h JOIN wanted w ON w.qid = h.qid AND w.id = h.id WHERE rank <= 5 GROUP BY h.qid)
 SELECT qid, {R('coalesce(found, 0) / n::double')} AS recall, coalesce(found, 0) > 0 AS any, coalesce(found, 0) = n AS all, {R('coalesce(1.0 / first, 0)')} AS rr,
 {R('coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1.0 / log2(i + 1.0)))')} AS ndcg FROM n LEFT JOIN f USING (qid)""")
def a27_retrieval_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    hits = A.ranked(o, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 5).select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), "rank")
    wanted = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"))
    m = A.retrieval_metrics(hits, wanted, 5)
    return m.select("qid", M.rounded(F.col("recall")).alias("recall"), "any", "all", M.rounded(F.col("rr")).alias("rr"), M.rounded(F.col("ndcg")).alias("ndcg"))


CAL = "cal AS (SELECT doc_id, (doc_id * 37 % 100) / 100.0::double AS p, quality AS y FROM labels)"


def cal(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", ((F.col("doc_id") * 37 % 100) / 100.0).alias("p"), F.col("quality").alias("y"))


@query(f"WITH {CAL}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM cal GROUP BY 1) SELECT {R('sum(n * abs(conf - acc)) / sum(n)')} AS ece FROM b")
def a28_calibration_error(spark, sf_dir):
    return A.calibration_error(cal(spark, sf_dir), "p", "y").select(M.rounded(F.col("ece")).alias("ece"))


@query(f"""WITH {CAL}, g AS (SELECT unnest(range(1, 20)) / 20.0::double AS t), j AS (SELECT t, count(*) FILTER (y = 1 AND p >= t) / count(*) FILTER (y = 1)::double - count(*) FILTER (y = 0 AND p >= t) / count(*) FILTER (y = 0)::double AS j FROM cal, g GROUP BY t)
 SELECT arg_max(t, (j, -t)) AS threshold, {R('max(j)')} AS j FROM j""")
def a36_threshold_tuning(spark, sf_dir):
    return A.youden(cal(spark, sf_dir), "p", "y").select("threshold", M.rounded(F.col("j")).alias("j"))


@query(f"WITH {REC}, d AS (SELECT isodow(created_at) - 1 AS weekday, project, count(*) AS n FROM records GROUP BY ALL) SELECT weekday::bigint AS weekday, project, n, {R('n / sum(n) OVER (PARTITION BY weekday)')} AS share FROM d")
def a29_weekday_share(spark, sf_dir):
    from pyspark.sql import Window

    d = M.records(spark, sf_dir).groupBy(F.weekday("created_at").cast("long").alias("weekday"), "project").agg(F.count(F.lit(1)).alias("n"))
    return d.select("weekday", "project", "n", M.rounded(F.col("n") / F.sum("n").over(Window.partitionBy("weekday"))).alias("share"))


@query(f"""WITH {REC}, s AS (SELECT project, count(*) FILTER (type = 'solution') AS ok, count(*) FILTER (type = 'lesson') AS bad FROM records GROUP BY project)
 SELECT project, CASE WHEN ok + bad = 0 THEN 'unknown' WHEN ok / (ok + bad)::double >= 0.7 THEN 'clear' WHEN ok / (ok + bad)::double >= 0.4 THEN 'cloudy' ELSE 'storm' END AS weather FROM s""")
def a30_weather(spark, sf_dir):
    s = M.records(spark, sf_dir).groupBy("project").agg(F.count_if(F.col("type") == "solution").alias("ok"), F.count_if(F.col("type") == "lesson").alias("bad"))
    r = F.try_divide(F.col("ok"), F.col("ok") + F.col("bad"))
    return s.select("project", F.when(r.isNull(), "unknown").when(r >= 0.7, "clear").when(r >= 0.4, "cloudy").otherwise("storm").alias("weather"))


@query(f"WITH {REC} SELECT tag, count(*) AS n FROM (SELECT project, unnest(tags) AS tag FROM records) GROUP BY project, tag HAVING count(*) < 3")
def a32_knowledge_gaps(spark, sf_dir):
    return M.records(spark, sf_dir).select("project", F.explode("tags").alias("tag")).groupBy("project", "tag").agg(F.count(F.lit(1)).alias("n")).where("n < 3").select("tag", "n")


@query(f"""WITH p AS (SELECT p_partkey AS k, string_split(lower(p_name), ' ') AS a FROM part), q AS (SELECT p.k, p.a, n.a AS b FROM p JOIN p n ON n.k = p.k + 1),
 c AS (SELECT k, a, b, list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))) AS shared FROM q)
 SELECT k, {R('CASE WHEN shared = 0 THEN 0 ELSE 2.0 * shared / (len(a) + len(b)) END')} AS f1 FROM c""")
def a33_token_f1(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), X.words(F.col("p_name")).alias("a"))
    pairs = p.join(p.select((F.col("k") - 1).alias("k"), F.col("a").alias("b")), "k")
    return pairs.select("k", M.rounded(A.token_f1(F.col("a"), F.col("b"))).alias("f1"))


@query(f"WITH {REC} SELECT project, n FROM (SELECT project, count(*) AS n FROM records WHERE created_at >= timestamp '2024-05-01' GROUP BY project) ORDER BY n DESC, project LIMIT 5")
def a37_weekly_digest(spark, sf_dir):
    recent = M.records(spark, sf_dir).where(F.col("created_at") >= F.lit("2024-05-01").cast("timestamp"))
    return recent.groupBy("project").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "project").limit(5)


@query(f"SELECT user_id, n, {R('least(0.3 + 0.1 * n, 1.0)')} AS severity FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND value > 50 GROUP BY user_id) WHERE n >= 3")
def a38_blind_spots(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'error' AND value > 50").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return e.withColumn("severity", M.rounded(F.least(0.3 + 0.1 * F.col("n"), F.lit(1.0))))


@query("SELECT label, vec_id AS id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) <= 3")
def w2_top_k_per_group(spark, sf_dir):
    return A.ranked(table(spark, sf_dir, "embeddings"), ["label"], [F.desc(F.get("embedding", F.lit(0))), "vec_id"], 3).select("label", F.col("vec_id").alias("id"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def t1_order_limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT source AS node FROM (SELECT l_suppkey AS source FROM lineitem UNION SELECT l_partkey FROM lineitem)")
def u1_union_distinct(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("node")).union(li.select("l_partkey")).distinct()


@query("SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 99")
def u3_intersection(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.where("event_type = 'error'").select("user_id").intersect(e.where("event_type = 'purchase' AND value > 99").select("user_id"))


@query("SELECT user_id FROM events EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95")
def u4_difference(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("user_id").distinct().join(e.where("event_type = 'purchase' AND value > 95").select("user_id"), "user_id", "left_anti")


@query(f"WITH s AS (SELECT l_partkey AS id, l_discount AS score FROM lineitem UNION ALL SELECT l_partkey, l_tax FROM lineitem) SELECT id, max(score) AS score FROM s GROUP BY id")
def u5_keep_best(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    both = li.select(F.col("l_partkey").alias("id"), F.col("l_discount").alias("score")).union(li.select("l_partkey", "l_tax"))
    return both.groupBy("id").agg(F.max("score").alias("score"))


@query("SELECT id, arg_min(src, pri) AS src FROM (SELECT c_custkey AS id, 'customer' AS src, 1 AS pri FROM customer UNION ALL SELECT s_suppkey, 'supplier', 2 FROM supplier UNION ALL SELECT p_partkey, 'part', 3 FROM part) GROUP BY id")
def u6_first_source_wins(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.col(k).cast("long").alias("id"), F.lit(t).alias("src"), F.lit(i).alias("pri")) for i, (t, k) in enumerate((("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey")))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("id").agg(F.min_by("src", "pri").alias("src"))


@query("SELECT n_name AS branch FROM nation UNION SELECT r_name FROM region")
def y16_branch_list(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("branch")).union(table(spark, sf_dir, "region").select("r_name")).distinct()


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value, count(*) AS evidence FROM events GROUP BY user_id")
def y21_last_value_wins(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count(F.lit(1)).alias("evidence"))


@query("SELECT event_id, CASE WHEN value / 100 >= 0.60 THEN 'hard' WHEN value / 100 >= 0.30 THEN 'soft' ELSE 'none' END AS label FROM events")
def y22_contradiction_labels(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", X.score_label(F.col("value") / 100).alias("label"))


@query("SELECT label AS model, count(*) AS vectors, sum(vec_id % 500 // 4)::bigint AS tokens FROM embeddings WHERE label <> 3 GROUP BY label")
def y43_reembed_plan(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("label <> 3")
    return e.groupBy(F.col("label").alias("model")).agg(F.count(F.lit(1)).alias("vectors"), F.sum(F.floor(F.col("vec_id") % 500 / 4)).cast("long").alias("tokens"))
