"""Queries of merging, contradictions, clusters, entity tags, queues, proposals, blind spots and graph building."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella import model as M
from tessella.functions import text as X
from tessella.operators import consolidate as C
from tessella.operators import graph_build as B
from tessella.operators import queues as Q
from tessella.operators import retrieval as V
from tessella.plans.registry import query
from tessella.plans.rule_queries import probe, probe_sql
from tessella.session import table

R = M.rounded_sql
REC = M.RECORDS_SQL


def rec(spark, sf_dir):
    return M.records(spark, sf_dir)


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


# --- merging and contradictions ----------------------------------------------------------------------


@query()
def l5_digest_merge(spark, sf_dir):
    return C.digest_merge(rec(spark, sf_dir).withColumn("type", F.lit("fact")).withColumn("status", F.lit("active")))


#: Concepts of a record: those of four neighbouring ids are mostly the same.
_CONCEPTS = "cs AS (SELECT id, list_distinct([id // 4, id // 4 + 1, id % 3 + 900]) AS s FROM records WHERE status = 'active'), rr AS (SELECT r.id, session_id // 3 AS project, content, created_at, s FROM records r JOIN cs USING (id))"


def concept_records(spark, sf_dir):
    i = F.col("id")
    r = rec(spark, sf_dir).withColumns({"project": F.floor(F.col("session_id") / 3), "type": F.lit("fact")})
    concepts = r.select("id", F.explode(F.array_distinct(F.array(F.floor(i / 4), F.floor(i / 4) + 1, i % 3 + 900))).alias("concept"))
    return r, concepts


@query(
    f"""WITH {REC}, {_CONCEPTS}, p AS (SELECT a.id AS a, b.id AS b, a.created_at AS ca, b.created_at AS cb, list_distinct(string_split(lower(left(a.content, 200)), ' ')) AS wa, list_distinct(string_split(lower(left(b.content, 200)), ' ')) AS wb FROM rr a JOIN rr b ON a.project = b.project AND a.id < b.id AND len(list_intersect(a.s, b.s)) >= 0.5 * len(list_distinct(list_concat(a.s, b.s)))),
 s AS (SELECT *, 0.1 + len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb)))::double AS sim FROM p) SELECT CASE WHEN (ca, a) < (cb, b) THEN a ELSE b END AS old_id, CASE WHEN (ca, a) < (cb, b) THEN b ELSE a END AS new_id, {R('sim')} AS ratio FROM s WHERE sim > 0.2 AND sim < 0.6"""
)
def l10_contradiction_candidates(spark, sf_dir):
    """The measure of texts is pluggable; here word overlap of the heads stands in for the sequence ratio."""
    r, concepts = concept_records(spark, sf_dir)
    head = lambda c: F.array_distinct(F.split(F.lower(F.substring(c, 1, 200)), " ", -1))
    out = C.contradiction_candidates(r, concepts, lambda a, b: X.jaccard(head(F.col(a)), head(F.col(b))) + 0.1)
    return out.select("old_id", "new_id", M.rounded(F.col("ratio")).alias("ratio"))


@query()
def l10_contradictions_by_sequence(spark, sf_dir):
    """The same with the sequence ratio of the whole texts."""
    r, concepts = concept_records(spark, sf_dir)
    return C.contradiction_candidates(r.withColumn("content", F.substring("content", 1, 300)), concepts)


_POOL = "pool AS (SELECT doc_id AS new_id, doc_id * 3 % (SELECT count(*) FROM documents) AS old_id, (doc_id * 13 % 100) / 100.0::double AS cosine, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 3 <> 0 END AS contradicts, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id * 29 % 100) / 100.0::double END AS confidence FROM documents), dec AS (SELECT *, CASE WHEN contradicts IS NULL THEN 'error' WHEN NOT contradicts OR confidence IS NULL THEN 'rejected' WHEN confidence >= 0.8 THEN 'superseded' WHEN confidence >= 0.5 THEN 'flagged' ELSE 'rejected' END AS decision FROM pool WHERE cosine >= 0.55 AND old_id <> new_id)"


def judged(spark, sf_dir):
    """Candidates with a judge's answer, made from ids (models are plugged in as columns)."""
    i = F.col("doc_id")
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))  # one row
    d = table(spark, sf_dir, "documents").crossJoin(n)
    pool = d.select(i.alias("new_id"), (i * 3 % F.col("n")).alias("old_id"), (i * 13 % 100 / 100.0).alias("cosine"), F.when(i % 11 != 0, i % 3 != 0).alias("contradicts"), F.when(i % 7 != 0, i * 29 % 100 / 100.0).alias("confidence"))
    return C.verdicts(pool.where("old_id <> new_id"))


@query(f"WITH {_POOL} SELECT new_id, old_id, decision FROM dec")
def l11_contradiction_verdicts(spark, sf_dir):
    return judged(spark, sf_dir).select("new_id", "old_id", "decision")


@query(f"WITH {REC}, {_POOL}, pr AS (SELECT old_id, max(new_id) AS new_id FROM dec WHERE decision = 'superseded' AND old_id IN (SELECT id FROM records WHERE status = 'active') GROUP BY old_id) SELECT id, CASE WHEN pr.new_id IS NOT NULL THEN 'superseded' ELSE status END AS status, coalesce(pr.new_id, superseded_by) AS superseded_by FROM records LEFT JOIN pr ON old_id = id")
def y32_resolved_contradictions(spark, sf_dir):
    links = M.links(spark, sf_dir)
    return C.resolve(rec(spark, sf_dir), judged(spark, sf_dir), links)[0].select("id", "status", "superseded_by")


@query(f"WITH {REC}, {M.LINKS_SQL}, {_POOL}, pr AS (SELECT old_id, max(new_id) AS new_id FROM dec WHERE decision = 'superseded' AND old_id IN (SELECT id FROM records WHERE status = 'active') GROUP BY old_id) SELECT DISTINCT n.node AS source, o.node AS target, 'supersedes' AS relation FROM pr JOIN links o ON o.record = old_id JOIN links n ON n.record = new_id WHERE n.node <> o.node")
def y32_supersedes_edges(spark, sf_dir):
    return C.resolve(rec(spark, sf_dir), judged(spark, sf_dir), M.links(spark, sf_dir))[1].select("source", "target", "relation")


# --- clusters and near duplicates --------------------------------------------------------------------

_BAND = "v AS (SELECT vec_id AS id, label, embedding FROM embeddings), p AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.label = b.label AND a.id < b.id AND list_cosine_similarity(a.embedding::double[], b.embedding::double[]) BETWEEN {lo} AND {hi})"


@query(f"""WITH RECURSIVE {_BAND.format(lo=0.3, hi=0.95)}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(node, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node), c AS (SELECT node, min(c) AS cluster FROM r GROUP BY node),
 n AS (SELECT *, (row_number() OVER (PARTITION BY cluster ORDER BY node) - 1) // 5 AS part FROM c) SELECT cluster, part, node AS id FROM (SELECT *, count(*) OVER (PARTITION BY cluster, part) AS k FROM n) WHERE k > 1""")
def l12_fact_clusters(spark, sf_dir):
    return C.fact_clusters(vectors(spark, sf_dir), ["label"], 0.3, 0.95)


@query()
def l6_cosine_dedup(spark, sf_dir):
    return V.greedy_near_duplicates(vectors(spark, sf_dir).withColumn("at", F.col("id") * 7 % 1000), ["label"], "at")


@query()
def l6_cosine_dedup_low(spark, sf_dir):
    """With a lower threshold, for the random vectors of the tables."""
    return V.greedy_near_duplicates(vectors(spark, sf_dir).withColumn("at", F.col("id") * 7 % 1000), ["label"], "at", 0.4)


def order_concepts(spark, sf_dir):
    lk = M.links(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("project"), "o_orderstatus"), "record")
    outcome = F.when(F.col("o_orderstatus") == "F", "failure").otherwise("routine")
    return lk.groupBy("project", F.col("record").alias("id"), outcome.alias("outcome")).agg(F.collect_set("node").alias("concepts"))


@query()
def l13_episode_clusters(spark, sf_dir):
    return V.cluster_episodes(order_concepts(spark, sf_dir), ["project"])


@query()
def l13_episode_clusters_low(spark, sf_dir):
    return V.cluster_episodes(order_concepts(spark, sf_dir), ["project"], 0.3, 2)


_CL = "cl AS (SELECT o_custkey AS cluster, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS ok FROM orders WHERE o_custkey % 5 = 0 AND o_orderkey IN (SELECT record FROM links))"


@query(f"""WITH {M.LINKS_SQL}, {_CL}, n AS (SELECT cluster, count(*) AS n, avg(ok) AS success FROM cl GROUP BY cluster HAVING count(*) >= 3), f AS (SELECT cluster, node::varchar AS c, count(*) AS f FROM cl JOIN links ON record = id GROUP BY cluster, node),
 g AS (SELECT cluster, n, success, list_sort(list(c) FILTER (f = n)) AS every, list_sort(list(c) FILTER (f >= n * 0.6)) AS most FROM f JOIN n USING (cluster) GROUP BY ALL), k AS (SELECT *, CASE WHEN len(every) > 0 THEN every ELSE most END AS common FROM g)
 SELECT cluster, left('skill_' || array_to_string(common[1:3], '_'), 56) AS skill, array_to_string(common[1:5], ' AND ') AS trigger, floor(success * 100 + 0.5) / 100 AS success, n AS episodes, least(0.5 + 0.1 * n, 0.95)::double AS confidence FROM k WHERE len(common) > 0 AND 'skill_' || array_to_string(common[1:3], '_') <> 'skill_1'""")
def l26_skill_proposals(spark, sf_dir):
    e = order_concepts(spark, sf_dir)
    clusters = e.where("project % 5 = 0").select(F.col("project").alias("cluster"), "id")
    return C.skill_proposals(clusters, e.select("id", "concepts", "outcome"), spark.createDataFrame([("skill_1",)], "name string"))


@query(f"WITH {M.LINKS_SQL}, {_CL}, n AS (SELECT cluster, count(*) AS n FROM cl GROUP BY cluster HAVING count(*) >= 3) SELECT CASE WHEN least(0.5 + 0.1 * n, 0.95) >= 0.9 THEN 'approved' WHEN n = 3 THEN 'rejected' ELSE 'pending' END AS status, count(*) AS n FROM n GROUP BY 1")
def y33_proposal_queue(spark, sf_dir):
    """Proposals by state after a review that takes sure ones and refuses those of three episodes."""
    e = order_concepts(spark, sf_dir).where("project % 5 = 0").groupBy("project").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    status = F.when(F.least(0.5 + 0.1 * F.col("n"), F.lit(0.95)) >= 0.9, "approved").when(F.col("n") == 3, "rejected").otherwise("pending")
    return e.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


# --- entities, pronouns, blind spots -----------------------------------------------------------------


@query("""WITH t AS (SELECT vec_id AS record, 0 AS place, 'Tag' || (vec_id % 40) AS tag, embedding AS v, vec_id % 40 AS k FROM embeddings), q AS (SELECT lower(tag) AS tag, arg_min(v, record) AS v FROM t GROUP BY lower(tag)), e AS (SELECT vec_id AS id, 'Entity ' || vec_id AS name, embedding AS v FROM embeddings WHERE vec_id % 10 = 1),
 s AS (SELECT q.tag, e.id, e.name, list_cosine_similarity(q.v::double[], e.v::double[]) AS c FROM q, e), b AS (SELECT tag, lower(name) AS name FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY floor(c * 1e6 + 0.5) DESC, id) AS n FROM s WHERE c >= 0.3) WHERE n = 1)
 SELECT record, t.tag, coalesce(b.name, lower(t.tag)) AS canonical FROM t LEFT JOIN b ON b.tag = lower(t.tag)""")
def l17_entity_tags(spark, sf_dir):
    """Tags with the vector of the first record that has them; a low threshold, for random vectors."""
    v = vectors(spark, sf_dir)
    i = F.col("id")
    first = v.groupBy((i % 40).alias("k")).agg(F.min_by("v", "id").alias("qv"))
    tags = v.select(i.alias("record"), F.lit(0).alias("place"), F.concat(F.lit("Tag"), (i % 40).cast("string")).alias("tag"), (i % 40).alias("k")).join(first, "k").drop("k")
    entities = v.where(i % 10 == 1).select("id", F.concat(F.lit("Entity "), i.cast("string")).alias("name"), "v")
    return C.entity_tags(tags, entities, 0.3).select("record", "tag", "canonical")


PRONOUN_PROBES = ("It broke", "nothing said", "after that we left", "The plan", "theirs", "itself", "thatched", "HERE now")


@query("WITH d AS (SELECT doc_id AS id, " + probe_sql(PRONOUN_PROBES, "doc_id") + r""" || ' ' || regexp_replace(left(text, 60), '[^ -~]', 'x', 'g') AS t FROM documents) SELECT id, regexp_matches(t, '(?i)\b(it|its|this|that|these|those|there|then|here|he|she|him|her|them|they|their|theirs)\b') AS needed FROM d""")
def l19_coreference_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(probe(PRONOUN_PROBES, F.col("doc_id")), F.lit(" "), F.regexp_replace(F.substring("text", 1, 60), "[^ -~]", "x")).alias("t"))
    return d.select("id", C.needs_resolution(F.col("t")).alias("needed"))


@query()
def y19_blind_spots_merged(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("description"), (F.col("doc_id") % 10 / 10.0).alias("severity"))
    return C.blind_spots(d)


@query("WITH s AS (SELECT o_orderkey AS id, [(o_custkey % 40)::varchar, (o_custkey % 7)::varchar] AS domains, (o_orderkey % 10) / 10.0::double AS severity FROM orders WHERE o_orderstatus <> 'F'), q AS (SELECT n_nationkey AS qid, [n_nationkey::varchar, (n_nationkey + 10)::varchar] AS wanted FROM nation) SELECT qid, id, severity, row_number() OVER (PARTITION BY qid ORDER BY severity DESC, id) AS rank FROM q JOIN s ON len(list_intersect(domains, wanted)) > 0")
def y20_blind_spots_for_concepts(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'"), F.col("n_nationkey")
    spots = o.select(F.col("o_orderkey").alias("id"), F.explode(F.array_distinct(F.array((F.col("o_custkey") % 40).cast("string"), (F.col("o_custkey") % 7).cast("string")))).alias("domain"), (F.col("o_orderkey") % 10 / 10.0).alias("severity"))
    wanted = table(spark, sf_dir, "nation").select(k.cast("long").alias("qid"), F.explode(F.array(k.cast("string"), (k + 10).cast("string"))).alias("domain"))
    hit = spots.join(wanted, "domain").select("qid", "id", "severity").distinct()
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("severity"), "id")))


@query(f"WITH {M.LINKS_SQL}, m AS (SELECT node, count(*) AS mentions FROM links GROUP BY node) SELECT node, mentions FROM m WHERE node % 4 <> 3 ORDER BY mentions DESC, node LIMIT 20")
def y34_entity_candidates(spark, sf_dir):
    """The most mentioned nodes of entity types (types by id)."""
    m = M.links(spark, sf_dir).groupBy("node").agg(F.count(F.lit(1)).alias("mentions")).withColumn("type", F.when(F.col("node") % 4 == 3, "rule").otherwise("tool"))
    return m.where(F.col("type").isin(*B.ENTITY_TYPES)).orderBy(F.desc("mentions"), "node").limit(20).select("node", "mentions")


# --- votes and queues --------------------------------------------------------------------------------

_VOTES = "WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') - count(*) FILTER (event_type = 'error') AS importance, avg(value) / {d} AS confidence FROM events GROUP BY user_id) SELECT user_id, importance, importance >= {i} AND confidence >= {c} AS promote FROM s"


def _votes(spark, sf_dir, divisor, importance, confidence):
    k = F.col("event_type")
    s = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(k == "purchase") - F.count_if(k == "error")).alias("importance"), (F.avg("value") / divisor).alias("confidence"))
    return s.select("user_id", "importance", ((F.col("importance") >= importance) & (F.col("confidence") >= confidence)).alias("promote"))


@query(_VOTES.format(d=55, i=5, c=0.8))
def l20_insight_votes(spark, sf_dir):
    return _votes(spark, sf_dir, 55, 5, 0.8)


_QUEUE = """q AS (SELECT event_id AS id, CASE WHEN event_type IN ('view', 'signup') THEN 'pending' WHEN event_type = 'click' THEN 'processing' ELSE 'done' END AS status, (event_id % 4)::int AS attempts, ts AS enqueued, CASE WHEN event_type = 'click' THEN timestamp '2024-01-31' - to_seconds((event_id % 120)::bigint) END AS started FROM events),
 r AS (SELECT *, status = 'processing' AND started < timestamp '2024-01-31' - INTERVAL 60 SECOND AS stale FROM q), p AS (SELECT id, CASE WHEN stale THEN 'pending' ELSE status END AS status, attempts, enqueued, stale FROM r),
 c AS (SELECT id FROM p WHERE status = 'pending' ORDER BY enqueued, id LIMIT 200), t AS (SELECT p.*, c.id IS NOT NULL AS taken, attempts + (c.id IS NOT NULL)::int AS tries FROM p LEFT JOIN c USING (id))"""


def work_queue(spark, sf_dir):
    k, i = F.col("event_type"), F.col("event_id")
    status = F.when(k.isin("view", "signup"), "pending").when(k == "click", "processing").otherwise("done")
    now = F.lit("2024-01-31").cast("timestamp")
    started = F.when(k == "click", F.timestamp_seconds(F.unix_timestamp(now) - i % 120))
    none = F.lit(None)
    return table(spark, sf_dir, "events").select(i.alias("id"), status.alias("status"), (i % 4).cast("int").alias("attempts"), F.col("ts").cast("timestamp").alias("enqueued_at"), started.alias("started_at"), none.cast("timestamp").alias("finished_at"), none.cast("string").alias("last_error")), now


@query(f"WITH {_QUEUE} SELECT id, CASE WHEN NOT taken THEN status WHEN id % 3 <> 0 THEN 'done' WHEN tries >= 3 THEN 'failed' ELSE 'pending' END AS status, tries AS attempts, CASE WHEN taken AND id % 3 = 0 THEN 'broken' WHEN taken THEN NULL WHEN stale THEN 'reclaimed: previous worker did not finish in time' END AS last_error FROM t")
def l23_z6_queue_cycle(spark, sf_dir):
    """Stale work is reclaimed, the oldest 200 tasks are claimed, every third of them fails."""
    q, now = work_queue(spark, sf_dir)
    work = lambda d: d.select("id", (F.col("id") % 3 != 0).alias("ok"), F.lit("broken").alias("error"))
    return Q.run_once(q, work, now, 200).select("id", "status", "attempts", "last_error")


@query("""WITH l AS (SELECT user_id AS id, event_id AS seq, ts AS t, CASE event_type WHEN 'signup' THEN 'enqueued' WHEN 'view' THEN 'claimed' WHEN 'click' THEN 'claimed' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS event FROM events),
 s AS (SELECT id, count(*) FILTER (event = 'claimed') AS attempts, arg_max(event, (t, seq)) AS last, max(t) AS changed FROM l GROUP BY id) SELECT id, attempts::int AS attempts, CASE WHEN last = 'done' THEN 'done' WHEN last = 'failed' AND attempts >= 3 THEN 'failed' WHEN last = 'claimed' AND changed >= timestamp '2024-01-30 12:00:00' THEN 'processing' ELSE 'pending' END AS status FROM s""")
def l23_queue_replay(spark, sf_dir):
    k = F.col("event_type")
    event = F.when(k == "signup", "enqueued").when(k.isin("view", "click"), "claimed").when(k == "purchase", "done").otherwise("failed")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), event.alias("event"))
    return Q.replay(log, F.lit("2024-01-31").cast("timestamp"), 3, 43200).select("id", "attempts", "status")


# --- building the graph ------------------------------------------------------------------------------


@query("""WITH o AS (SELECT lower(trim(s_name)) AS s, lower(p_brand) AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey), e AS (SELECT s AS source, p AS target, count(*) AS n FROM o GROUP BY ALL) SELECT source, target, 'makes' AS relation, least(10.0, 1.0 + 0.1 * (n - 1))::double AS weight FROM e""")
def g3_atomic_links(spark, sf_dir):
    li, s, p = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    o = li.join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey)
    seen = o.select(F.concat(F.lit(" "), F.col("s_name")).alias("source"), F.lit("company").alias("source_type"), F.col("p_brand").alias("target"), F.lit("concept").alias("target_type"), F.lit("makes").alias("relation"))
    return B.atomic_links(seen)[1].select("source", "target", "relation", "weight")


_LK = "lk AS (SELECT l_orderkey % (SELECT count(*) FROM documents) AS record, l_partkey % 40 AS node FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 17 = 0 GROUP BY ALL)"


def record_links(spark, sf_dir):
    """Links of records to nodes, from order lines."""
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))  # one row
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2 AND l_orderkey % 17 = 0").crossJoin(n)
    return li.select((F.col("l_orderkey") % F.col("n")).alias("record"), (F.col("l_partkey") % 40).alias("node")).distinct()


@query(f"""WITH {REC}, {_LK}, t AS (SELECT id, session_id // 2 AS project, list_distinct(tags) AS s FROM records WHERE status = 'active'), al AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::double AS j FROM t a JOIN t b ON a.project = b.project AND a.id < b.id),
 h AS (SELECT record, node FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY node) AS n FROM lk) WHERE n <= 3), m AS (SELECT a, b, j, x.node AS x, y.node AS y FROM al JOIN h x ON x.record = a JOIN h y ON y.record = b WHERE j >= 0.3 AND x.node <> y.node),
 k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY x, y) AS n FROM m) SELECT least(x, y) AS source, greatest(x, y) AS target, max(floor(j * 200 + 0.5) / 100) AS weight FROM k WHERE n <= 5 GROUP BY ALL""")
def g17_semantic_edges(spark, sf_dir):
    r = rec(spark, sf_dir).withColumn("project", F.floor(F.col("session_id") / 2).cast("string"))
    return B.semantic_edges(r, record_links(spark, sf_dir)).select("source", "target", "weight")


@query(f"""WITH {REC}, {_LK}, a AS (SELECT id, session_id FROM records WHERE status = 'active'), s AS (SELECT session_id FROM a GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), n AS (SELECT DISTINCT session_id, node FROM a JOIN s USING (session_id) JOIN lk ON record = id), c AS (SELECT session_id, count(*) AS k FROM n GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30),
 p AS (SELECT x.session_id, k, x.node AS source, y.node AS target, row_number() OVER (PARTITION BY x.session_id ORDER BY x.node, y.node) AS r FROM n x JOIN n y ON x.session_id = y.session_id AND x.node < y.node JOIN c ON c.session_id = x.session_id) SELECT DISTINCT source, target FROM p WHERE r <= least(2 * k, 20)""")
def g18_session_edges(spark, sf_dir):
    return B.session_edges(rec(spark, sf_dir), record_links(spark, sf_dir)).select("source", "target")


@query(f"""WITH {REC}, {_LK}, a AS (SELECT * FROM records WHERE status = 'active'), h AS (SELECT record, node FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY node) AS n FROM lk) WHERE n <= 3),
 m AS (SELECT s.id AS a, e.id AS b, x.node AS source, y.node AS target FROM a s JOIN a e ON s.session_id = e.session_id AND s.type = 'solution' AND e.type IN ('lesson', 'fact') AND (e.id % 2 = 0 OR regexp_matches(lower(e.content), 'error|fix|bug|issue|problem')) JOIN h x ON x.record = s.id JOIN h y ON y.record = e.id WHERE x.node <> y.node)
 SELECT DISTINCT source, target FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY source, target) AS n FROM m) WHERE n <= 5""")
def g18_solution_edges(spark, sf_dir):
    told = F.when(F.col("id") % 2 == 0, F.concat("content", F.lit(" a Bug"))).otherwise(F.col("content"))
    return B.solution_edges(rec(spark, sf_dir).withColumn("content", told), record_links(spark, sf_dir)).select("source", "target")


TECHNOLOGIES = ("php", "symfony", "vue", "typescript", "python", "redis", "grpc", "protobuf", "docker", "css", "unknown")


@query("WITH t AS (SELECT unnest(['php', 'symfony', 'vue', 'typescript', 'python', 'redis', 'grpc', 'protobuf', 'docker', 'css', 'unknown']) AS n), c(target, source) AS (VALUES ('backend', 'php'), ('backend', 'symfony'), ('backend', 'python'), ('backend', 'grpc'), ('backend', 'protobuf'), ('frontend', 'vue'), ('frontend', 'typescript'), ('database', 'redis'), ('devops', 'docker'), ('messaging', 'grpc')), d(source, target) AS (VALUES ('symfony', 'php'), ('vue', 'typescript'), ('protobuf', 'grpc')) SELECT source, target, 'part_of' AS relation, 2.0::double AS weight FROM c UNION ALL SELECT source, target, 'depends_on', 3.0 FROM d")
def g19_hierarchy_edges(spark, sf_dir):
    return B.hierarchy_edges(spark.createDataFrame([(t,) for t in TECHNOLOGIES], "name string"))


#: Names that words and runs of words of the texts may be.
ORPHAN_NAMES = ("the", "of_the", "and the", "for", "src1", "tag0", "zzz")


@query(f"""WITH {REC}, {_LK}, o AS (SELECT * FROM records WHERE status = 'active' AND id NOT IN (SELECT record FROM lk)), nm AS (SELECT unnest({list(ORPHAN_NAMES)}) AS name), tk AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]{{2,}}')) AS name FROM o),
 w AS (SELECT id, ' ' || array_to_string(list_filter(string_split(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''), ' ') || ' ' AS t FROM o),
 e AS (SELECT id, name, 'mentions' AS role, 0.7 AS strength, 0 AS turn FROM tk JOIN nm USING (name) UNION ALL SELECT id, name, 'mentions', 0.8, 1 FROM w JOIN nm ON regexp_matches(name, '[ _-]') AND contains(t, ' ' || replace(replace(name, '_', ' '), '-', ' ') || ' ') UNION ALL SELECT id, lower(project), 'belongs_to', 1.0, 2 FROM o WHERE project <> 'general'
  UNION ALL SELECT id, lower(replace(unnest(tags), '-', '_')), 'tagged', 0.8, 3 FROM o) SELECT id, name, arg_min(role, turn) AS role, arg_min(strength, turn)::double AS strength FROM e GROUP BY id, name""")
def g20_orphan_links(spark, sf_dir):
    return B.orphan_links(rec(spark, sf_dir), record_links(spark, sf_dir), spark.createDataFrame([(t,) for t in ORPHAN_NAMES], "name string"))


_CHAIN = "SELECT {by} AS g, id, lead(id) OVER w AS nx, row_number() OVER w AS place, count(*) OVER (PARTITION BY {by}) AS n FROM {rows} WINDOW w AS (PARTITION BY {by} ORDER BY recall_count DESC, created_at DESC, id)"


@query(f"""WITH {REC}, s AS (SELECT * FROM records WHERE status = 'active' ORDER BY recall_count DESC, created_at DESC, id LIMIT 300), tg AS (SELECT id, recall_count, created_at, unnest(tags) AS tag FROM s), c AS (SELECT nx, id, 0 AS turn, 'co-session' AS type FROM ({_CHAIN.format(by='session_id', rows='s')}) WHERE nx IS NOT NULL AND n BETWEEN 2 AND 8 AND place <= 3
 UNION ALL SELECT nx, id, 1, 'shared-tag:' || g FROM ({_CHAIN.format(by='tag', rows='tg')}) WHERE nx IS NOT NULL AND n BETWEEN 2 AND 15 AND place <= 4 UNION ALL SELECT nx, id, 2, 'same-project' FROM ({_CHAIN.format(by='project', rows='s')}) WHERE nx IS NOT NULL AND n >= 2 AND place <= 5)
 SELECT least(id, nx) AS a, greatest(id, nx) AS b, arg_min(type, (turn, type)) AS type FROM c GROUP BY 1, 2""")
def g22_display_graph(spark, sf_dir):
    return B.display_edges(rec(spark, sf_dir), 300)


@query(f"""WITH {_LK}, n AS (SELECT record, node, row_number() OVER (PARTITION BY record ORDER BY node) AS r FROM lk WHERE node % 4 <> 3 AND record IN (SELECT doc_id FROM documents)) SELECT node AS source, 'save:' || record AS target, 'MENTIONED_IN' AS relation FROM n WHERE r <= 12""")
def g25_event_links(spark, sf_dir):
    lk = record_links(spark, sf_dir)
    nodes = lk.select("node").distinct().withColumn("type", F.when(F.col("node") % 4 == 3, "rule").otherwise("tool"))
    return B.event_links(rec(spark, sf_dir), lk, nodes).select("source", "target", "relation")


@query("""WITH a AS (SELECT l_orderkey AS id, l_partkey % 12 AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'C' || l_partkey % 12) AS n FROM lineitem WHERE l_linenumber <= 5), k AS (SELECT DISTINCT id, c FROM a WHERE c < 10 AND n <= 5), p AS (SELECT x.c AS source, y.c AS target, count(*) AS n FROM k x JOIN k y ON x.id = y.id AND x.c < y.c GROUP BY ALL) SELECT source, target, least(10.0, 0.3 + 0.1 * (n - 1))::double AS weight FROM p""")
def l28_competence_edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 5")
    ordered = F.sort_array(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("C"), (F.col("l_partkey") % 12).cast("string")).alias("c"))))
    actions = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(ordered, lambda x: x["c"]).alias("concepts"))
    nodes = spark.range(10).select(F.col("id").alias("node"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"))
    return B.competence_edges(actions, nodes).select("source", "target", M.rounded(F.col("weight")).alias("weight"))


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber > 1 THEN l_orderkey * 10 + 1 END AS parent, CASE WHEN l_linenumber > 1 THEN l_orderkey * 10 + l_linenumber - 1 END AS prev, CASE WHEN l_linenumber % 2 = 0 THEN 'src/' || l_partkey || '.py' END AS f, CASE WHEN l_linenumber % 3 = 0 THEN 'Fn' || l_suppkey END AS sym, CASE WHEN l_linenumber = 1 THEN 'general' ELSE 'p' || l_suppkey % 3 END AS project, l_returnflag AS tag FROM lineitem)
 SELECT id, 'k-' || parent AS target, 'parent' AS role FROM c WHERE parent IS NOT NULL UNION SELECT id, 'k-' || prev, 'next' FROM c WHERE prev IS NOT NULL UNION SELECT id, f, 'from_file' FROM c WHERE f IS NOT NULL UNION SELECT id, lower(sym), 'defines' FROM c WHERE sym IS NOT NULL UNION SELECT id, project, 'belongs_to' FROM c WHERE project <> 'general' UNION SELECT id, lower(tag), 'tagged' FROM c""")
def y8_base_links(spark, sf_dir):
    n, k = F.col("l_linenumber"), F.col("l_orderkey") * 10
    s = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    c = table(spark, sf_dir, "lineitem").select((k + n).alias("id"), F.when(n > 1, k + 1).alias("parent_id"), F.when(n > 1, k + n - 1).alias("prev_id"), F.when(n % 2 == 0, s("src/", F.col("l_partkey"), ".py")).alias("file_path"), F.when(n % 3 == 0, s("Fn", F.col("l_suppkey"))).alias("symbol"), F.when(n == 1, "general").otherwise(s("p", F.col("l_suppkey") % 3)).alias("project"), F.array("l_returnflag").alias("tags"))
    return B.base_links(c)


@query(f"""WITH {REC}, {_LK}, nm AS (SELECT unnest({list(ORPHAN_NAMES)}) AS name, unnest(range(1000, {1000 + len(ORPHAN_NAMES)})) AS node), o AS (SELECT * FROM records WHERE status = 'active' AND id NOT IN (SELECT record FROM lk)), tk AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]{{2,}}')) AS name FROM o),
 w AS (SELECT id, ' ' || array_to_string(list_filter(string_split(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''), ' ') || ' ' AS t FROM o),
 e AS (SELECT id, name FROM tk UNION SELECT id, name FROM w JOIN nm ON regexp_matches(name, '[ _-]') AND contains(t, ' ' || replace(replace(name, '_', ' '), '-', ' ') || ' ') UNION SELECT id, lower(project) FROM o UNION SELECT id, lower(replace(unnest(tags), '-', '_')) FROM o),
 a AS (SELECT id AS record, node FROM e JOIN nm USING (name) UNION SELECT record, node FROM lk) SELECT x.node AS source, y.node AS target, least(0.2 * count(*), 3.0)::double AS weight FROM a x JOIN a y ON x.record = y.record AND x.node < y.node GROUP BY ALL""")
def y9_backfilled_edges(spark, sf_dir):
    nodes = spark.createDataFrame([(1000 + n, t) for n, t in enumerate(ORPHAN_NAMES)], "node long, name string")
    return B.backfilled(rec(spark, sf_dir), record_links(spark, sf_dir).withColumn("strength", F.lit(1.0)), nodes)[1].select("source", "target", M.rounded(F.col("weight")).alias("weight"))
