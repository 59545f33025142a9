"""Expansion, look-ups, listings, filters of logs, and the remaining record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import model as M
from tessella.functions import text as X
from tessella.operators import analytics as A
from tessella.operators import graph as G
from tessella.operators import retrieval as V
from tessella.plans.registry import query
from tessella.session import table

R = M.rounded_sql
REC = M.RECORDS_SQL
REL = "rel AS (SELECT ps_a AS source, ps_b AS target FROM (SELECT l_partkey AS ps_a, l_suppkey + 100000 AS ps_b FROM lineitem GROUP BY ALL))"
HIT = "hits AS (SELECT n_nationkey AS qid, n_nationkey * 3 + 1 AS id, 1.0::double / (1 + n_nationkey) AS score FROM nation)"


def rel(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("source"), (F.col("l_suppkey") + 100000).alias("target")).distinct()


def hits(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(k.alias("qid"), (k * 3 + 1).alias("id"), (F.lit(1.0) / (1 + k)).alias("score"))


def rec(spark, sf_dir):
    return M.records(spark, sf_dir)


@query(f"WITH {REL}, {HIT}, b AS (SELECT source, target FROM rel UNION SELECT target, source FROM rel) SELECT qid, target AS id, {R('max(score * 0.4)')} AS score FROM hits JOIN b ON b.source = hits.id GROUP BY qid, target")
def r12_relation_expansion(spark, sf_dir):
    return V.one_hop(hits(spark, sf_dir), rel(spark, sf_dir)).select("qid", "id", M.rounded(F.col("score")).alias("score"))


@query(f"""WITH {REL}, {HIT}, b AS (SELECT source, target FROM rel UNION SELECT target, source FROM rel),
 h1 AS (SELECT qid, target AS id, max(score * 0.4) AS score FROM hits JOIN b ON b.source = hits.id GROUP BY qid, target),
 h2 AS (SELECT qid, target AS id, max(score * 0.2) AS score FROM h1 JOIN b ON b.source = h1.id WHERE NOT EXISTS (SELECT 1 FROM hits x WHERE x.qid = h1.qid AND x.id = target) AND NOT EXISTS (SELECT 1 FROM h1 y WHERE y.qid = h1.qid AND y.id = target) GROUP BY qid, target)
 SELECT qid, id, {R('score')} AS score, 0 AS hop FROM hits UNION ALL SELECT qid, id, {R('score')}, 1 FROM h1 UNION ALL SELECT qid, id, {R('score')}, 2 FROM h2""")
def r13_multi_hop_expansion(spark, sf_dir):
    return V.multi_hop(hits(spark, sf_dir), rel(spark, sf_dir)).select("qid", "id", M.rounded(F.col("score")).alias("score"), "hop")


@query(f"WITH {REC}, v AS (SELECT id, CASE WHEN id % 4 = 0 THEN sha256(content || '!') ELSE sha256(content) END AS h, content FROM records) SELECT id, h <> sha256(content) AS drift, CASE WHEN h <> sha256(content) THEN 0.15 ELSE 0.5 END::double AS score FROM v")
def r17_drift_penalty(spark, sf_dir):
    c = F.when(F.col("id") % 4 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    views = rec(spark, sf_dir).select("id", F.sha2(c, 256).alias("parent_hash"), F.lit(0.5).alias("score"))
    return V.drifted(views, rec(spark, sf_dir))


@query(f"WITH {REC} SELECT id, {R(f'0.5 * least(confidence / 5.0, 1.0) + 0.5 * greatest(0.0, 1.0 - abs(floor(epoch(timestamp {chr(39)}2024-03-01{chr(39)} - created_at) / 86400)) / 180.0)')} AS score FROM records")
def r18_temporal_rerank(spark, sf_dir):
    days = F.abs(F.floor((F.unix_timestamp(F.lit("2024-03-01").cast("timestamp")) - F.unix_timestamp("created_at")) / 86400))
    r = rec(spark, sf_dir).withColumn("score", F.col("confidence"))
    return r.select("id", M.rounded(V.temporal_rerank(r, days)).alias("score"))


@query(f"""WITH {M.EDGES_SQL}, {M.LINKS_SQL}, b AS (SELECT source, target, weight, n FROM edges UNION ALL SELECT target, source, weight, n FROM edges),
 near AS (SELECT target AS node, max(0.8 * CASE WHEN weight > 1 THEN least(weight / 10, 1.0) ELSE weight END * greatest(0.05, least(1.0, pow(2.0, -n / 60.0::double)))) AS s FROM b WHERE source IN (1, 2, 3) GROUP BY target)
 SELECT record, {R('sum(s * strength)', 5)} AS score FROM near JOIN links ON links.node + 1000000 = near.node GROUP BY record""")
def r26_context_expansion(spark, sf_dir):
    seeds = spark.createDataFrame([(i, 0.8) for i in (1, 2, 3)], "node long, score double")
    links = M.links(spark, sf_dir).withColumn("node", F.col("node") + 1_000_000)
    out = V.context_expansion(seeds, M.edges(spark, sf_dir).withColumn("days", F.col("n")), links)
    return out.select("record", M.rounded(F.col("score"), 5).alias("score"))


@query(f"""WITH {M.EDGES_SQL} SELECT s_name AS entity, relation, target, weight FROM edges JOIN supplier ON s_suppkey = source WHERE relation LIKE '%depend%' QUALIFY row_number() OVER (PARTITION BY s_name ORDER BY weight DESC, target) <= 3""")
def r33_fact_lookup(spark, sf_dir):
    e = M.edges(spark, sf_dir).where(F.col("relation").contains("depend")).join(table(spark, sf_dir, "supplier"), F.col("source") == F.col("s_suppkey"))
    return A.ranked(e, ["s_name"], [F.desc("weight"), "target"], 3).select(F.col("s_name").alias("entity"), "relation", "target", "weight")


@query("SELECT user_id, event_id FROM events WHERE (props ->> 'k')::int = 7 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def r36_y44_event_search(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k") == "7")
    return A.ranked(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query()
def r29_set_cover(spark, sf_dir):
    lk = M.links(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("qid")), "record")
    sources = lk.select("qid", F.col("record").alias("id"), F.col("node").alias("concept"))
    return V.set_cover(sources.select("qid", "concept").distinct(), sources)


@query(f"""WITH t AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS trig, p_size / 50.0::double AS rate FROM part), q AS (SELECT p_partkey AS qid, list_append(string_split(lower(p_name), ' '), 'please') AS w FROM part WHERE p_partkey % 100 = 0),
 s AS (SELECT qid, id, 0.7 * len(list_intersect(trig, w)) / len(trig)::double + 0.3 * len(list_intersect(trig, w)) / len(w)::double + 0.05 * rate AS score FROM t, q)
 SELECT qid, id, {R('score')} AS score FROM s WHERE score >= 0.3""")
def r32_skill_triggers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = p.select(F.col("p_partkey").alias("id"), X.words(F.col("p_name")).alias("trig"), (F.col("p_size") / 50.0).alias("rate"))
    q = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("qid"), F.array_append(X.words(F.col("p_name")), F.lit("please")).alias("w"))
    return V.triggered(q, t, 0.3, M.rounded)


@query("SELECT event_id, strptime(regexp_extract(t, '^\\[([^\\]]+)\\]', 1), '%I:%M %p on %-d %B, %Y') AS day FROM (SELECT event_id, strftime(ts, '[%I:%M %p on %-d %B, %Y] said') AS t FROM events)")
def d15_entry_prefix(spark, sf_dir):
    t = F.date_format("ts", "'['hh:mm a 'on' d MMMM, yyyy'] said'")
    return table(spark, sf_dir, "events").select("event_id", F.to_timestamp(F.regexp_extract(t, r"^\[([^\]]+)\]", 1), "hh:mm a 'on' d MMMM, yyyy").alias("day"))


@query(f"""WITH {REC}, {M.LINKS_SQL}, x AS (SELECT a.node AS node, b.node AS peer FROM links a JOIN links b ON a.record = b.record AND a.node <> b.node) SELECT node, count(DISTINCT peer) AS peers FROM x GROUP BY node""")
def j16_peers(spark, sf_dir):
    lk = M.links(spark, sf_dir).select("record", "node").distinct()
    return lk.join(lk.withColumnRenamed("node", "peer"), "record").where("node <> peer").groupBy("node").agg(F.count_distinct("peer").alias("peers"))


@query(f"""WITH {M.EDGES_SQL}, t AS (SELECT DISTINCT source, target % 97 AS target, relation FROM edges), h AS (SELECT DISTINCT a.source, a.relation, b.target FROM t a JOIN t b ON a.target = b.source AND a.relation = b.relation AND a.source <> b.target)
 SELECT source, relation, target, sha256(source || '|' || relation || '|' || target) AS hash, 0.6::double AS confidence FROM h WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.source = h.source AND t.relation = h.relation AND t.target = h.target)""")
def j8_g14_transitive_facts(spark, sf_dir):
    t = M.edges(spark, sf_dir).select("source", (F.col("target") % 97).alias("target"), "relation").distinct()
    b = t.select(F.col("source").alias("via"), "relation", F.col("target").alias("end"))
    h = t.select("source", "relation", F.col("target").alias("via")).join(b, ["via", "relation"]).where("source <> end").select("source", "relation", F.col("end").alias("target")).distinct()
    key = F.sha2(F.concat_ws("|", F.col("source").cast("string"), "relation", F.col("target").cast("string")), 256)
    return h.join(t, ["source", "relation", "target"], "left_anti").withColumn("hash", key).withColumn("confidence", F.lit(0.6))


@query(f"WITH {M.EDGES_SQL} SELECT relation, floor(weight)::bigint AS bin, count(*) AS n FROM edges GROUP BY ALL")
def g21_weight_histogram(spark, sf_dir):
    return M.edges(spark, sf_dir).groupBy("relation", F.floor("weight").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {M.EDGES_SQL}, d AS (SELECT * FROM edges WHERE n >= 8), v AS (SELECT source AS id FROM d UNION SELECT target FROM d) SELECT 'edge' AS part, source AS id, target AS other, relation FROM d UNION ALL SELECT 'node', id, NULL, NULL FROM v")
def g21_delta_view(spark, sf_dir):
    """Edges that changed (here: were seen eight times), with the nodes at their ends."""
    d = M.edges(spark, sf_dir).where("n >= 8")
    nodes = G.nodes_of(d).select(F.lit("node").alias("part"), F.col("node").alias("id"), F.lit(None).cast("long").alias("other"), F.lit(None).cast("string").alias("relation"))
    return d.select(F.lit("edge").alias("part"), F.col("source").alias("id"), F.col("target").alias("other"), "relation").unionByName(nodes)


@query(f"WITH {M.EDGES_SQL} SELECT source, target, {R('max(weight)')} AS cell FROM edges WHERE source % 5 = 0 AND target % 5 = 0 AND source IN (SELECT source FROM edges WHERE n >= 4) GROUP BY ALL")
def g21_adjacency_matrix(spark, sf_dir):
    """Cells of the matrix of chosen nodes."""
    e = M.edges(spark, sf_dir)
    nodes = G.nodes_of(e).where("node % 5 = 0").join(e.where("n >= 4").select(F.col("source").alias("node")).union(e.where("target % 5 = 0").select("target")).distinct(), "node", "left_semi")
    return G.induced(e, nodes).groupBy("source", "target").agg(M.rounded(F.max("weight")).alias("cell"))




@query(f"WITH {M.EDGES_SQL} SELECT source, target, relation, {R('greatest(weight - 0.5, 0.0)')} AS weight FROM edges WHERE weight - 0.5 >= 0.6")
def g15_g23_weaken_and_prune(spark, sf_dir):
    w = F.greatest(F.col("weight") - 0.5, F.lit(0.0))
    return M.edges(spark, sf_dir).where("weight - 0.5D >= 0.6D").select("source", "target", "relation", M.rounded(w).alias("weight"))


@query("SELECT DISTINCT CASE WHEN l_suppkey % 10 = 3 THEN l_suppkey - 1 ELSE l_suppkey END AS entity, l_partkey % 40 AS alias FROM lineitem")
def l15_merge_canonicals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), (F.col("l_partkey") % 40).alias("alias"))
    into = li.select("entity").distinct().where("entity % 10 = 3").select("entity", (F.col("entity") - 1).alias("into"))
    return li.join(into, "entity", "left").select(F.coalesce("into", "entity").alias("entity"), "alias").distinct()


@query("SELECT user_id, count(*) AS recall_count, max(ts) AS last_recalled FROM events WHERE event_type = 'view' GROUP BY user_id")
def l21_bump_recall(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count(F.lit(1)).alias("recall_count"), F.max("ts").alias("last_recalled"))


@query("SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS predicate FROM part")
def l27_predicate_normalisation(spark, sf_dir):
    p = F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), p.alias("predicate"))


#: Names of one to three words that the texts may speak of.
CONCEPTS = ("the", "of the", "die", "und die", "in the and", "les", "zzz", "and")


@query(f"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}') AS w FROM documents), r AS (SELECT DISTINCT id, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS concept FROM d)
 SELECT id, concept FROM r WHERE concept IN {CONCEPTS}""")
def x13_concept_extraction(spark, sf_dir):
    """Names of a dictionary as runs of one to three words: runs are joined with the dictionary by equality."""
    w = X.tokens(F.col("text"), 2)
    runs = X.let(w, lambda t: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t))), lambda i: i + n - 1 <= F.size(t)), lambda i: F.array_join(F.slice(t, i, n), " "))))))
    names = spark.createDataFrame([(c,) for c in CONCEPTS], "concept string")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(runs).alias("concept")).join(names, "concept").select("id", "concept")



@query(f"WITH {REC} SELECT id, upper(substring(type, 1, 1)) || ':' || project || ':' || replace(substring(content, 1, 40), chr(10), ' ') AS compact FROM records")
def x17_compact_record(spark, sf_dir):
    head = F.replace(F.substring("content", 1, 40), F.lit("\n"), F.lit(" "))
    return rec(spark, sf_dir).select("id", F.concat_ws(":", F.upper(F.substring("type", 1, 1)), "project", head).alias("compact"))


@query("SELECT item_id AS id, list_distinct(regexp_extract_all(text, '[A-Z][a-z0-9]+')) AS names FROM (SELECT item_id, text FROM benchmark)".replace("list_distinct(", "list_sort(list_distinct(").replace(") AS names", ")) AS names"))
def x20_entity_candidates(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.sort_array(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z0-9]+"), F.lit(0)))).alias("names"))


@query("SELECT item_id AS id, regexp_matches(lower(text), ' and | or | then |compare|versus') AS decomposable FROM benchmark")
def y36_decomposable(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lower("text").rlike(" and | or | then |compare|versus").alias("decomposable"))


@query(f"WITH {REC} SELECT project, id, confidence, recall_count FROM records WHERE type = 'solution' AND contains(content, 'th') QUALIFY row_number() OVER (PARTITION BY project ORDER BY confidence DESC, recall_count DESC, id) <= 10")
def y1_y2_y3_top_for_concepts(spark, sf_dir):
    r = rec(spark, sf_dir).where((F.col("type") == "solution") & F.col("content").contains("th"))
    return A.ranked(r, ["project"], [F.desc("confidence"), F.desc("recall_count"), "id"], 10).select("project", "id", "confidence", "recall_count")


@query("SELECT s_suppkey AS node, s_name FROM supplier WHERE s_name LIKE '%00001%' ORDER BY s_name LIMIT 50")
def y10_node_search(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where(F.col("s_name").contains("00001")).orderBy("s_name").limit(50).select(F.col("s_suppkey").alias("node"), "s_name")


@query("""WITH s AS (SELECT c.conv_id, count(*) AS turns, arg_max(text, turn) FILTER (role = 'assistant') AS last FROM conversations c GROUP BY c.conv_id), k AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'continued ' || conv_id END AS continuity FROM s),
 r AS (SELECT conv_id, string_agg(turn::varchar, ',' ORDER BY turn DESC) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 100 GROUP BY conv_id) SELECT conv_id, turns, coalesce(continuity, last) AS summary, newest FROM s JOIN k USING (conv_id) JOIN r USING (conv_id)""")
def y12_y29_session_citation(spark, sf_dir):
    """A session's summary, its continuity note first, and its newest hundred entries."""
    c = table(spark, sf_dir, "conversations")
    said = F.when(F.col("role") == "assistant", F.col("turn"))
    notes = c.where("conv_id % 3 = 0").select("conv_id", F.concat(F.lit("continued "), F.col("conv_id").cast("string")).alias("note")).distinct()
    s = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max_by(F.when(F.col("role") == "assistant", F.col("text")), said).alias("last"))
    newest = A.ranked(c, ["conv_id"], [F.desc("turn")], 100).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("turn"), asc=False), lambda t: t.cast("string")), ",").alias("newest"))
    return s.join(notes, "conv_id", "left").join(newest, "conv_id").select("conv_id", "turns", F.coalesce("note", "last").alias("summary"), "newest")



@query(f"WITH {REC} SELECT count(*) AS n, {R('avg(confidence)', 4)} AS mean_confidence, count(*) FILTER (type = 'lesson') AS lessons, count(*) FILTER (superseded_by IS NOT NULL) AS replaced FROM records")
def y15_y41_summary(spark, sf_dir):
    return rec(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), M.rounded(F.avg("confidence"), 4).alias("mean_confidence"), F.count_if(F.col("type") == "lesson").alias("lessons"), F.count_if(F.col("superseded_by").isNotNull()).alias("replaced"))


@query("SELECT date_trunc('day', ts)::timestamp AS day, user_id, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 2")
def z5_error_bursts(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), "user_id").agg(F.count(F.lit(1)).alias("errors")).where("errors >= 2")
