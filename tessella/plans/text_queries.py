"""Filters, projections, text functions and lifecycle queries on records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import model as M
from tessella.functions import chunkers as K
from tessella.functions import text as X
from tessella.operators import consolidate as C
from tessella.operators import lifecycle as L
from tessella.operators.graph import cut
from tessella.plans.registry import query
from tessella.session import table

R = M.rounded_sql
REC = M.RECORDS_SQL
AGE = f"floor(epoch(timestamp '{M.AS_OF}' - {{}}) / 86400)"


def rec(spark, sf_dir):
    return M.records(spark, sf_dir)


def as_of():
    return F.lit(M.AS_OF).cast("timestamp")


@query(f"WITH {REC} SELECT id, type, project FROM records WHERE status = 'active' AND type IN ('solution', 'decision') AND (branch = 'en' OR branch = '') AND project <> 'src0'")
def p1_conjunctive_filter(spark, sf_dir):
    return rec(spark, sf_dir).where((F.col("status") == "active") & F.col("type").isin("solution", "decision") & F.col("branch").isin("en", "") & (F.col("project") != "src0")).select("id", "type", "project")


@query(f"WITH {REC} SELECT id, created_at FROM records WHERE content LIKE '%the%' ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def p2_paged_listing(spark, sf_dir):
    return rec(spark, sf_dir).where(F.col("content").contains("the")).orderBy(F.desc("created_at"), "id").offset(40).limit(20).select("id", "created_at")


@query(f"WITH {REC} SELECT id FROM records WHERE len(list_filter(tags, lambda t: contains(lower(t), 'topic3'))) > 0")
def p3_tag_search(spark, sf_dir):
    return rec(spark, sf_dir).where(F.exists("tags", lambda t: F.lower(t).contains("topic3"))).select("id")


@query(f"WITH {REC} SELECT id FROM records WHERE NOT contains(lower(array_to_string(tags, '\",\"')), 'tag1') ")
def p4_excluded_tags(spark, sf_dir):
    return rec(spark, sf_dir).where(~F.lower(F.to_json("tags")).contains("tag1")).select("id")


@query("SELECT vec_id AS id FROM embeddings WHERE label IN (1, 4, 7)")
def p5_embedding_space_filter(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 4, 7)).select(F.col("vec_id").alias("id"))


@query(f"WITH {REC} SELECT id FROM records WHERE created_at <= timestamp '2024-03-01' AND coalesce(last_recalled, created_at) >= timestamp '2024-02-01'")
def p7_date_filter(spark, sf_dir):
    return rec(spark, sf_dir).where((F.col("created_at") <= F.lit("2024-03-01").cast("timestamp")) & (F.coalesce("last_recalled", "created_at") >= F.lit("2024-02-01").cast("timestamp"))).select("id")


@query(f"WITH {REC} SELECT id, substring(content, 1, 80) AS compact, substring(content, 1, 150) AS summary FROM records")
def p8_detail_projection(spark, sf_dir):
    return rec(spark, sf_dir).select("id", F.substring("content", 1, 80).alias("compact"), F.substring("content", 1, 150).alias("summary"))


@query(f"WITH {REC} SELECT id, list_filter(string_split(content, chr(10)), lambda s: trim(s) <> '')[1] AS headline, type FROM records")
def p9_index_view(spark, sf_dir):
    lines = F.filter(F.split("content", "\n", -1), lambda s: F.trim(s) != "")
    return rec(spark, sf_dir).select("id", F.get(lines, F.lit(0)).alias("headline"), "type")


WORDS = "list_filter(regexp_split_to_array(lower({}), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"


@query(f"""SELECT item_id AS id, CASE WHEN regexp_matches(text, 'https?://|[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+|:[0-9]+|[A-Za-z_]+\\(\\)') OR len({WORDS.format('text')}) >= 10 THEN 'full' WHEN len({WORDS.format('text')}) <= 3 THEN 'compact' ELSE 'summary' END AS verbosity FROM benchmark""")
def p10_verbosity(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), X.verbosity(F.col("text")).alias("verbosity"))


@query("""SELECT conv_id, turn, regexp_replace(t, '(?s)<private>.*?</private>', '[REDACTED]', 'g') AS text, len(regexp_extract_all(t, '(?s)<private>.*?</private>')) AS n FROM (SELECT conv_id, turn, 'a <private>' || text || '</private> b <private>x</private>' AS t FROM conversations)""")
def p11_private_tags(spark, sf_dir):
    t = F.concat(F.lit("a <private>"), "text", F.lit("</private> b <private>x</private>"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"))
    return c.select("conv_id", "turn", X.redact_private(F.col("t")).alias("text"), F.regexp_count("t", F.lit(X.PRIVATE)).cast("long").alias("n"))


NORM = "regexp_replace(regexp_replace(lower({}), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')"


@query(f"WITH {REC}, d AS (SELECT id, sha256({NORM.format('content')}) AS digest FROM records) SELECT id, keep, n FROM d JOIN (SELECT digest, min(id) AS keep, count(*) AS n FROM d GROUP BY digest HAVING count(*) > 1) USING (digest)")
def l1_exact_duplicates(spark, sf_dir):
    return L.exact_duplicates(rec(spark, sf_dir))


#: Word sets, their classes (equal sets of a project go to the smallest id) and pairs of representatives.
JACC = f"""w AS (SELECT id, project, list_sort(list_distinct({WORDS.format('content')})) AS w FROM records), cl AS (SELECT id, project, w, min(id) OVER (PARTITION BY project, w) AS rep FROM w WHERE len(w) > 0),
 jr AS (SELECT * FROM cl WHERE id = rep), jp AS (SELECT a.id AS a, b.id AS b, a.project, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::double AS jaccard FROM jr a JOIN jr b ON a.project = b.project AND a.id < b.id
  WHERE len(a.w) >= 0.75 * len(b.w) AND len(b.w) >= 0.75 * len(a.w))"""


def word_sets(spark, sf_dir):
    w = rec(spark, sf_dir).select("id", "project", C.hashed(X.words(F.col("content"))).alias("s"))
    return w.where(F.size("s") > 0)


@query(f"WITH {REC}, {JACC} SELECT a, b, {R('jaccard')} AS jaccard FROM jp WHERE jaccard > 0.75 UNION ALL SELECT rep, id, 1.0 FROM cl WHERE id <> rep")
def j15_l2_similarity_join(spark, sf_dir):
    """Pairs of different texts, and every copy with its representative: no pairs among copies."""
    w = cut(word_sets(spark, sf_dir))  # read four times below
    member = cut(C.classes(w, ["project"], F.col("s")))
    pairs = C.alike_sets(w, ["project"], 0.75, member.where("id = rep").select("id")).where("jaccard > 0.75D").select("a", "b", M.rounded(F.col("jaccard")).alias("jaccard"))
    return pairs.unionByName(member.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard")))


@query()
def l3_l4_consolidate_groups(spark, sf_dir):
    r = rec(spark, sf_dir)
    return L.keep_longest(C.groups(r, ["project"], 0.75), r)


@query(f"""WITH {REC}, a AS (SELECT *, {AGE.format('coalesce(last_recalled, created_at)')} AS age FROM records)
 SELECT id, age::bigint AS age, CASE WHEN status = 'active' AND age > 180 AND recall_count = 0 AND confidence < 0.8 THEN 'archive' WHEN status = 'archived' AND age > 365 THEN 'purge' ELSE 'keep' END AS action FROM a""")
def l7_retention(spark, sf_dir):
    return L.retention(rec(spark, sf_dir), as_of()).select("id", "age", "action")


@query(f"""WITH {REC}, a AS (SELECT *, {AGE.format('created_at')} AS age, {AGE.format('last_recalled')} AS r FROM records),
 e AS (SELECT *, least(age, coalesce(r + floor(age / (recall_count + 1)), age)) AS eff, list_contains(tags, 'tag0') AS auto FROM a),
 s AS (SELECT *, pow(2.0, -eff / 90) * (0.5 + 0.5 * confidence) * CASE WHEN auto THEN 0.8 ELSE 1.0 END AS score FROM e)
 SELECT id, {R('score')} AS retention, type NOT IN ('decision', 'convention') AND score < CASE WHEN auto THEN 0.15 ELSE 0.10 END AS archive FROM s""")
def l8_intelligent_decay(spark, sf_dir):
    return L.intelligent_decay(rec(spark, sf_dir), as_of()).select("id", "retention", "archive")


@query(f"WITH {REC} SELECT id, {R(f'CASE WHEN coalesce({AGE.format("last_recalled")}, 31) > 30 THEN greatest(0.05, confidence * 0.95) ELSE confidence END')} AS confidence FROM records")
def l9_confidence_decay(spark, sf_dir):
    return L.confidence_decay(rec(spark, sf_dir), as_of()).select("id", M.rounded(F.col("confidence")).alias("confidence"))


@query("""WITH n AS (SELECT event_id, lower(trim(CASE WHEN event_id % 5 = 0 THEN 'It' WHEN event_id % 5 = 1 THEN 'User 7' ELSE event_type || ' ' END)) AS name_norm FROM events),
 c AS (SELECT DISTINCT event_type AS name_norm, 'E-' || event_type AS entity_id FROM events WHERE event_type <> 'view')
 SELECT event_id, CASE WHEN n.name_norm IN ('he','she','it','they','this','that') THEN 'pronoun' WHEN c.entity_id IS NOT NULL THEN 'exact' WHEN n.name_norm = 'user 7' THEN 'alias' ELSE 'missing' END AS how,
 CASE WHEN n.name_norm = 'it' THEN NULL WHEN c.entity_id IS NOT NULL THEN c.entity_id WHEN n.name_norm = 'user 7' THEN 'E-7' END AS entity_id FROM n LEFT JOIN c USING (name_norm)""")
def l14_resolve_entities(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 5 == 0, "It").when(F.col("event_id") % 5 == 1, "User  7").otherwise(F.concat("event_type", F.lit(" ")))
    canon = e.where("event_type <> 'view'").select(F.col("event_type").alias("name_norm"), F.concat(F.lit("E-"), "event_type").alias("entity_id")).distinct()
    aliases = spark.createDataFrame([("user 7", "E-7")], "alias_norm string, entity_id string")
    return L.resolve_entities(e.select("event_id", name.alias("name")), canon, aliases).select("event_id", "how", "entity_id")


#: Words of a vocabulary, some with another name.
TOPICS = (("colour", "color"), ("python", None), ("databases", None), ("speed", "fast"), ("almond", None), ("postgresql", "postgres"))
_TOPICS_SQL = "(VALUES " + ", ".join(f"('{w}', {'NULL' if a is None else repr(a)})" for w, a in TOPICS) + ") v(word, alias)"


@query(f"""WITH v AS (SELECT * FROM {_TOPICS_SQL}), t AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS tag FROM part UNION SELECT unnest(['color', 'Pythons', 'database', 'sped', 'zzz', 'Postgres'])),
 e AS (SELECT tag, min(word) AS canonical FROM t JOIN v ON lower(tag) = lower(word) OR lower(tag) = lower(alias) GROUP BY tag),
 s AS (SELECT tag, word, CASE WHEN contains(lower(tag), word) OR contains(word, lower(tag)) THEN 1.5 WHEN (greatest(length(tag), length(word)) - least(length(tag), length(word))) * 2 > greatest(length(tag), length(word)) THEN 0.0
  ELSE 1.0 - levenshtein(lower(tag), word)::double / greatest(length(tag), length(word)) END AS score FROM t, v WHERE tag NOT IN (SELECT tag FROM e))
 SELECT tag, canonical FROM e UNION ALL SELECT tag, CASE WHEN max(score) >= 0.8 THEN arg_max(word, (score, -length(word), word)) END FROM s GROUP BY tag""")
def l16_canonical_tags(spark, sf_dir):
    more = spark.createDataFrame([(t,) for t in ("color", "Pythons", "database", "sped", "zzz", "Postgres")], "tag string")
    tags = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("tag")).union(more)
    return L.canonical_tags(tags, spark.createDataFrame(list(TOPICS), "word string, alias string"))


@query("SELECT doc_id AS id, sha1(doc_id::varchar || chr(1) || source) AS hash FROM documents WHERE doc_id % 3 <> 0")
def l22_outbox_replay(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    done = d.where("doc_id % 3 = 0").select(F.sha1(F.concat_ws("\u0001", "doc_id", "source")).alias("hash"))
    return L.pending(d, done).select(F.col("doc_id").alias("id"), "hash")


@query("SELECT event_id FROM events WHERE ts >= timestamp '2024-01-31' - INTERVAL 10 DAY")
def l25_observation_retention(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-21").cast("timestamp")).select("event_id")


@query(f"SELECT l.doc_id AS id, CASE WHEN quality = 1 AND toxic = 0 THEN 'keep' WHEN toxic = 1 THEN 'reject' ELSE 'review' END AS decision FROM labels l")
def l18_quality_gate(spark, sf_dir):
    d = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "keep").when(F.col("toxic") == 1, "reject").otherwise("review")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), d.alias("decision"))


PAIR = "p AS (SELECT p_partkey AS k, p_name AS a, lead(p_name) OVER (ORDER BY p_partkey) AS b FROM part)"


@query(f"""WITH {PAIR} SELECT k, {R("CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 WHEN (greatest(length(a), length(b)) - least(length(a), length(b))) * 2 > greatest(length(a), length(b)) THEN 0.0 ELSE 1.0 - levenshtein(a, b)::double / greatest(length(a), length(b)) END")} AS ratio,
 {R("len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' '))))::double")} AS jaccard FROM p WHERE b IS NOT NULL""")
def x1_x3_string_similarity(spark, sf_dir):
    # A part and the next one: an equi-join on the number, no window over the whole table.
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a"))
    pairs = p.join(p.select((F.col("k") - 1).alias("k"), F.col("a").alias("b")), "k")
    return pairs.select("k", M.rounded(X.levenshtein_ratio(F.col("a"), F.col("b"))).alias("ratio"), M.rounded(X.jaccard(X.words(F.col("a")), X.words(F.col("b")))).alias("jaccard"))


@query()
def x2_sequence_ratio(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a"))
    pairs = p.join(p.select((F.col("k") - 1).alias("k"), F.col("a").alias("b")), "k")
    return pairs.select("k", X.sequence_ratio("a", "b").alias("ratio"))


@query()
def x6_folding(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.folded("text"), 256).alias("digest"))


@query("SELECT doc_id AS id, len(regexp_extract_all(lower(text), '[a-z0-9_]{1,}')) AS tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{1,}'))) AS vocabulary, floor(length(text) / 4)::bigint AS estimate FROM documents")
def x5_tokenise(spark, sf_dir):
    t = X.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.size(t).cast("long").alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("vocabulary"), F.floor(F.length("text") / 4).alias("estimate"))


@query(r"""WITH RECURSIVE p AS (SELECT doc_id AS id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', '.' || chr(10) || chr(10)), '\n\s*\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS p FROM documents WHERE doc_id % 5 = 0 AND length(text) < 4000),
 f(id, i, done, cur) AS (SELECT id, 0, []::varchar[], []::varchar[] FROM p UNION ALL SELECT f.id, f.i + 1,
  CASE WHEN len(cur) = 0 OR length(array_to_string(cur, chr(10) || chr(10))) + 2 + length(p.p[f.i + 1]) <= 300 THEN done ELSE list_append(done, array_to_string(cur, chr(10) || chr(10))) END,
  CASE WHEN len(cur) = 0 OR length(array_to_string(cur, chr(10) || chr(10))) + 2 + length(p.p[f.i + 1]) <= 300 THEN list_append(cur, p.p[f.i + 1]) WHEN len(cur) > 1 THEN [cur[len(cur)], p.p[f.i + 1]] ELSE [p.p[f.i + 1]] END FROM f JOIN p ON p.id = f.id WHERE f.i < len(p.p)),
 e AS (SELECT f.id, CASE WHEN len(cur) > 0 THEN list_append(done, array_to_string(cur, chr(10) || chr(10))) ELSE done END AS c FROM f JOIN p ON p.id = f.id AND f.i = len(p.p)) SELECT id, unnest(range(0, len(c)))::int AS n, sha256(unnest(c)) AS chunk FROM e""")
def x11_chunks(spark, sf_dir):
    """Prose in paragraphs of at most 300 characters (a sentence is a paragraph here)."""
    d = table(spark, sf_dir, "documents").where("doc_id % 5 = 0 AND length(text) < 4000")
    text = F.replace("text", F.lit(". "), F.lit(".\n\n"))
    c = d.select(F.col("doc_id").alias("id"), F.explode(K.chunks(text, F.lit("text"), most=300)).alias("c"))
    return c.select("id", "c.n", F.sha2("c.text", 256).alias("chunk"))



@query("SELECT doc_id AS id, sha256(text) AS sha256, sha1(text) AS sha1 FROM documents")
def x18_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"))


@query("SELECT event_id, (props ->> 'k')::bigint AS k FROM events")
def x21_json_in_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT conv_id, turn, sum(floor(length(text) / 4)) OVER (PARTITION BY conv_id ORDER BY turn)::bigint AS used FROM conversations QUALIFY used <= 400")
def x22_token_budget(spark, sf_dir):
    from pyspark.sql import Window

    used = F.sum(F.floor(F.length("text") / 4)).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", used.alias("used")).where("used <= 400")


ENT = "regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(?:script|style|noscript)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _e, _p in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    ENT = f"replace({ENT}, '{_e}', '{_p}')"


@query(f"SELECT page_id, trim(regexp_replace({ENT}, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS text FROM pages")
def s5_html_ingest(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))
