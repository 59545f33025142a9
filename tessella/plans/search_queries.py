"""Search, vector and ranking queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import model as M
from tessella.functions import text as X
from tessella.operators import search as S
from tessella.plans.registry import query
from tessella.session import table

R = M.rounded_sql
#: Queries: the benchmark items.
QUERIES_SQL = "queries AS (SELECT item_id AS qid, text AS query FROM benchmark)"
BM25_SQL = """q AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(query), '[a-z0-9_]{2,}')) AS term FROM queries),
 tok AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9_]{2,}') AS t FROM records),
 stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
 p AS (SELECT id, len(t) AS dl, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM tok) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
 bm AS (SELECT qid, id, sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
   FROM p JOIN df USING (term) JOIN q USING (term), stats GROUP BY qid, id),
 bmr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY floor(score * 1e6 + 0.5) DESC, id) AS rank FROM bm)"""
VEC_SQL = """vq AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
 dist AS (SELECT qid, vec_id AS id, list_cosine_similarity(qv::double[], embedding::double[]) AS score,
   len(list_filter(list_zip(qv, embedding), lambda z: (z[1] > 0) <> (z[2] > 0))) AS h FROM embeddings, vq)"""


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("space"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), F.col("v").alias("qv"))


@query(f"WITH {M.RECORDS_SQL}, {QUERIES_SQL}, {BM25_SQL} SELECT qid, id, {R('score')} AS score, rank FROM bmr WHERE rank <= 10")
def r2_bm25_topk(spark, sf_dir):
    return S.bm25(queries_of(spark, sf_dir), M.records(spark, sf_dir)).select("qid", "id", M.rounded(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {M.RECORDS_SQL}, {QUERIES_SQL}, {BM25_SQL}, top AS (SELECT * FROM bmr WHERE rank <= 30)
 SELECT qid, id, {R("greatest(0.5, 2 * score / greatest(max(score) OVER (PARTITION BY qid), 0.01))")} AS score FROM top""")
def r1_bm25_normalised(spark, sf_dir):
    from pyspark.sql import Window

    top = S.bm25(queries_of(spark, sf_dir), M.records(spark, sf_dir), 30)
    best = F.greatest(F.max("score").over(Window.partitionBy("qid")), F.lit(0.01))
    return top.select("qid", "id", M.rounded(F.greatest(F.lit(0.5), F.col("score") * 2 / best)).alias("score"))


@query(f"WITH {M.RECORDS_SQL}, {QUERIES_SQL} SELECT qid, id, count(*) AS score FROM records, (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(query), '[a-z0-9_]{{2,}}')) AS term FROM queries ) q WHERE contains(lower(content), term) GROUP BY qid, id")
def r3_contained_terms(spark, sf_dir):
    q = queries_of(spark, sf_dir).select("qid", F.explode(F.array_distinct(X.tokens(F.col("query"), 2))).alias("term"))
    return S.containing(M.records(spark, sf_dir), q).join(q, "term").groupBy("qid", "id").agg(F.count(F.lit(1)).alias("score"))


@query("SELECT vec_id AS id, list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 AND i = 64 THEN -(1::hugeint << 63) WHEN x > 0 THEN (1::hugeint << (i - 1)::int) ELSE 0 END))::hugeint::varchar AS word FROM embeddings")
def r4_sign_word(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", S.sign_word(F.col("v")).cast("string").alias("word"))


@query(f"""WITH {VEC_SQL}, near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY h, id) AS n FROM dist),
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY floor(score * 1e6 + 0.5) DESC, id) AS rank FROM near WHERE n <= 50)
 SELECT qid, id, h::int AS h, {R('score', 4)} AS score, rank FROM r WHERE rank <= 10""")
def r5_hamming_then_cosine(spark, sf_dir):
    out = S.vector_top_k(vector_queries(spark, sf_dir), vectors(spark, sf_dir).select("id", "v"))
    return out.select("qid", "id", "h", M.rounded(F.col("score"), 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {VEC_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY floor(score * 1e6 + 0.5) DESC, id) AS rank FROM dist) SELECT qid, id, {R('score', 4)} AS score, rank FROM r WHERE rank <= 10")
def r6_exact_cosine(spark, sf_dir):
    out = S.exact_top_k(vector_queries(spark, sf_dir), vectors(spark, sf_dir).select("id", "v"))
    return out.select("qid", "id", M.rounded(F.col("score"), 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {VEC_SQL}, r AS (SELECT d.*, label AS space, row_number() OVER (PARTITION BY qid, label ORDER BY floor(score * 1e6 + 0.5) DESC, id) AS n FROM dist d JOIN embeddings ON vec_id = id WHERE label IN (1, 2)) SELECT qid, id, space, {R('score', 4)} AS score FROM r WHERE n <= 3")
def r7_vector_store_by_space(spark, sf_dir):
    v, q = vectors(spark, sf_dir), vector_queries(spark, sf_dir)
    found = [S.exact_top_k(q, v.where(F.col("space") == n), 3).withColumn("space", F.lit(n)) for n in (1, 2)]
    return found[0].unionByName(found[1]).select("qid", "id", F.col("space").cast("long").alias("space"), M.rounded(F.col("score"), 4).alias("score"))


@query(f"""WITH {VEC_SQL}, viewed AS (SELECT qid, id // 5 AS parent, ['raw','summary','keywords','questions','compressed'][(id % 5 + 1)::int] AS view, score FROM dist WHERE score > 0),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, view ORDER BY floor(score * 1e6 + 0.5) DESC, parent) AS rank FROM viewed)
 SELECT qid, parent AS id, {R('sum(1.0 / (60 + rank))')} AS score, arg_max(view, score) AS winner FROM ranked WHERE rank <= 10 GROUP BY qid, parent""")
def r8_multi_view_winner(spark, sf_dir):
    views = ("raw", "summary", "keywords", "questions", "compressed")
    q = vector_queries(spark, sf_dir)
    # One vector per parent and view, so a view's ten best parents are its ten best vectors.
    tops = [S.exact_top_k(q, vectors(spark, sf_dir).where(F.col("id") % 5 == n), 10).where("score > 0").withColumn("view", F.lit(v)) for n, v in enumerate(views)]
    top = reduce(DataFrame.unionByName, tops).withColumn("parent", F.floor(F.col("id") / 5))
    return top.groupBy("qid", F.col("parent").alias("id")).agg(M.rounded(F.sum(1.0 / (60 + F.col("rank")))).alias("score"), F.max_by("view", "score").alias("winner"))


HYBRID_SQL = f"""{M.RECORDS_SQL}, {QUERIES_SQL}, {BM25_SQL}, hq AS (SELECT qid, embedding AS qv FROM queries JOIN embeddings ON vec_id = qid),
 hd AS (SELECT qid, vec_id AS id, list_cosine_similarity(qv::double[], embedding::double[]) AS score, len(list_filter(list_zip(qv, embedding), lambda z: (z[1] > 0) <> (z[2] > 0))) AS h FROM embeddings, hq),
 hn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY h, id) AS n FROM hd),
 hr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY floor(score * 1e6 + 0.5) DESC, id) AS rank FROM hn WHERE n <= 50),
 tiers AS (SELECT qid, id, 1.0 AS w, rank FROM bmr WHERE rank <= 30 UNION ALL SELECT qid, id, 1.2, rank FROM hr WHERE rank <= 30),
 fused AS (SELECT qid, id, sum(w / (60 + rank)) AS score, count(*) AS tiers FROM tiers GROUP BY qid, id)"""


@query(f"WITH {HYBRID_SQL} SELECT qid, id, {R('score')} AS score, tiers FROM fused")
def r9_rrf_fusion(spark, sf_dir):
    q = queries_of(spark, sf_dir).join(vectors(spark, sf_dir).select(F.col("id").alias("qid"), F.col("v").alias("qv")), "qid")
    lex = S.bm25(q, M.records(spark, sf_dir), 30).select("qid", "id", F.lit("fts").alias("tier"), "rank")
    vec = S.vector_top_k(q.select("qid", "qv"), vectors(spark, sf_dir).select("id", "v"), 30).select("qid", "id", F.lit("semantic").alias("tier"), "rank")
    return S.rrf(lex.unionByName(vec)).select("qid", "id", M.rounded(F.col("score")).alias("score"), "tiers")


DECAYED_SQL = f"""(greatest(0.01, pow(2.0, -floor(epoch(timestamp '{M.AS_OF}' - created_at) / 86400) / 90)) + least(0.3, recall_count * 0.05))
 * CASE importance WHEN 'critical' THEN 1.5 WHEN 'high' THEN 1.2 WHEN 'low' THEN 0.8 ELSE 1.0 END"""


@query(f"""WITH {HYBRID_SQL}, f AS (SELECT qid, id, score * {DECAYED_SQL} AS score FROM fused JOIN records USING (id)),
 o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY floor(score * 1e6 + 0.5) DESC, id) AS rank FROM f) SELECT qid, id, {R('score', 5)} AS score, rank FROM o WHERE rank <= 10""")
def r16_hybrid_search(spark, sf_dir):
    q = queries_of(spark, sf_dir).join(vectors(spark, sf_dir).select(F.col("id").alias("qid"), F.col("v").alias("qv")), "qid")
    out = S.hybrid(q, M.records(spark, sf_dir), vectors(spark, sf_dir).select("id", "v"), F.lit(M.AS_OF).cast("timestamp"))
    return out.select("qid", "id", M.rounded(F.col("score"), 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {M.RECORDS_SQL} SELECT id, {R(DECAYED_SQL)} AS factor FROM records")
def r15_decay_and_importance(spark, sf_dir):
    r = M.records(spark, sf_dir)
    d = S.decay(S.whole_days(F.lit(M.AS_OF).cast("timestamp"), F.col("created_at")), M.HALF_LIFE) + S.recall_boost(F.col("recall_count"))
    return r.select("id", M.rounded(d * S.importance_factor(F.col("importance"))).alias("factor"))


#: The best 20 of each query: what re-ranking and fusion work on.
TOP_SQL = f"{VEC_SQL}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY h, id) AS n FROM dist) WHERE n <= 50), top20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY floor(score * 1e6 + 0.5) DESC, id) AS rank FROM top) WHERE rank <= 20)"


def top20(spark, sf_dir):
    return S.vector_top_k(vector_queries(spark, sf_dir), vectors(spark, sf_dir).select("id", "v"), 20)


@query(f"WITH {TOP_SQL}, s AS (SELECT qid, id, score, least(10.0, h) AS ce FROM top20) SELECT qid, id, {R('greatest(score, 0.4 / (1.0 + exp(-(ce - 5))) + 0.6 * score)')} AS ce_score, {R('0.6 * ce / 10 + 0.4 * score')} AS llm_score FROM s")
def r19_r20_rerank_blends(spark, sf_dir):
    s = top20(spark, sf_dir).select("qid", "id", "score", F.least(F.lit(10.0), F.col("h").cast("double")).alias("ce"))
    return s.select("qid", "id", M.rounded(S.blend(F.col("score"), S.sigmoid(F.col("ce") - 5), 0.4, True)).alias("ce_score"), M.rounded(S.blend(F.col("score"), F.col("ce") / 10, 0.6)).alias("llm_score"))


@query()
def r21_adaptive_mmr(spark, sf_dir):
    hits = S.exact_top_k(vector_queries(spark, sf_dir), vectors(spark, sf_dir).select("id", "v"), 20)
    return S.mmr(hits.join(vectors(spark, sf_dir).select("id", "v"), "id").select("qid", "id", "score", "v"))


@query(f"""WITH {TOP_SQL}, a AS (SELECT qid, id, score / sum(score) OVER (PARTITION BY qid) * 0.9 AS ma FROM top20 WHERE score > 0.1),
 b AS (SELECT qid, id, (64 - h) / sum(64 - h) OVER (PARTITION BY qid)::double * 0.9 AS mb FROM top20 WHERE h < 30),
 ab AS (SELECT qid, id, coalesce(ma, 0) AS ma, coalesce(mb, 0) AS mb FROM a FULL JOIN b USING (qid, id)),
 c AS (SELECT *, sum(ma) OVER (PARTITION BY qid) * sum(mb) OVER (PARTITION BY qid) - sum(ma * mb) OVER (PARTITION BY qid) AS k FROM ab)
 SELECT qid, id, {R('(ma * mb + 0.1 * ma + 0.1 * mb) / (1 - k)')} AS mass, {R('k')} AS conflict FROM c""")
def r27_dempster_shafer(spark, sf_dir):
    d = top20(spark, sf_dir)
    out = S.dempster_shafer(d.where("score > 0.1").select("qid", "id", "score"), d.where("h < 30").select("qid", "id", (64.0 - F.col("h")).alias("score")))
    return out.select("qid", "id", M.rounded(F.col("mass")).alias("mass"), M.rounded(F.col("conflict")).alias("conflict"))


#: Words that say nothing about what a record is about.
ANALOGY_STOPS = ("this", "that", "from", "with", "have", "when", "what", "where", "which", "about", "there", "their", "they", "then", "than", "been", "were", "would", "could", "should", "some", "more", "like", "into", "also", "very", "just", "over", "only", "such", "these", "those", "html", "http", "https", "using", "used", "uses")
_ANALOGY_SQL = f"""{M.RECORDS_SQL}, f AS (SELECT id, type, list_filter(list_distinct(list_concat(list_transform(tags, lambda t: lower(t)), regexp_extract_all(lower(content), '[a-z][a-z0-9_]{{3,}}'))), lambda w: NOT list_contains([{', '.join(f"'{w}'" for w in ANALOGY_STOPS)}], w)) AS f FROM records), q AS (SELECT * FROM f WHERE id % 100 = 0),
 p AS (SELECT q.id AS qid, f.id, len(list_intersect(q.f, f.f)) AS n, len(q.f) + len(f.f) AS s FROM q JOIN f ON q.id <> f.id WHERE f.type IN ('solution', 'lesson', 'decision'))"""


def analogies(spark, sf_dir, least):
    words = F.regexp_extract_all(F.lower("content"), F.lit("[a-z][a-z0-9_]{3,}"), F.lit(0))
    f = M.records(spark, sf_dir).select("id", "type", F.filter(F.array_distinct(F.concat(F.transform("tags", F.lower), words)), lambda w: ~w.isin(*ANALOGY_STOPS)).alias("f"))
    q = f.where("id % 100 = 0").select(F.col("id").alias("qid"), "f")
    return S.shared_features(q, f.where(F.col("type").isin("solution", "lesson", "decision")), least).where("qid <> id")


@query(f"WITH {_ANALOGY_SQL} SELECT qid, id, {R('n / (s - n)::double')} AS score FROM p WHERE n >= 0.1 * (s - n)")
def r31_analogy(spark, sf_dir):
    return analogies(spark, sf_dir, 0.1).select("qid", "id", M.rounded(F.col("jaccard")).alias("score"))


@query(f"WITH {_ANALOGY_SQL} SELECT qid, id, {R('n / (s - n)::double')} AS score FROM p WHERE n > 0 AND n >= 0.02 * (s - n)")
def r31_analogy_low(spark, sf_dir):
    """With a lower threshold, for the thin texts of the tables."""
    return analogies(spark, sf_dir, 0.02).select("qid", "id", M.rounded(F.col("jaccard")).alias("score"))


@query(f"SELECT doc_id AS id, {R('1.0 / (1.0 + exp(-(4.0 * (doc_id % 100) / 100.0 - 2.0)))')} AS p FROM documents")
def r40_platt_apply(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), M.rounded(S.sigmoid((F.col("doc_id") % 100) / 100.0 * 4.0 - 2.0)).alias("p"))


@query()
def r40_platt_fit(spark, sf_dir):
    """Platt scaling of a quality signal with the library's own logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    marks = F.length(F.regexp_replace("text", "[^#$%&|*]", "")) / F.length("text")
    rows = VectorAssembler(inputCols=["s"], outputCol="features").transform(d.select(marks.alias("s"), F.col("quality").cast("double").alias("label")))
    m = LogisticRegression(regParam=0.0, maxIter=50).fit(rows)
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "a double, b double")
