"""Episodes: search, their facts as a tier, filters by concepts, past failures, hits in their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import search as S

#: Results, candidates per channel and result, facts of an episode that count.
RESULTS, PER_RESULT, FACTS = 5, 5, 5


def search(queries: DataFrame, episodes: DataFrame, vectors: DataFrame, k: int = RESULTS) -> DataFrame:
    """(qid, id, score, rank) of episodes (id, content) by text and vector, fused by rank. ``queries``: qid, query, qv."""
    n = max(k * PER_RESULT, 25)
    lex = S.bm25(queries, episodes, n).select("qid", "id", F.lit("bm25").alias("tier"), "rank")
    vec = S.exact_top_k(queries.select("qid", "qv"), vectors, n).select("qid", "id", F.lit("cosine").alias("tier"), "rank")
    return S.top_k(S.rrf(lex.unionByName(vec), {}), k)


def fact_tier(found: DataFrame, links: DataFrame, facts: int = FACTS) -> DataFrame:
    """(qid, id, score): the first facts of found episodes, score / (1 + place); the best place of a fact counts.
    ``links``: episode, id, place (from 0)."""
    first = links.where(F.col("place") < facts)
    each = found.withColumnRenamed("id", "episode").join(first, "episode")
    return each.groupBy("qid", "id").agg(F.max(F.col("score") / (1 + F.col("place"))).alias("score"))


def by_concepts(queries: DataFrame, episodes: DataFrame, limit: int = 10, newest: int = 5) -> DataFrame:
    """(qid, id, overlap, rank): of the newest ``limit * newest`` episodes of the query's project, those with most of its
    concepts, then the oldest. ``queries``: qid, project, wanted; ``episodes``: id, project, at, concepts."""
    lower = lambda c: F.array_distinct(F.transform(c, lambda x: F.lower(x.cast("string"))))
    mine = queries.select("qid", "project", lower(F.col("wanted")).alias("wanted")).join(episodes, "project")
    n = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("at"), F.desc("id")))
    recent = mine.withColumn("n", n).where(F.col("n") <= limit * newest)
    recent = recent.withColumn("overlap", F.size(F.array_intersect("wanted", lower(F.col("concepts")))))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("overlap"), "at", "id"))
    return recent.withColumn("rank", rank).where(F.col("rank") <= limit).select("qid", "id", "overlap", "rank")


def past_failures(queries: DataFrame, episodes: DataFrame, limit: int = 5, concepts: int = 5) -> DataFrame:
    """(qid, id, rank): failed episodes of the project with one of the query's first concepts, by impact, then the newest."""
    wanted = queries.select("qid", "project", F.explode(F.slice("wanted", 1, concepts)).alias("concept"))
    failed = episodes.where(F.col("outcome") == "failure").select("id", "project", "at", "impact", F.explode("concepts").alias("concept"))
    hit = failed.join(wanted, ["project", "concept"]).select("qid", "id", "at", "impact").distinct()
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("impact"), F.desc("at"), "id"))
    return hit.withColumn("rank", rank).where(F.col("rank") <= limit).select("qid", "id", "rank")


def timeline(hits: DataFrame, records: DataFrame, neighbours: int = 2, limit: int = 5) -> DataFrame:
    """(qid, id, role, created_at, rank): the best hits of each query and what stands next to them in their session, in
    order of time. A record is shown once per query, as a hit if it is one. ``hits``: qid, id, rank."""
    order = Window.partitionBy("session_id").orderBy("created_at", "id")
    placed = records.select("id", "session_id", "created_at", F.row_number().over(order).alias("n"))
    top = hits.where(F.col("rank") <= limit).select("qid", "id")
    at = top.join(placed, "id").select("qid", "session_id", F.explode(F.sequence(F.col("n") - neighbours, F.col("n") + neighbours)).alias("n")).distinct()
    near = at.join(placed, ["session_id", "n"]).select("qid", "id", "created_at").join(top, ["qid", "id"], "left_anti").withColumn("role", F.lit("neighbor"))
    every = top.join(placed.select("id", "created_at"), "id").withColumn("role", F.lit("hit")).unionByName(near)
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("created_at", "id")))


def concepts_in(text: Column, terms: list[str]) -> Column:
    """Which of a short list of terms a message has, lower-cased."""
    low = F.lower(text)
    return F.filter(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.contains(low, t))


def session_concepts(messages: DataFrame, terms: list[str], least: int = 1) -> DataFrame:
    """(session, concept, n): how many messages of a session speak of each term."""
    each = messages.select("session", F.explode(concepts_in(F.col("text"), terms)).alias("concept"))
    return each.groupBy("session", "concept").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
