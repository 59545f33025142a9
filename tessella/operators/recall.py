"""Recall beyond one search: added tiers, associations, concepts of a query, triples, rounds of search, counter-evidence, query variants."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import graph as G
from tessella.operators import search as S

#: Words that are left out of keyword variants.
STOPS = (
    "the a an and or but in on at to for of is it this that with from by as are was were be been has have had do does did will would can could should may might shall not no "
    "и в на не что как это по с он она они но из за к от до бы ли же ни или мне мой моя все для так его ее уже когда при нет есть был если то тоже только этот этих"
).split()
#: Technical words of the other language.
TRANSLATIONS = {
    "поиск": "search", "ошибка": "error", "ошибки": "errors", "настройка": "config configuration", "конфигурация": "configuration", "база": "database", "данных": "data", "данные": "data",
    "сервер": "server", "клиент": "client", "запрос": "request query", "ответ": "response", "модель": "model", "тест": "test", "память": "memory", "кэш": "cache", "файл": "file", "проект": "project",
    "сессия": "session", "пользователь": "user", "токен": "token", "вектор": "vector embedding", "индекс": "index", "миграция": "migration", "схема": "schema", "контейнер": "container docker",
    "деплой": "deploy", "авторизация": "auth authorization", "аутентификация": "authentication", "маршрут": "route", "обработка": "handler processing", "интеграция": "integration", "зависимость": "dependency",
}
#: From which contradiction score on evidence is soft or hard against, and pairs per side.
SOFT, HARD, SIDE = 0.30, 0.60, 5


def additive(tiers: DataFrame) -> DataFrame:
    """(qid, id, score) of tiers (qid, id, tier, score) that are added instead of ranked: fts and semantic as they are,
    hyde .4 on top of those and .8 alone, multi_repr 20 times; fuzzy (.6) and graph (.4 of the parent) only where no tier
    before has the document."""
    s = lambda t: F.max(F.when(F.col("tier") == t, F.col("score")))
    one = tiers.groupBy("qid", "id").agg(*(s(t).alias(t) for t in ("fts", "semantic", "hyde", "multi_repr", "fuzzy", "graph")))
    or0 = lambda c: F.coalesce(c, F.lit(0.0))
    first = F.col("fts").isNotNull() | F.col("semantic").isNotNull()
    known = first | F.col("hyde").isNotNull() | F.col("multi_repr").isNotNull()
    base = or0(F.col("fts")) + F.greatest(or0(F.col("semantic")), F.lit(0.0)) + or0(F.greatest("hyde", F.lit(0.0)) * 0.8 * F.when(first, 0.5).otherwise(1.0)) + or0(F.col("multi_repr") * 20)
    late = F.when(F.col("fuzzy").isNotNull(), F.col("fuzzy") * 0.6).otherwise(or0(F.col("graph") * 0.4))
    return one.select("qid", "id", F.when(known, base).otherwise(late).alias("score"))


def associations(seeds: DataFrame, relations: DataFrame, budget: int = 10, score: float = 0.5) -> DataFrame:
    """(qid, id, score, rank): neighbours of a query's seeds either way, without the seeds; ``budget`` of them, by id."""
    near = G.both_ways(relations.select("source", "target")).distinct()
    found = seeds.select("qid", F.col("id").alias("source")).join(near, "source").select("qid", F.col("target").alias("id")).distinct()
    new = found.join(seeds.select("qid", "id"), ["qid", "id"], "left_anti").withColumn("score", F.lit(score))
    return S.top_k(new, budget)


def query_concepts(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, node) of the names (node, name) that a query speaks of: as a run of up to three words, inside a word, or with
    a part or the whole of a name inside one of its words or the other way round (three letters at least).

    The query set is the small side: its words, their substrings and its word runs are what is joined, by equality.
    """
    names = nodes.select("node", F.lower("name").alias("name")).where(F.length("name") >= 2)
    words = queries.select("qid", X.tokens(F.col("query"), 2).alias("w"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1)), lambda i: F.array_join(F.slice("w", i, n), " "))))
    exact = words.select("qid", F.explode(F.array_distinct(runs)).alias("name"))
    token = words.select("qid", F.explode(F.array_distinct("w")).alias("t")).where(~F.col("t").isin(*STOPS) & (F.length("t") >= 3))
    inside = token.select("qid", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.length("t") - i + 1)), lambda n: F.substr(F.col("t"), i, n))))).alias("part")).distinct()
    parts = names.select("node", F.explode(F.array_distinct(F.filter(F.array_append(F.split(F.replace("name", F.lit("_"), F.lit(" ")), " "), F.col("name")), lambda p: F.length(p) >= 3))).alias("part"))
    within = S.containing(names.select(F.col("node").alias("id"), F.col("name").alias("content")), token.select(F.col("t").alias("term")))
    found = [
        exact.join(names, "name").select("qid", "node"),
        inside.join(parts, "part").select("qid", "node"),
        within.join(token.withColumnRenamed("t", "term"), "term").select("qid", F.col("id").alias("node")),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def associative(queries: DataFrame, nodes: DataFrame, edges: DataFrame, links: DataFrame, k: int = 10, depth: int = 2) -> DataFrame:
    """(qid, id, score, rank): concepts of a query, activation spread from them, records on what is active (best activation times strength)."""
    seeds = query_concepts(queries, nodes)
    active = G.spread_each(edges, seeds, depth=depth)
    hits = active.join(links.withColumnRenamed("record", "id"), "node").groupBy("qid", "id").agg(F.max(F.col("activation") * F.col("strength")).alias("score"))
    return S.top_k(hits, k)


def triple_search(queries: DataFrame, triples: DataFrame, vectors: DataFrame, limit: int = 5) -> DataFrame:
    """(qid, subject, relation, object, score, rank): triples nearest to a query by the vectors (id, v) of their sentences; a
    triple that comes several times counts once. ``queries``: qid, qv; ``triples``: id, subject, relation, object."""
    near = S.exact_top_k(queries, vectors, limit * 4).select("qid", "id", "score", "rank").join(triples, "id")
    same = [F.lower("subject"), F.col("relation"), F.lower("object")]
    first = near.withColumn("n", F.row_number().over(Window.partitionBy("qid", *same).orderBy("rank"))).where("n = 1")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return first.withColumn("rank", rank).where(F.col("rank") <= limit).select("qid", "subject", "relation", "object", "score", "rank")


def iterate(queries: DataFrame, search: Callable[[DataFrame], DataFrame], plan: Callable[[DataFrame, DataFrame], DataFrame], rounds: int = 4) -> DataFrame:
    """(qid, id, round): evidence of repeated search for a batch of queries (qid, query).

    ``search`` gives (qid, id, ..) for the pending queries; ``plan`` (pending, new evidence) gives the next query (qid, query)
    of those that are not satisfied. A query ends when nothing is planned for it, or after ``rounds``.
    """
    pending, seen = queries, None
    for r in range(1, rounds + 1):
        found = search(pending).select("qid", "id").distinct()
        new = found if seen is None else found.join(seen.select("qid", "id"), ["qid", "id"], "left_anti")
        new = G.cut(new.withColumn("round", F.lit(r)))
        seen = new if seen is None else seen.unionByName(new)
        if r < rounds:
            pending = G.cut(plan(pending, new))
            if not pending.limit(1).count():
                break
    return seen


def contradicted(positive: DataFrame, negative: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(qid, score, decision): the strongest contradiction between a query's best evidence and the best counter-evidence
    (both qid, id, rank). ``score`` gives (qid, a, b, p) for pairs (qid, a, b): at most SIDE times SIDE of a query."""
    side = lambda d, c: d.where(F.col("rank") <= SIDE).select("qid", F.col("id").alias(c))
    best = score(side(positive, "a").join(side(negative, "b"), "qid")).groupBy("qid").agg(F.max(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p")))).alias("score"))
    every = positive.select("qid").distinct().join(best, "qid", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return every.withColumn("decision", F.when(F.col("score") >= HARD, "hard_contradict").when(F.col("score") >= SOFT, "soft_contradict").otherwise("no_contradiction"))


def inverted(query: Column) -> Column:
    """A question turned into a search for what speaks against it."""
    return F.concat(F.lit("facts contradicting or refuting: "), query)


def keywords_of(query: Column) -> Column:
    found = F.regexp_extract_all(F.lower(query), F.lit(r"(?U)[\w\-]+"), F.lit(0))
    return F.array_join(F.filter(found, lambda w: ~w.isin(*STOPS) & (F.length(w) > 2)), " ")


def translated(query: Column) -> Column:
    """Of a Russian query its Latin words, or else what its technical words mean; null where there are none."""
    found = F.regexp_extract_all(query, F.lit(r"(?U)[\w\-]+"), F.lit(0))
    latin = F.filter(found, lambda w: w.rlike(r"^[A-Za-z\-_.]+$"))
    table = F.create_map(*(F.lit(x) for kv in TRANSLATIONS.items() for x in kv))
    meant = F.filter(F.transform(found, lambda w: F.try_element_at(table, F.lower(w))), lambda w: w.isNotNull())
    words = F.when(F.size(latin) > 0, latin).otherwise(meant)
    return F.when(query.rlike("[Ѐ-ӿ]") & (F.size(words) > 0), F.array_join(words, " "))


def variants(queries: DataFrame) -> DataFrame:
    """(qid, n, query): the query, its keywords where they differ, and the other language's words."""
    q = F.col("query")
    k = keywords_of(q)
    every = F.array(q, F.when((k != "") & (k != F.btrim(F.lower(q))), k), translated(q))
    return queries.select("qid", F.posexplode(every).alias("n", "query")).where(F.col("query").isNotNull())


def expanded(queries: DataFrame, records: DataFrame, vectors: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(qid, id, score, rank): all variants of each query searched by text (and by the query's vector), fused by rank."""
    v = G.cut(variants(queries).withColumn("vid", F.col("qid") * 4 + F.col("n")))
    lex = S.bm25(v.select(F.col("vid").alias("qid"), "query"), records, 2 * k).withColumnRenamed("qid", "vid")
    lists = lex.join(v.select("vid", "qid", "n"), "vid").select("qid", "id", F.concat(F.lit("fts_"), F.col("n").cast("string")).alias("tier"), "rank")
    if vectors is not None:
        sem = S.exact_top_k(queries.select("qid", "qv"), vectors, 2 * k)
        lists = lists.unionByName(sem.select("qid", "id", F.lit("sem").alias("tier"), "rank"))
    return S.top_k(S.rrf(lists, {}), k)


def boosted(fused: DataFrame, scores: DataFrame, share: float = 0.4) -> DataFrame:
    """Fused scores (qid, id, score) scaled by the query's best, blended with a second opinion (qid, id, other in 0..1) that
    can only raise them."""
    scaled = fused.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("qid")))
    both = scaled.join(scores, ["qid", "id"], "left")
    blend = S.blend(F.col("score"), F.col("other"), share, True)
    return both.select("qid", "id", F.coalesce(blend, "score").alias("score"))


def diverse(hits: DataFrame, k: int = 5, trade: float = 0.7) -> DataFrame:
    """Maximal marginal relevance on every query's short list (qid, id, score, v): greedy, so one group per query."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(pdf.v.to_numpy()).astype(float)
        v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-10
        sim, s = v @ v.T, pdf.score.to_numpy(float)
        s = s / s.max() if s.max() > 0 else s
        order: list[int] = []
        while len(order) < min(k, len(pdf)):
            left = [i for i in range(len(pdf)) if i not in order]
            order.append(left[0] if not order else max(left, key=lambda i: (trade * s[i] - (1 - trade) * sim[i, order].max(), -i)))
        out = pdf.iloc[order][["qid", "id"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return hits.groupBy("qid").applyInPandas(one, "qid long, id long, rank int")


def fuzzy_if_few(found: DataFrame, queries: DataFrame, records: DataFrame, limit: int = 10, least: float = 0.35) -> DataFrame:
    """The fuzzy tier (qid, id, score) for the queries with fewer than ``limit`` results so far, over the newest records
    that they do not have yet."""
    n = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    few = queries.join(n, "qid", "left").where(F.coalesce("n", F.lit(0)) < limit).select("qid", "query")
    return S.fuzzy(few, records, limit * 5, least).join(found.select("qid", "id"), ["qid", "id"], "left_anti")
