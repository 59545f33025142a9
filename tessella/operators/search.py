"""Lexical and vector tiers, fusion and re-ranking, for batches of queries at once.

A tier is a DataFrame (qid, id, tier, rank, raw); tiers meet in one grouped sum. Nothing loops over queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import model as M
from tessella.functions import text as X
from tessella.operators.graph import cut


def postings(queries: DataFrame, records: DataFrame, least: int = 2) -> DataFrame:
    """(id, term, dl, tf) of the terms that queries have, and a row of the empty term per document.

    Texts are split once; terms that no query has are dropped before anything is grouped. Which join drops them is
    left to Spark, by the size of the query set.
    """
    wanted = queries.select(F.explode(F.array_distinct(X.tokens(F.col("query"), least))).alias("term")).distinct()
    wanted = wanted.unionByName(queries.sparkSession.createDataFrame([("",)], "term string"))
    t = records.select("id", X.tokens(F.coalesce("content", F.lit("")), least).alias("t")).withColumn("dl", F.size("t"))
    # Outer: for a plain explode the texts would be split once more, to leave empty arrays out before.
    each = t.select("id", "dl", F.explode_outer(F.array_append("t", F.lit(""))).alias("term")).join(wanted, "term", "left_semi")
    return each.groupBy("id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(queries: DataFrame, records: DataFrame, k: int = 10, k1: float = M.BM25_K1, b: float = M.BM25_B) -> DataFrame:
    """(qid, id, score, rank) of the best ``k`` per query.

    Lengths, frequencies and scores all come from one pass over the texts, kept as a table of the queries' terms. Scores are
    products of blocks of documents with blocks of the stated query set; a block keeps its best for each query.
    """
    spark = queries.sparkSession
    p = cut(postings(queries, records))
    own = queries.select(F.col("qid").cast("long").alias("qid"), F.array_distinct(X.tokens(F.col("query"), 2)).alias("t"))
    asked = own.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("t")).orderBy("qid").collect()  # the stated query set
    n, avgdl = p.where(F.col("term") == "").agg(F.count(F.lit(1)), F.avg("dl")).first()
    # At most as many rows as the query set has terms.
    df = {r.term: r.df for r in p.where(F.col("term") != "").groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    docs = p.where(F.col("term") != "").groupBy("id", "dl").agg(F.collect_list("term").alias("t"), F.collect_list("tf").alias("f"))
    parts = [spark.createDataFrame([], "qid long, id long, score double")]
    for at in range(0, len(asked), QUERY_BLOCK):
        some = asked[at : at + QUERY_BLOCK]
        terms = sorted({t for r in some for t in r.t if t in df})
        if not terms:
            continue
        index = {t: i for i, t in enumerate(terms)}
        qids, wants = np.array([r.qid for r in some], dtype=np.int64), np.zeros((len(terms), len(some)))
        for j, r in enumerate(some):
            wants[[index[t] for t in r.t if t in index], j] = 1.0
        count = np.array([df[t] for t in terms], dtype=np.float64)
        idf = np.log(1.0 + (n - count + 0.5) / (count + 0.5))

        def run(batches: Iterator[pa.RecordBatch], terms: list[str] = terms, qids: np.ndarray = qids, wants: np.ndarray = wants, idf: np.ndarray = idf) -> Iterator[pa.RecordBatch]:
            rows = max(16, (4 << 20) // len(terms))
            for batch in batches:
                for i in range(0, batch.num_rows, rows):
                    part = batch.slice(i, rows).sort_by("id")
                    sizes = pc.list_value_length(part.column(2)).to_numpy()
                    which = pc.index_in(part.column(2).flatten(), value_set=pa.array(terms)).fill_null(-1).to_numpy()
                    tf = part.column(3).flatten().to_numpy().astype(np.float64)
                    row = np.repeat(np.arange(part.num_rows), sizes)
                    dl = part.column(1).to_numpy().astype(np.float64)[row]
                    weight = np.zeros((part.num_rows, len(terms)))
                    good = which >= 0
                    weight[row[good], which[good]] = (idf[which] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)))[good]
                    scores = (weight @ wants).T
                    ranked = np.floor(-scores * 1e6 + 0.5).astype(np.int64)  # as ``top_k`` ranks them
                    best = _smallest(ranked * part.num_rows + np.arange(part.num_rows), k + 8)
                    q, d = np.repeat(np.arange(len(qids)), best.shape[1]), best.ravel()
                    hit = scores[q, d] > 0
                    yield pa.record_batch([pa.array(qids[q][hit]), pa.array(part.column(0).to_numpy()[d][hit]), pa.array(scores[q, d][hit])], names=["qid", "id", "score"])

        parts.append(docs.select(F.col("id").cast("long").alias("id"), F.col("dl").cast("long").alias("dl"), "t", F.col("f").cast("array<long>").alias("f")).mapInArrow(run, "qid long, id long, score double"))
    return top_k(reduce(DataFrame.unionByName, parts), k)


def top_k(scored: DataFrame, k: int, group: str = "qid") -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc(M.rounded(F.col("score"))), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-10)


def sign_word(v: Column) -> Column:
    """64 signs as one bigint; the first is the lowest bit."""
    bits = F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


#: Queries that are compared at a time, and vectors of a block.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096


def _by_block(queries: DataFrame, vectors: DataFrame, keep, schema: str) -> DataFrame:
    """``keep(qids, Q, ids, V)`` of every block of ``vectors`` (id, v) against blocks of the stated query set (qid, qv).

    Queries travel with the task, at most QUERY_BLOCK at a time; a block keeps its best for each query, so what is
    shuffled grows with queries and blocks, not with pairs.
    """
    rows = queries.select("qid", "qv").where(F.col("qv").isNotNull()).orderBy("qid").collect()  # the stated query set
    parts = []
    for at in range(0, max(1, len(rows)), QUERY_BLOCK):
        some = rows[at : at + QUERY_BLOCK]
        qids, q = np.array([r.qid for r in some], dtype=np.int64), np.array([r.qv for r in some], dtype=np.float64)

        def run(batches: Iterator[pa.RecordBatch], qids: np.ndarray = qids, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows if len(qids) else 0, VECTOR_BLOCK):
                    part = batch.slice(i, VECTOR_BLOCK)
                    part = part.filter(pc.is_valid(part.column(1)))
                    if part.num_rows:
                        ids = part.column(0).to_numpy()
                        v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.float64)
                        order = np.argsort(ids, kind="stable")
                        yield keep(qids, q, ids[order], v[order])

        parts.append(vectors.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts)


def _normed(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def _smallest(keys: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` smallest keys of each row."""
    if keys.shape[1] <= k:
        return np.broadcast_to(np.arange(keys.shape[1]), keys.shape)
    return np.argpartition(keys, k - 1, axis=1)[:, :k]


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, shortlist: int = 50) -> DataFrame:
    """Hamming shortlist per query, then cosine: (qid, id, h, score, rank). Ties of distance go by id."""

    def keep(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        bits = lambda x: np.packbits(x > 0, axis=1)
        qb, vb = bits(q), bits(v)
        h = sum(np.bitwise_count(qb[:, j, None] ^ vb[None, :, j]).astype(np.int64) for j in range(qb.shape[1]))
        best = _smallest(h * len(ids) + np.arange(len(ids)), shortlist)
        rows = np.repeat(np.arange(len(qids)), best.shape[1])
        at = best.ravel()
        cos = np.einsum("ij,ij->i", q[rows], v[at]) / (_normed(q)[rows] * _normed(v)[at] + 1e-10)
        return pa.record_batch([pa.array(qids[rows]), pa.array(ids[at]), pa.array(h[rows, at].astype(np.int32)), pa.array(cos)], names=["qid", "id", "h", "score"])

    near = _by_block(queries, vectors, keep, "qid long, id long, h int, score double")
    n = F.row_number().over(Window.partitionBy("qid").orderBy("h", "id"))
    return top_k(near.withColumn("n", n).where(F.col("n") <= shortlist).drop("n"), k)


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, least: float | None = None) -> DataFrame:
    """(qid, id, score, rank): the best ``k`` by cosine, of those with at least ``least``; ties go by id."""

    def keep(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        cos = (q @ v.T) / (_normed(q)[:, None] * _normed(v)[None, :] + 1e-10)
        ranked = np.floor(-cos * 1e6 + 0.5).astype(np.int64)  # as ``top_k`` ranks them
        best = _smallest(ranked * len(ids) + np.arange(len(ids)), k + 8)
        rows, at = np.repeat(np.arange(len(qids)), best.shape[1]), best.ravel()
        score = cos[rows, at]
        good = np.ones(len(score), dtype=bool) if least is None else score >= least
        return pa.record_batch([pa.array(qids[rows][good]), pa.array(ids[at][good]), pa.array(score[good])], names=["qid", "id", "score"])

    return top_k(_by_block(queries, vectors, keep, "qid long, id long, score double"), k)


def containing(records: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term) where a record's lower-cased content contains a term of the stated term list, anywhere: one pass
    over each text with an automaton of all terms."""
    wanted = sorted({r.term for r in terms.select("term").distinct().collect() if r.term})  # the stated query set's terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, t in enumerate(wanted):
            automaton.add_word(t, i)
        automaton.make_automaton()
        for batch in batches:
            ids, found = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hit = {j for _, j in automaton.iter(text)} if text else ()
                ids += [i] * len(hit)
                found += [wanted[j] for j in hit]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["id", "term"])

    if not wanted:
        return records.sparkSession.createDataFrame([], "id long, term string")
    return records.select(F.col("id").cast("long").alias("id"), F.lower("content").alias("t")).mapInArrow(run, "id long, term string")


#: Queries whose features travel with a task, and records that meet a block of queries at a time.
FEATURE_QUERIES, FEATURE_ROWS = 8192, 128


def shared_features(queries: DataFrame, records: DataFrame, least: float = 0.0) -> DataFrame:
    """(qid, id, shared, jaccard) of feature sets that share a feature and reach ``least``: ``queries`` (qid, f) is the stated query
    set, ``records`` (id, f).

    Features meet as 64-bit hashes. The queries' lists travel with the task, so a record meets them where it is read and
    nothing is shuffled.
    """
    hashes = lambda d, key: d.select(F.col(key).cast("long").alias(key), F.transform("f", lambda w: F.xxhash64(w)).alias("f"))
    rows = hashes(queries, "qid").where(F.size("f") > 0).orderBy("qid").toArrow()  # the stated query set
    parts = [queries.sparkSession.createDataFrame([], "qid long, id long, shared long, jaccard double")]
    for at in range(0, rows.num_rows, FEATURE_QUERIES):
        some = rows.slice(at, FEATURE_QUERIES).combine_chunks()
        lists = some.column(1).combine_chunks()
        qids, sizes = some.column(0).to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
        flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(qids)), sizes)
        order = np.argsort(flat, kind="stable")
        terms, start, count = np.unique(flat[order], return_index=True, return_counts=True)
        owner = owner[order].astype(np.int32)

        def run(batches: Iterator[pa.RecordBatch], qids: np.ndarray = qids, sizes: np.ndarray = sizes, terms: np.ndarray = terms, start: np.ndarray = start, count: np.ndarray = count, owner: np.ndarray = owner) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, FEATURE_ROWS):
                    part = batch.slice(i, FEATURE_ROWS)
                    n = pc.list_value_length(part.column(1)).to_numpy().astype(np.int64)
                    h, row = part.column(1).flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
                    k = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                    hit = terms[k] == h
                    k, row = k[hit], row[hit]
                    both = np.zeros(len(n) * len(qids), dtype=np.int64)
                    # In steps of bounded length: a feature that all queries have stands for all of them.
                    ends = np.cumsum(count[k])
                    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + (1 << 21), 1 << 21) if len(ends) else [0]))
                    for lo, hi in zip([0, *cuts], [*cuts, len(k)], strict=True):
                        if lo < hi:
                            c = count[k[lo:hi]]
                            places = np.repeat(start[k[lo:hi]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                            both += np.bincount(np.repeat(row[lo:hi], c) * len(qids) + owner[places], minlength=len(both))
                    met = np.flatnonzero(both)
                    r, q, shared = met // len(qids), met % len(qids), both[met]
                    jaccard = shared / (sizes[q] + n[r] - shared)
                    good = jaccard >= least
                    yield pa.record_batch([pa.array(qids[q[good]]), pa.array(part.column(0).to_numpy()[r[good]]), pa.array(shared[good]), pa.array(jaccard[good])], names=["qid", "id", "shared", "jaccard"])

        parts.append(hashes(records, "id").where(F.size("f") > 0).mapInArrow(run, "qid long, id long, shared long, jaccard double"))
    return reduce(DataFrame.unionByName, parts)


def decay(age_days: Column, half_life: Column | int, floor: float = 0.01, missing: float = 0.5) -> Column:
    hl = half_life if isinstance(half_life, Column) else F.lit(half_life)
    return F.coalesce(F.greatest(F.lit(floor), F.pow(F.lit(2.0), -age_days / hl)), F.lit(missing))


def whole_days(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400)


def recall_boost(n: Column) -> Column:
    return F.least(F.lit(0.3), n * 0.05)


def importance_factor(level: Column) -> Column:
    factor = F.lit(1.0)
    for name, f in M.IMPORTANCE.items():
        factor = F.when(level == name, f).otherwise(factor)
    return factor


def rrf(tiers: DataFrame, weights: dict[str, float] | None = None, k: int = M.RRF_K) -> DataFrame:
    """(qid, id, score, tiers) from ranks counted from 1, each optionally scaled by a column ``scale``."""
    weight = F.lit(1.0)
    for name, w in (M.TIER_WEIGHTS if weights is None else weights).items():
        weight = F.when(F.col("tier") == name, w).otherwise(weight)
    scale = F.col("scale") if "scale" in tiers.columns else F.lit(1.0)
    return tiers.groupBy("qid", "id").agg(F.sum(weight * scale / (k + F.col("rank"))).alias("score"), F.count(F.lit(1)).alias("tiers"))


def final_score(fused: DataFrame, records: DataFrame, as_of: Column, half_life: int = M.HALF_LIFE) -> DataFrame:
    """Fused scores with time decay, recall boost and importance."""
    r = records.select("id", "created_at", "recall_count", "importance")
    d = decay(whole_days(as_of, F.col("created_at")), half_life) + recall_boost(F.col("recall_count"))
    return fused.join(r, "id").withColumn("score", F.col("score") * d * importance_factor(F.col("importance")))


def blend(original: Column, other: Column, share: float, at_least: bool = False) -> Column:
    """share * other + (1 - share) * original, optionally never below the original."""
    mixed = other * share + original * (1 - share)
    return F.greatest(original, mixed) if at_least else mixed


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def mmr(hits: DataFrame, k: int = 5, trade: float = 0.9, alike: float = 0.85) -> DataFrame:
    """Maximal marginal relevance, only where a query's hits are alike on average. Greedy, so one group per query.

    ``hits`` (qid, id, score, v) is a top-k list: its groups are bounded by that k.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(pdf.v.to_numpy()).astype(float)
        v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-10
        sim, n = v @ v.T, len(pdf)
        order = list(range(n))
        if n > 1 and (sim.sum() - np.trace(sim)) / (n * (n - 1)) >= alike:
            order, left = [0], list(range(1, n))
            while left:
                best = max(left, key=lambda i: (trade * pdf.score[i] - (1 - trade) * sim[i, order].max(), -i))
                order.append(best)
                left.remove(best)
        out = pdf.iloc[order[:k]][["qid", "id", "score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return hits.groupBy("qid").applyInPandas(one, "qid long, id long, score double, rank int")


def dempster_shafer(a: DataFrame, b: DataFrame, theta: float = 0.1) -> DataFrame:
    """Two ranked lists (qid, id, score) as mass functions, combined; ``conflict`` is what both exclude."""

    def masses(d: DataFrame, name: str) -> DataFrame:
        total = F.sum("score").over(Window.partitionBy("qid"))
        return d.select("qid", "id", (F.col("score") / total * (1 - theta)).alias(name))

    both = masses(a, "ma").join(masses(b, "mb"), ["qid", "id"], "full").fillna(0.0, ["ma", "mb"])
    by = Window.partitionBy("qid")
    conflict = F.sum("ma").over(by) * F.sum("mb").over(by) - F.sum(F.col("ma") * F.col("mb")).over(by)
    mass = F.col("ma") * F.col("mb") + F.col("ma") * theta + F.col("mb") * theta
    return both.select("qid", "id", (mass / (1 - conflict)).alias("mass"), conflict.alias("conflict"))


def fuzzy(queries: DataFrame, records: DataFrame, newest: int = 50, least: float = 0.35) -> DataFrame:
    """Sequence ratio of each query and the heads of the newest records (a bounded list per query)."""
    recent = records.orderBy(F.desc("created_at"), "id").limit(newest).select("id", F.substring("content", 1, 200).alias("head"))
    pairs = recent.join(queries.select("qid", "query"), F.lit(True))
    return pairs.select("qid", "id", X.sequence_ratio(F.lower("query"), F.lower("head")).alias("score")).where(F.col("score") > least)


def hybrid(queries: DataFrame, records: DataFrame, vectors: DataFrame, as_of: Column, k: int = 10) -> DataFrame:
    """Batch hybrid search: lexical and vector tiers, fused, decayed, weighted. ``queries`` has qid, query and qv."""
    lex = bm25(queries, records, 3 * k).select("qid", "id", F.lit("fts").alias("tier"), "rank")
    vec = vector_top_k(queries.select("qid", "qv"), vectors, 3 * k).select("qid", "id", F.lit("semantic").alias("tier"), "rank")
    return top_k(final_score(rrf(lex.unionByName(vec)), records, as_of), k)
