"""Records, sessions, edges and facts, as views of the test tables, and the constants of ranking.

Each view has two forms that say the same: a DataFrame, and SQL for the engine that results are compared with.
Columns that the tables lack are arithmetic on ids, so both forms agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import table

#: Fixed values of the semantics (ranking constants).
RRF_K = 60
TIER_WEIGHTS = {"fts": 1.0, "semantic": 1.2, "hyde": 1.0, "fuzzy": 0.5, "graph": 0.8, "episode": 0.9}
IMPORTANCE = {"critical": 1.5, "high": 1.2, "medium": 1.0, "low": 0.8}
HALF_LIFE, EDGE_HALF_LIFE = 90, 60
ARCHIVE_DAYS, PURGE_DAYS, OBSERVATION_DAYS = 180, 365, 30
BM25_K1, BM25_B = 1.5, 0.75
AS_OF = "2024-06-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

TYPES = ("fact", "solution", "decision", "lesson", "convention")
LEVELS = ("critical", "high", "medium", "low")


def pick(values: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), n.cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    later = lambda t, hours: F.timestamp_seconds(F.unix_timestamp(t) + hours * 3600)
    created = later(F.lit(AS_OF).cast("timestamp"), -((i * 37) % 9000))
    return table(spark, sf_dir, "documents").select(
        i.alias("id"),
        F.col("text").alias("content"),
        F.col("source").alias("project"),
        F.col("lang").alias("branch"),
        pick(TYPES, i % 5).alias("type"),
        F.when(i % 11 == 0, "archived").when(i % 13 == 0, "superseded").otherwise("active").alias("status"),
        F.floor(i / 10).alias("session_id"),
        created.alias("created_at"),
        F.when(i % 3 == 0, later(created, i % 500)).alias("last_recalled"),
        (i % 7).alias("recall_count"),
        ((i * 7 % 100) / 100.0).alias("confidence"),
        pick(LEVELS, i * 3 % 4).alias("importance"),
        F.array(F.concat(F.lit("tag"), (i % 6).cast("string")), F.concat(F.lit("Topic"), (i % 9).cast("string"))).alias("tags"),
        F.when(i % 13 == 0, i + 1).alias("superseded_by"),
        F.col("n_chars"),
    )


_TYPES_SQL = "['fact','solution','decision','lesson','convention']"
_CREATED_SQL = f"(timestamp '{AS_OF}' - to_hours(((doc_id * 37) % 9000)::bigint))"
RECORDS_SQL = f"""records AS (SELECT doc_id AS id, text AS content, source AS project, lang AS branch, {_TYPES_SQL}[(doc_id % 5 + 1)::int] AS type,
 CASE WHEN doc_id % 11 = 0 THEN 'archived' WHEN doc_id % 13 = 0 THEN 'superseded' ELSE 'active' END AS status,
 doc_id // 10 AS session_id, {_CREATED_SQL} AS created_at,
 CASE WHEN doc_id % 3 = 0 THEN {_CREATED_SQL} + to_hours((doc_id % 500)::bigint) END AS last_recalled,
 doc_id % 7 AS recall_count, (doc_id * 7 % 100) / 100.0::double AS confidence,
 ['critical','high','medium','low'][(doc_id * 3 % 4 + 1)::int] AS importance,
 ['tag' || (doc_id % 6), 'Topic' || (doc_id % 9)] AS tags, CASE WHEN doc_id % 13 = 0 THEN doc_id + 1 END AS superseded_by, n_chars FROM documents)"""

RELATIONS = ("uses", "depends_on", "part_of")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed weighted edges: a supplier and a group of its parts; repeats reinforce (G2)."""
    li = table(spark, sf_dir, "lineitem")
    pairs = li.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 40 + 1_000_000).alias("target"), pick(RELATIONS, F.col("l_partkey") % 3).alias("relation"))
    return pairs.groupBy("source", "target", "relation").agg(F.count(F.lit(1)).alias("n")).select("source", "target", "relation", F.least(F.lit(10.0), 1.0 + 0.1 * (F.col("n") - 1)).alias("weight"), "n")


EDGES_SQL = """edges AS (SELECT l_suppkey AS source, l_partkey % 40 + 1000000 AS target, ['uses','depends_on','part_of'][(l_partkey % 3 + 1)::int] AS relation,
 least(10.0, 1.0 + 0.1 * (count(*) - 1))::double AS weight, count(*) AS n FROM lineitem GROUP BY ALL)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record-node links: an order and the groups of its parts."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("record"), (F.col("l_partkey") % 40).alias("node")).agg(F.max(F.col("l_quantity") / 50.0).alias("strength"))


LINKS_SQL = "links AS (SELECT l_orderkey AS record, l_partkey % 40 AS node, max(l_quantity / 50.0)::double AS strength FROM lineitem GROUP BY ALL)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arrival-ordered log of (subject, predicate, object, valid_from), one predicate per customer."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("subject"), F.lit("priority").alias("predicate"), F.col("o_orderpriority").alias("object"), F.col("o_orderdate").cast("timestamp").alias("valid_from"))


FACTS_SQL = "facts AS (SELECT o_orderkey AS fact_id, o_custkey AS subject, 'priority' AS predicate, o_orderpriority AS object, o_orderdate::timestamp AS valid_from FROM orders)"


def rounded(x: Column, digits: int = 6) -> Column:
    """Half up, the same in every engine."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def rounded_sql(x: str, digits: int = 6) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"
