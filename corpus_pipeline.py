"""From raw documents to training shards: each stage reads what the one before it wrote as Parquet.

Counted as part of ``tessella.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, mixing, ngram_join, quality_rules, sharding
from tessella.llm.common import store

SHARDS = 8


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go.

    Null and empty texts have too few words and go; rows are judged one by one, so repeated rows share their lot; an
    empty table stays empty; all columns pass as they are, whatever their names.
    """
    return quality_rules.passing(docs, quality_rules.V1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays.

    Null and empty texts link with nothing and stay, as do rows without an id; of rows that repeat an id one stays; an
    empty table stays empty; all columns pass as they are.
    """
    return ngram_join.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a part of the benchmark go.

    Null and empty texts hold nothing and stay; equal texts share their lot; an empty table or benchmark drops
    nothing; all columns pass as they are.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, bench)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per copy that the mix takes.

    A null source is one of its own; texts without words (null or empty) have no size and are never taken; repeated rows
    are taken one by one; an empty table gives an empty mix; all columns pass as they are.
    """
    return mixing.mixed_rows(docs, shards=SHARDS).select(*(F.col(f"`{c}`") for c in docs.columns))


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their place in it.

    Rows without an id share a shard; copies of one id take neighbouring places of one shard, ordered by text; an empty
    table stays empty; columns named shard or slot are replaced, all others pass.
    """
    return sharding.assign(docs, "doc_id", SHARDS, ["text"])


STAGES = [
    ("quality_rules", filter_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing_sources", mix_sources),
    ("sharding", assign_shards),
]
#: Hashes decide what the mix takes; tests hold the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
