"""The thin queries of this package's operators and their SQL."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, mixing, ngram_join, pii, quality_classifier, quality_rules, sharding, substring_dedup, token_ids, warc
from tessella.llm.oracle import ORACLE_SQL  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A vocabulary file of a public tokenizer; ``None``: that of the installed library.
TOKENIZER: str | None = None


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.join(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality_classifier.table_of_statistics(_table(spark, sf_dir, "documents"), "doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = quality_classifier.train(stats, _table(spark, sf_dir, "labels"), "doc_id", "quality", fold != 1)
    out = quality_classifier.score(stats, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    rows = docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"))
    out = sharding.assign(rows, "doc_id", 8, ["text_crc32", "size"])
    grown = sharding.shard_of(F.col("doc_id"), 9)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, manifest = warc.archive(_table(spark, sf_dir, "pages"))
    out = warc.read(spark, manifest)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    if not (path := TOKENIZER):
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    folder, manifest = token_ids.encode(_table(spark, sf_dir, "documents"), path, 2)
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    return token_ids.read_files(spark, folder, manifest, zlib.crc32, "doc_id long, start long, n_tokens long, ids_crc32 long", arrow)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", pii.of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("base"), F.col("terms")).alias("spans"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    entries = quality_rules.apply_policy(entries, quality_rules.BASE, "base_kept")
    entries = quality_rules.apply_policy(entries, quality_rules.V1)
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", F.col("fail_bits").cast("long").alias("fail_bits"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.parse(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(F.col("key").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_quality_classifier, op3_sharding, op4_mixing, op5_warc, op6_token_ids, op7_pii, op8_decontamination, op9_quality_rules, op10_substring_dedup)}
