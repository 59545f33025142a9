"""The corpus pipeline, stage by stage and as a whole, against plain versions; and the queries that have no SQL."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import quality_rules, queries
from tests.llm import brute

#: Columns whose names are also used inside the operators.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, row string, n_words long, fail_bits int, kept string, shard int, slot long, rank int, h long, node long"
ITEMS = [("i1", "the quick brown fox jumps over the lazy dog and then sleeps all day long"), ("i2", "short item of five words"), ("i3", None), (None, "nobody")]


def make_docs() -> list[tuple]:
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8)))
    base = [[word() for _ in range(60)] for _ in range(25)]
    texts: list[str | None] = [None, "", "too short", " ".join(["same"] * 80), "### $$$ %%% " * 30, "line line line line\n" * 30]
    for b in base:
        texts.append(" ".join(b))
        for k in (1, 2, 30):
            near = list(b)
            near[5 : 5 + k] = [word() for _ in range(k)]
            texts.append(" ".join(near))
    texts += [" ".join(base[0])] * 3
    for b in base[:5]:
        texts.append(" ".join([word() for _ in range(30)]) + " The QUICK brown fox, jumps over the lazy dog and then sleeps all day " + " ".join(b[:10]))
    texts.append(" ".join(word() for _ in range(4000)))
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), -i, "k", "r", -1, -2, "x", 77, 88, 5, 6, 7) for i, t in enumerate(texts)]
    return rows + [(None, " ".join(word() for _ in range(50)), "en", "s1", 1, 0, "k", "r", 0, 0, "x", 0, 0, 0, 0, 0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(make_docs(), SCHEMA).repartition(3).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def lines(text) -> tuple[int, int]:
    ls = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    return len(ls), len(ls) - len(set(ls))


def passes_quality(text) -> bool:
    n, chars, symbols, dup, repeat, failed = brute.op9(text)
    return not (failed or 4 * symbols > n or 2 * dup > lines(text)[0] or (n > 0 and (chars < 2 * n or chars > 25 * n)))


def one_of_each_group(rows: list[tuple]) -> list[tuple]:
    found = brute.op1([(r[0], r[1]) for r in rows if r[0] is not None])
    return [r for r in rows if r[0] is None or found[r[0]][1] == r[0]]


def clean(rows: list[tuple]) -> list[tuple]:
    verdict = brute.op8([(n, r[1]) for n, r in enumerate(rows)], [i for i in ITEMS if i[0] is not None])
    return [r for n, r in enumerate(rows) if not verdict[n][-1]]


def same(df, rows) -> None:
    assert Counter(map(tuple, df.collect())) == Counter(rows)


def test_stages(spark, folder):
    """Each stage on what the one before it kept; every column passes as it is."""
    docs, rows = spark.read.parquet(f"{folder}/documents.parquet"), make_docs()
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:3], (lambda r: [x for x in r if passes_quality(x[1])], one_of_each_group, clean), strict=True):
        want = plain(rows)
        assert 0 < len(want) < len(rows), name
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns
        same(got, want)
        docs, rows = spark.createDataFrame(want, SCHEMA), want

    mixed = corpus_pipeline.mix_sources(spark, docs, folder)
    assert mixed.columns == docs.columns
    copies = Counter(map(tuple, mixed.collect()))
    assert set(copies) <= set(rows) and max(copies.values()) <= 2
    size = lambda r: len(brute.WORD.findall(r[1] or ""))
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += size(r)
    for r, n in copies.items():
        taken[r[3]] += n * size(r)
    for s, t in brute.op4_targets(sizes).items():
        assert taken[s] <= t and t - taken[s] <= max(size(r) for r in rows if r[3] == s)

    placed = corpus_pipeline.assign_shards(spark, mixed, folder).collect()
    assert Counter(r.doc_id for r in placed) == Counter({r[0]: n for r, n in copies.items()})
    assert all(r.shard == brute.op3_jump(-1 if r.doc_id is None else r.doc_id, 8) for r in placed)
    for shard in {r.shard for r in placed}:
        slots = sorted(r.slot for r in placed if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    kept = clean(one_of_each_group([r for r in make_docs() if passes_quality(r[1])]))
    got = [r.doc_id for r in out.collect()]
    assert set(got) <= {r[0] for r in kept} and len(got) >= len(kept)
    assert out.columns == [c for c in SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ") if c not in ("shard", "slot")] + ["shard", "slot"]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_policy_is_the_plain_one():
    assert quality_rules.V1.mask() == 0b11111 and quality_rules.BASE.mask() == 0b11


def test_sharding_query(spark, folder):
    docs = [(r[0], r[1]) for r in make_docs() if r[0] is not None]
    want = {i: (*v[:2], "key", *v[2:]) for i, v in brute.op3(docs).items()}
    out = queries.op3_sharding(spark, folder).where("doc_id IS NOT NULL").collect()
    assert {r.doc_id: (r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in out} == want
    assert all(r.grown_shard in (r.shard, 8) for r in out)


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in queries.op2_quality_classifier(spark, "/root/testdata/sf0.01").collect()}


def test_classifier_query(spark, scored):
    """All rows once, folds by checksum, scores that tell held-out labels apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert set(scored) == {r.doc_id for r in docs.select("doc_id").collect()}
    for i, r in scored.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if scored[r.doc_id].held_out}
    pos, neg = (np.array([scored[i].score for i, q in labels.items() if q == v]) for v in (1, 0))
    assert np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos]) > 0.9


def test_classifier_query_learns_from_texts_and_training_labels_only(spark, scored, tmp_path):
    """Other languages, sources and held-out labels change no score."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs.withColumns({"lang": F.lit("xx"), "source": F.concat("source", F.lit("y")), "n_chars": F.lit(1)}).write.parquet(str(tmp_path / "documents.parquet"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r.score for r in queries.op2_quality_classifier(spark, str(tmp_path)).collect()}
    assert got == {i: r.score for i, r in scored.items()}
