"""Sharding, mixing, archives, token files and the classifier."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing, quality_classifier, sharding, token_ids, warc
from tests.llm import brute


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.arange(5000, dtype=np.int64).view(np.uint64)
    for n in (1, 2, 7, 8, 9, 100):
        got = sharding.jump_hash(keys, n)
        assert got[:200].tolist() == [brute.op3_jump(k, n) for k in range(200)]
        grown = sharding.jump_hash(keys, n + 1)
        assert ((grown == got) | (grown == n)).all()
        assert np.bincount(got, minlength=n).max() < 5000 / n * 1.5


def test_sharding(docs, rows, no_docs):
    out = sharding.assign(docs, "doc_id", 8).collect()
    assert Counter(r.shard for r in out) == Counter(brute.op3_jump(r[0], 8) for r in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(no_docs, "doc_id", 8).count() == 0


def test_sharding_null_keys(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c")], "doc_id long, text string")
    out = sharding.assign(docs, "doc_id", 8, ["text"]).collect()
    assert len({r.shard for r in out if r.doc_id is None}) == 1


def test_write_shards(docs, tmp_path, spark, rows):
    sharding.write_shards(sharding.assign(docs, "doc_id", 4), str(tmp_path / "s"), 2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(rows)


def test_mixing(docs, rows, no_docs):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(brute.WORD.findall(r[1] or ""))
    want = brute.op4_targets(sizes)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    taken = Counter()
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 and r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    # Documents are taken whole, so a source misses its target by less than a document.
    largest = {s: max(r.size for r in out if r.source == s) for s in want}
    assert all(want[s] - largest[s] < taken[s] <= want[s] for s in want)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in out) == Counter((r.doc_id, r.taken) for r in again)
    assert mixing.mix(no_docs).count() == 0


def test_mixing_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert len(got) == 20 and all(abs(r.taken - r.target) < 0.02 * r.target for r in got)


def test_mixed_rows(docs):
    copies = Counter()
    for r in mixing.mix(docs, shards=4).collect():
        copies[r.doc_id] += r.copies
    out = mixing.mixed_rows(docs, shards=4).collect()
    assert Counter(r.doc_id for r in out) == +copies
    assert all(0 <= r.mix_shard < 4 for r in out)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_split_tree_is_disjoint_and_even(spark, shards):
    quotas = {0: 15, 1: 25, 2: 35, 3: 1}
    out = mixing.split_tree(spark.createDataFrame(list(quotas.items()), "rank long, quota long"), shards).collect()
    drawn = [(r["rank"], u) for r in out for u in range(r["from"] + 1, r["to"] + 1)]
    assert sorted(drawn) == [(k, u) for k, q in quotas.items() for u in range(1, q + 1)]
    n = Counter()
    for r in out:
        n[r.shard] += r["to"] - r["from"]
    assert len(n) == shards and max(n.values()) - min(n.values()) <= 3


def test_split_tree_follows_the_law(spark):
    """Over many seeds, the units of a source that go left have the mean and variance of a hypergeometric draw."""
    quotas = spark.createDataFrame([(0, 12), (1, 28)], "rank long, quota long").cache()
    left = np.array([sum(r["to"] - r["from"] for r in mixing.split_tree(quotas, 2, seed).collect() if r["rank"] == 0 and r.shard == 0) for seed in range(40)])
    var = 20 * 0.3 * 0.7 * 20 / 39
    assert abs(left.mean() - 6) < 4 * (var / 40) ** 0.5 and 0.4 * var < left.var() < 2.2 * var


def test_mix_is_what_the_leaves_draw(docs, rows):
    """Every copy lies in a block that some leaf drew, and all documents of whole blocks are taken."""
    planned, blocks = mixing.plan(docs, "source", "text", ["doc_id"], shards=4, blocks_per_shard=8)
    drawn = mixing.draws(blocks, 4).collect()
    assert len({(r["rank"], r.block, r["pass"]) for r in drawn}) == len(drawn)
    units = Counter((r["rank"], r.block) for r in drawn)
    whole = Counter((r["rank"], r.block) for r in drawn if r.room is None)
    place = {(r.g, r.h, r.rn): (r["rank"], r.block, r["size"]) for r in planned.collect()}
    got = Counter((r.g, r.h, r.rn) for r in mixing.taken(planned, blocks, 4).collect())
    for link, (rank, block, size) in place.items():
        n = got[link]
        assert (n == 0) if not size else whole[rank, block] <= n <= units[rank, block]


def test_mixing_carries_any_column(spark):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 2}", i, "x") for i in range(30)], "doc_id long, text string, source string, rank long, shard string")
    out = mixing.mixed_rows(docs)
    assert out.columns == [*docs.columns, "mix_shard", "mix_order"] and all(r["rank"] == r.doc_id and r.shard == "x" for r in out.collect())


def test_mixing_query(spark, tmp_path, rows):
    """All columns of the registered query."""
    from tessella.llm import queries

    texts = [(i, r[1], r[3]) for i, r in enumerate(rows)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    sizes, of = Counter(), {i: len(brute.WORD.findall(t or "")) for i, t, _ in texts}
    for i, _, s in texts:
        sizes[s] += of[i]
    want = brute.op4_targets(sizes)
    out = queries.op4_mixing(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, *_ in texts)
    source = {i: s for i, _, s in texts}
    total = Counter()
    for r in out:
        s = source[r.doc_id]
        assert r["size"] == of[r.doc_id] and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken in (0, r["size"], 2 * r["size"])
        total[s] += r.taken
    assert all(total[s] <= want[s] and want[s] - total[s] <= max(of[i] for i in of if source[i] == s) for s in want)


PAGES = [(1, "http://a/1", "x" * 200), (2, "http://a/2", "x" * 200), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u\r\nWARC-Type: forged", "é" * 50_000), (8, "u", "é" * 50_000), (None, "u", "x" * 200), (9, "u", "line\r\n\r\nWARC/1.1\r\n" * 30), (9, "u", "line\r\n\r\nWARC/1.1\r\n" * 30)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    _, manifest = warc.archive(pages)
    out = warc.read(spark, manifest).collect()
    first = {2: 1, 8: 7}
    want = Counter()
    for i, _, html in PAGES:
        b = (html or "").encode()
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if i in first else "response", first.get(i))] += 1
    assert Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
    assert all(r.payload == (dict((p[0], p[2]) for p in PAGES)[r.id] or "").encode() for r in out if r.record_type == "response")
    assert warc.unresolved(warc.read(spark, manifest)).count() == 0
    forged = warc.read(spark, manifest).withColumn("payload_digest", F.when(F.col("id") == 8, F.lit("0" * 64)).otherwise(F.col("payload_digest")))
    assert [r.id for r in warc.unresolved(forged).collect()] == [8]
    records = warc.read_records(spark, manifest)
    assert records.where("type = 'continuation'").count() > 5
    _, none = warc.archive(pages.limit(0))
    assert warc.read(spark, none).count() == 0


def test_warc_broken_segments():
    parts = [{"number": n, "block": b"abc", "total": 9 if n == 3 else None} for n in (1, 2, 3)]
    assert warc.join_segments(parts) == b"abcabcabc"
    for bad in (parts[:2], [parts[0], parts[2]], [*parts[:2], parts[2] | {"total": 8}]):
        with pytest.raises(ValueError):
            warc.join_segments(bad)
    assert warc.unframe(warc.frame(b"q" * 9999)) == b"q" * 9999 and warc.unframe(warc.frame(b"")) == b""
    with pytest.raises(ValueError):
        warc.unframe(b"3\r\nabcd\r\n0\r\n\r\n")


def test_rank_coding_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (r.integers(0, 1 << 32, n, dtype=np.uint64) >> r.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        assert (token_ids.decode_ranks(*token_ids.encode_ranks(x), n) == x).all()


@pytest.mark.parametrize("pieces", [True, False])
def test_token_files(spark, docs, rows, no_docs, pieces):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = [(1000, "I'm we'll <|endoftext|> a<|startoftext|>b c d é İ ΑΣ. '' 's 12 3"), (1001, "\x1c\x85x\x1fy"), (None, "null id")]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    folder, manifest = token_ids.encode(every, path, 2, pieces=pieces)
    tokenizer = Tokenizer.from_file(path)
    want, at = Counter(), 0
    both = [(r[0], r[1]) for r in rows] + odd
    for i, t in sorted(both, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want[(i, at, len(ids), zlib.crc32(ids.tobytes()))] += 1
        at += len(ids)
    got = Counter((r.key, r.start, r.n_ids, zlib.crc32(r.ids)) for r in token_ids.read_files(spark, folder, manifest).collect())
    assert got == want
    folder, manifest = token_ids.encode(no_docs, path, 2)
    assert token_ids.read_files(spark, folder, manifest).count() == 0


def test_pieces_give_the_ids_of_whole_texts():
    """All code points with a tail, and mixes of what joins its neighbours after normalising."""
    import random

    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(3)
    tails = (".", ",", "!'s", "\u2026", "\u0307.", "'", "<|endoftext|>", "-")
    odd = ["\u0130", "\u0958", "a", "B", "\u03a3", ".", ",", "'", " ", "\u0301", "\n", "\u1100", "\u1161", "\u11a8", "1", "<|endoftext|>", "\u2028", "\xa0", "\x1c", "$"]
    letters = [chr(c) for c in range(1, 0x3000)] + [chr(r.randrange(0xE000, 0x110000)) for _ in range(3000)]
    texts = [f"{c}{t} x{c}{t}" for c in letters for t in (r.choice(tails),)] + ["".join(r.choices(odd, k=r.randrange(12))) for _ in range(20_000)]
    encoder = token_ids.Encoder(path, 2, "<u2")
    assert encoder.pieces
    ids, n = encoder.batch(pa.array(texts))
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert n.tolist() == [len(w.ids) + 1 for w in want]
    assert ids.tolist() == [i for w in want for i in (*w.ids, 2)]
    assert not token_ids.cuts_at_white_space(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_query(spark, tmp_path, docs, rows):
    """The registered query on a table whose letters join the punctuation behind them after normalising."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessella.llm import queries

    texts = [(i, r[1]) for i, r in enumerate(rows)] + [(500, "\u0130. \u0130, x\u0130! \u0958. \u095b. \u095e."), (501, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer, want, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set(), 0
    for i, t in sorted(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.add((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = queries.op6_token_ids(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 3000")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    stats = quality_classifier.table_of_statistics(docs, "doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = quality_classifier.train(stats, labels, "doc_id", "quality", fold != 1)
    got = quality_classifier.score(stats, model).withColumnRenamed("id", "doc_id").join(labels, "doc_id").where(fold == 1).collect()
    pos, neg = (np.array([r.score for r in got if r.quality == q]) for q in (1, 0))
    assert np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos]) > 0.97


def test_classifier_odd_cases(spark, docs, rows, no_docs):
    stats = quality_classifier.table_of_statistics(docs, "doc_id", "text")
    for some in ([], [(3, 1)], [(i, i % 2) for i in range(60)] + [(None, 1), (5, None), (6, 7)]):
        labels = spark.createDataFrame(some, "doc_id long, quality int")
        model = quality_classifier.train(stats, labels, "doc_id", "quality", F.lit(True))
        out = quality_classifier.score(stats, model).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    empty = quality_classifier.table_of_statistics(no_docs, "doc_id", "text")
    assert quality_classifier.score(empty, model).count() == 0


def test_trees_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, len(quality_classifier.NAMES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    m = quality_classifier.fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97
