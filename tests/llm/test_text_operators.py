"""Operators held against brute force on a table of odd cases."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import decontaminate, ngram_join, pii, quality_rules, substring_dedup
from tests.llm import brute


def test_quality_rules(docs, rows, no_docs):
    entries = quality_rules.apply_policy(quality_rules.ledger(docs), quality_rules.BASE)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, not r.kept) for r in entries.collect())
    assert got == Counter((r[0], *brute.op9(r[1])) for r in rows)
    assert {"lang", "shard", "spans"} <= set(entries.columns)  # other columns stay
    assert quality_rules.ledger(no_docs).count() == 0


def test_quality_ablation(docs):
    entries = quality_rules.ledger(docs).cache()
    policy = quality_rules.V1
    mask = policy.mask()
    bits = [r.fail_bits & mask for r in entries.collect()]
    for r in quality_rules.ablate(entries, policy).collect():
        bit = next(1 << x.bit for x in quality_rules.RULES if x.name == r.rule)
        assert (r.rejected, r.rejected_alone, r.kept_without) == (sum(b & bit != 0 for b in bits), bits.count(bit), sum(b & ~bit == 0 for b in bits))


def test_ngram_join(docs, rows, no_docs):
    want = brute.op1([(r[0], r[1]) for r in {r[0]: r for r in rows}.values()])
    got = {r.id: (r.n, r.component) for r in ngram_join.join(docs, chunk_bytes=4000).collect()}
    assert got == want
    assert ngram_join.join(docs).count() == len(rows)
    assert ngram_join.join(no_docs).count() == 0


def test_ngram_join_null_ids_and_rounds(spark):
    text = " ".join(f"t{i}" for i in range(50))
    docs = spark.createDataFrame([(None, text), (5, text), (3, text), (9, text + " more")], "doc_id long, text string")
    for rounds in (0, 1, 2):
        got = sorted((r.id or -1, r.n, r.component or -1) for r in ngram_join.join(docs, rounds=rounds).collect())
        assert got == [(-1, 46, -1), (3, 46, 3), (5, 46, 3), (9, 47, 3)]


def _edited(r, base, edits, vocab=100_000):
    """A copy with words replaced, added or left out at random places."""
    words = list(base)
    for _ in range(edits):
        i = r.randrange(len(words))
        words[i : i + r.choice([1, 1, 0, 1])] = [f"e{r.randrange(vocab)}"] * r.choice([1, 1, 1, 0])
    return words


@pytest.mark.parametrize("vocab, paired, rounds", [(100_000, 8, 12), (100_000, 2, 0), (3, 2, 12), (3, 2, 0)])
def test_ngram_join_of_copies_around_the_threshold(spark, vocab, paired, rounds):
    """Copies with one to nine edits, copies of copies, and texts that share a passage only."""
    import random

    r = random.Random(vocab + paired)
    texts = []
    for _ in range(2):
        base = [f"b{r.randrange(10**6)}" for _ in range(100)]
        for _ in range(60):
            copy = _edited(r, base, r.randrange(1, 6), vocab)
            texts.append(copy)
            texts += [_edited(r, copy, r.randrange(1, 5), vocab) for _ in range(r.randrange(3))]
        texts += [base[:70] + [f"c{r.randrange(10**6)}" for _ in range(r.randrange(5, 30))] for _ in range(30)]
    r.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {x.id: (x.n, x.component) for x in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), paired=paired, rounds=rounds).collect()}
    want = brute.op1(rows)
    assert got == want and len({c for _, c in want.values()}) > 20


def test_deduplicate_carries_any_column(spark):
    rows = [(2, "a b c d e f", 7, "x", None), (1, "a b c d e f", 8, "y", 2), (None, "a b c d e f", 9, "z", 3), (5, None, 1, None, 4), (5, None, 1, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, component string, node long")
    got = sorted(map(tuple, ngram_join.deduplicate(docs).collect()), key=str)
    assert got == sorted([rows[1], rows[2], rows[3]], key=str)


def test_deduplicate(docs, rows):
    want = brute.op1([(r[0], r[1]) for r in {r[0]: r for r in rows}.values()])
    got = sorted(r.doc_id for r in ngram_join.deduplicate(docs).collect())
    assert got == sorted({c for _, c in want.values()})


@pytest.mark.parametrize("chunk_bytes", [2000, 4 << 20])
def test_substring_dedup(docs, rows, no_docs, chunk_bytes):
    want = Counter()
    words = [(n, r[1]) for n, r in enumerate(rows)]
    for n, w in brute.op10(words).items():
        want[(rows[n][0], *w)] += 1
    out = substring_dedup.parse(docs, chunk_bytes=chunk_bytes, askers=2)
    got = Counter((r.key, r.n_words, sum(s.end - s.start for s in r.spans), brute.sha(r.kept)) for r in out.collect())
    assert got == want
    assert substring_dedup.parse(no_docs).count() == 0


def test_factors_follow_one_reference():
    import numpy as np

    at, ref, place = np.array([0, 1, 2, 3, 4, 40, 41]), np.array([7, 7, 7, 9, 9, 7, 7]), np.array([5, 6, 7, 0, 1, 8, 30])
    got = substring_dedup.factors(at, ref, place, 35).tolist()
    assert got == [[0, 37, 7, 5], [3, 39, 9, 0], [40, 75, 7, 8], [41, 76, 7, 30]]
    assert substring_dedup.merged([(a, b) for a, b, *_ in got]) == [(0, 39), (40, 76)]
    assert substring_dedup.merged([(0, 35), (35, 70)]) == [(0, 70)] and substring_dedup.merged([]) == []


def test_factors_need_the_words_of_their_reference(spark, docs, monkeypatch):
    """Windows whose keys are equal but whose words are not give no duplicate span."""
    from types import SimpleNamespace

    import numpy as np

    texts = [b"a b c d e", b"a b x d e"]
    words = substring_dedup.C.Words(texts)
    p = SimpleNamespace(factors=np.array([[0, 3, 0, 0], [5, 8, 0, 0]]), copy=np.array([False, True]), ends=np.array([[0, 0, 5], [0, 0, 5]]), windows=SimpleNamespace(words=words))
    told = [{"ref": 0, "texts": substring_dedup.zstandard.compress(b"a b c")}]
    assert substring_dedup._agree(p, texts, told, 3).tolist() == [True, False]
    told = [{"ref": 0, "texts": substring_dedup.zstandard.compress(b"a b x")}]
    assert substring_dedup._agree(p, texts, told, 3).tolist() == [True, True]


ITEMS = [("i1", "The quick brown fox jumps over the lazy dog and then sleeps all day long"), ("i2", "short item of five words"), ("i3", "two words"), ("i4", None), ("i5", "  ,; "), (None, "no id here"), ("i1", "again x y z"), ("i6", "a a a a a a a a a a a a a a a a a")]


def test_decontaminate(spark, no_docs):
    long = ITEMS[0][1]
    texts = [None, "", "nothing here", f"intro, {long.upper()}! end", f"{' '.join(['pad'] * 400)} {long}", "Short; item of FIVE words two, words", "a " * 40, "again x y z", " ".join(long.split()[:12]), long + " " + long, "É é " * 10 + "two words"]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_hit string").repartition(2)
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    want = brute.op8(rows, [i for i in ITEMS if i[0] is not None])
    out = decontaminate.decontaminate(docs, bench).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_words, r.n_hit, len(r.item_ids), brute.sha(",".join(r.item_ids)), r.contaminated) == want[r.doc_id], r
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    empty = bench.limit(0)
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, empty).collect())


def test_pii_base(docs, rows, no_docs):
    found = pii.find(docs.select("doc_id", "text", "spans"))
    got = Counter((r.doc_id, r.s) for r in found.select("doc_id", pii.joined(F.col("base")).alias("s")).collect())
    assert got == Counter((r[0], ",".join(brute.op7(r[1])[1])) for r in rows)
    assert pii.find(no_docs.select("doc_id", "text")).count() == 0


def test_pii_query(spark, tmp_path, rows):
    """All columns of the registered query; base spans among all spans; clashing columns and long lists of matches."""
    from tessella.llm import queries

    texts = [(i, r[1], "k", 1) for i, r in enumerate(rows)]
    texts.append((900, " ".join(f"write to u{n}@mail.example.com or 10.0.{n % 300}.1, +49 30 {1000000 + n}" for n in range(5000)), "k", 2))
    spark.createDataFrame(texts, "doc_id long, text string, __t string, __key long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op7_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t, *_ in texts:
        (e, ip, c, p, sha), spans = brute.op7(t)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (e, ip, c, p, sha)
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("term")) == ",".join(spans)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert {"__t", "__key"} <= set(pii.find(docs).columns)
    assert sorted(pii.sanitise(docs).columns) == sorted(docs.columns)


def test_pii_generalises_to_a_broader_term(spark):
    """A word that is mostly beside addresses is replaced by the commoner one that always stands with it there."""
    rows = [(i, f"contact Wendelin at u{i}@mail.example.com") for i in range(40)]
    rows += [(100 + i, "contact us") for i in range(400)] + [(600 + i, "Wendelin said so") for i in range(12)] + [(700 + i, "at home") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    (term,) = pii.find(docs).where("doc_id = 3").first().terms
    assert (term.action, term.by) == ("generalise", "contact")
    assert pii.sanitise(docs).where("doc_id = 3").first().text == "contact contact at [EMAIL]"


def test_pii_terms_and_redaction(spark):
    """A name that stands only beside addresses gives them away; a word found everywhere doesn't."""
    rows = [(i, f"please write to Zebulon at u{i}@mail.example.com about it") for i in range(6)]
    rows += [(100 + i, "please write about it, there is nothing here") for i in range(60)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    text = rows[0][1]
    assert [(s.start, s.end) for s in got[0].terms] == [(text.index("Zebulon"), text.index("Zebulon") + 7)]
    assert not got[100].terms and not got[500].base
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == "please write to  at [EMAIL] about it" and clean[100] == rows[6][1] and clean[500] is None


def test_pii_positions_are_code_points(spark):
    docs = spark.createDataFrame([(1, "😀😀 a@b.co 😀 +49 30 1234567")], "doc_id long, text string")
    r = pii.find(docs).select(pii.joined(F.col("base")).alias("s")).first()
    assert r.s == ",".join(brute.op7("😀😀 a@b.co 😀 +49 30 1234567")[1])
