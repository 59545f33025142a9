"""Benchmark decontamination by winnowing.

A span of ``span`` words holds ``span - k + 1`` k-grams; its fingerprint is the smallest of their
hashes. Equal spans have equal fingerprints, so every shared span of that length is met when
training and test fingerprints are joined; neighbouring spans mostly share one fingerprint, so a
document is a short list of them. In the documents that met, the fingerprints are then extended to the spans they
stand for, and those are compared in full (the words themselves, not hashes): hits are exact.

Items shorter than ``span`` words are one window each and are met through their first (at most k)
words. Both joins let Spark choose: a benchmark under the broadcast threshold is broadcast, a larger
one is shuffled.

Texts are judged once each: equal texts share a 128-bit key, under which the verdicts are joined back.

Defined results: null or wordless texts have no words and no hits; items without words, or with a null
id, are no items; repeated items count once per id; an empty benchmark leaves every document clean;
columns that clash with result names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import carried, grams, let, sliding_min, split_lower, split_words, store, text_key, unpacked

#: Everything but ASCII letters (before or after lower-casing), digits and all characters beyond ASCII.
GAP_RE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
SPAN, K = 13, 5
RESULTS = ("n_words", "n_hit", "item_ids", "contaminated")


def words_of(text: Column) -> Column:
    return split_lower(F.coalesce(text, F.lit("")), GAP_RE)


def count_words(text: Column) -> Column:
    """How many words a text has; their case doesn't matter for that."""
    return F.size(split_words(text, GAP_RE)).cast("long")


def _values(words: Column, kind: int, span: int, k: int) -> Column:
    """What windows are met by, by the first word of each: the smallest k-gram hash of a span (kind 0), or the hash of its
    first ``kind`` words, kept apart by the kind."""
    if not kind:
        return sliding_min(grams(words, k), span - k + 1)
    return F.transform(grams(words, kind), lambda v: F.xxhash64(F.lit(kind), v))


def _marks(words: Column, kinds: list[int], span: int, k: int) -> Column:
    """The distinct values of a text. Plain numbers: structs would be computed once per field that is asked of them."""
    return F.concat(*(F.array_distinct(_values(words, g, span, k)) for g in kinds))


def item_windows(bench: DataFrame, item: str, text: str, span: int, k: int) -> DataFrame:
    """(item, length, window text, kind, anchor value) of every window of every item."""
    w = bench.where(F.col(f"`{item}`").isNotNull()).select(F.col(f"`{item}`").cast("string").alias("item"), words_of(F.col(f"`{text}`")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(span))
    each = w.select("item", n.alias("len"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i")).select("item", "len", F.slice("w", F.col("i"), F.col("len")).alias("w"))
    short = F.least(F.col("len"), F.lit(k))
    value = F.when(F.col("len") == span, F.array_min(grams(F.col("w"), k))).otherwise(F.xxhash64(short, F.xxhash64(F.slice("w", F.lit(1), short))))
    kind = F.when(F.col("len") == span, F.lit(0)).otherwise(short)
    return each.select("item", "len", F.array_join("w", " ").alias("window"), kind.alias("kind"), value.alias("v")).distinct()


def scan(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """One row per distinct text that has a hit: key, n_words, n_hit, item_ids (sorted)."""
    windows = store(item_windows(bench, item, item_text, span, k), "windows")
    # At most k + 1 kinds and ``span`` lengths, whatever the benchmark's size.
    lens: dict[int, list[int]] = {0: [span]}
    for r in windows.select("kind", "len").distinct().collect():
        lens[r["kind"]] = sorted({*lens.get(r["kind"], []), r["len"]})
    kinds = sorted(lens)
    marks = windows.select("v").distinct()
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    mine = docs.select(text_key(body).alias("key"), let(words_of(body), lambda w: _marks(w, kinds, span, k)).alias("s"))
    # Outer: for a plain explode the array would be computed once more, to leave empty ones out before.
    mine = mine.select("key", F.explode_outer("s").alias("v"))
    met = store(mine.join(marks, "v", "left_semi").select("key", "v").distinct(), "met")

    # Extend: in the texts that met, all spans that stand for a value that met, cut from the text again.
    per_text = met.groupBy("key").agg(F.collect_set("v").alias("vs"))
    keyed = docs.select(text_key(body).alias("key"), body.alias("body"))
    # Only texts that met go on, one of each: copies are dropped by the task that read them, before any shuffle.
    texts = keyed.join(store(met.select("key").distinct(), "keys"), "key", "left_semi")
    texts = texts.groupBy("key").agg(F.first("body").alias("body")).join(per_text, "key")

    def spans(w: Column) -> Column:
        def of_kind(g: int) -> Column:
            window = lambda i: lambda n: F.struct(i.alias("i"), n.alias("len"), F.array_join(F.slice(w, i + 1, n), " ").alias("window"))
            fits = lambda i: F.filter(F.array(*(F.lit(n) for n in lens[g])), lambda n: i + n <= F.size(w))

            def found(values: Column) -> Column:
                at = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
                hit = F.filter(at, lambda i: F.array_contains("vs", F.get(values, i)))
                return F.flatten(F.transform(hit, lambda i: F.transform(fits(i), window(i))))

            return let(_values(w, g, span, k), found)

        return F.concat(*(of_kind(g) for g in kinds))

    cut = let(words_of(F.col("body")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), spans(w).alias("s")))
    found = texts.select("key", cut.alias("c")).select("key", "c.n_words", F.explode("c.s").alias("s")).select("key", "n_words", "s.*")
    names = windows.groupBy("len", "window").agg(F.collect_set("item").alias("items"))
    hits = found.join(names, ["len", "window"]).groupBy("key").agg(
        F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_list(F.struct("i", "len"))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids")
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def cover(a: Column, x: Column) -> Column:
        stop = x["i"] + x["len"]
        return F.struct((a["n"] + F.greatest(F.lit(0), stop - F.greatest(x["i"], a["end"]))).alias("n"), F.greatest(a["end"], stop).alias("end"))

    return hits.select("key", "n_words", F.aggregate("at", zero, cover)["n"].cast("long").alias("n_hit"), "item_ids")


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", percent: int = 5, span: int = SPAN, k: int = K) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids and contaminated (hit words reach ``percent`` of all)."""
    hits = store(scan(docs, bench, text, item, item_text, span, k).drop("n_words"), "hits")
    names, row = carried(docs, RESULTS)
    body = F.col(f"`{text}`")
    keyed = docs.select(text_key(body).alias("key"), row, count_words(body).alias("n_words"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return keyed.join(hits, "key", "left").select(
        *unpacked(names),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        _is_contaminated(n_hit, F.col("n_words"), percent).alias("contaminated"),
    )


def _is_contaminated(n_hit: Column, n_words: Column, percent: int) -> Column:
    return (n_hit > 0) & (n_hit * 100 >= n_words * percent)


def drop_contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", percent: int = 5, span: int = SPAN, k: int = K) -> DataFrame:
    """``docs`` without the contaminated ones."""
    hits = scan(docs, bench, text, item, item_text, span, k)
    bad = store(hits.where(_is_contaminated(F.col("n_hit"), F.col("n_words"), percent)).select("key"), "contaminated")
    names, row = carried(docs)
    return docs.select(text_key(F.col(f"`{text}`")).alias("key"), row).join(bad, "key", "left_anti").select(*unpacked(names))
