"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: weights share the budget; a source stops at ``cap`` times its size and the excess goes to the others by
   weight, level by level (``targets``).
2. Blocks: a source's documents fall by a seeded hash into blocks of at most about ``block_words`` words, and at least
   ``blocks_per_shard`` blocks per shard in all. A source's blocks are permuted by hash; its quota is the number of
   blocks that its target takes: all of them once per full pass, then of the permutation all that fit the rest of the
   target, and ``parts`` more, which fill what is left.
3. Tree: quotas are split in two again and again until each leaf is one output shard. A split ranks
   the units of a node by a seeded hash and sends the lower half left: a draw without replacement, so
   the counts per source follow the multivariate hypergeometric law exactly (``split_tree``).
4. Each leaf draws as many of a source's permuted blocks as its quota says, disjoint from those of other leaves. What the
   leaves drew, and nothing else, is the mix (``draws``); a shard shuffles it by a hash of its own.

The last blocks of a source are taken in part: their documents in hash order while they fit, then the largest that still
fit, until none does. All ranks and running sums are found in cells of the hash, so no task gets all units
of a node or all blocks of a source. Only hashes of keys and seeds decide, so reruns agree.

Defined results: null texts have size 0; a null source is a source of its own, ordered last; documents
of size 0 are never taken; repeated rows are taken or left one by one with equal odds; an empty table
gives an empty mix; columns named as internal ones are carried in a struct and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD_RE, drop_stored, store

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
SEED = 20
#: Words of a block at most (about), and blocks of a source that are taken in part.
BLOCK_WORDS, PARTS = 1 << 20, 8


def _unit(*parts: Column | str) -> Column:
    """A uniform number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def _weighed(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, source_size, rank, weight, limit): ranks by code point, found in ranges of the sources."""
    order = F.col("source").asc_nulls_last()
    parts = store(sizes.select("source", "source_size").repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rn = F.row_number().over(Window.partitionBy("part").orderBy(order))
    # One row per range of sources.
    rank = parts.withColumn("rn", rn).join(F.broadcast(before), "part").withColumn("rank", (F.col("before") + F.col("rn") - 1).cast("long"))
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int"))
    return rank.select("source", "source_size", "rank", weight.alias("weight"), (F.col("source_size") * float(cap)).alias("limit"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, rank, weight, target) of sources (source, source_size)."""
    s = store(_weighed(sizes, weights, cap), "weighed")
    level, full = 0.0, -1
    while True:
        # The excess of the sources that are full is shared again, until no more become so.
        over = F.col("weight") * level > F.col("limit")
        budget, taken, weight, now = s.agg(F.sum("source_size") * float(share), F.sum(F.when(over, F.col("limit"))), F.sum(F.when(~over & (F.col("source_size") > 0), F.col("weight"))), F.count_if(over)).first()
        if now == full or not weight:
            break
        level, full = (budget - (taken or 0.0)) / weight, now
    target = F.when(F.col("source_size") > 0, F.least(F.col("limit"), F.col("weight") * level)).otherwise(F.lit(0.0))
    return s.select("source", "source_size", "rank", "weight", target.alias("target"))


def _lined(rows: DataFrame, by: list[str], ties: list[str], words: str | None = None) -> DataFrame:
    """``rows`` with ``turn`` (from 1) and ``till`` (running sum of ``words``) in the order of their hash ``h`` in each
    group: counted in cells of the hash first, so a group is spread over tasks."""
    rows = rows.withColumn("cell", F.shiftrightunsigned("h", 56))
    add = F.col(words) if words else F.lit(1).cast("long")
    cells = rows.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"), F.sum(add).alias("w"))
    before = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select(*by, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base_w"))
    within = Window.partitionBy(*by, "cell").orderBy("h", *ties)
    sums = rows.withColumn("rn", F.row_number().over(within)).withColumn("rw", F.sum(add).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = sums.join(bases, [*by, "cell"])
    return out.withColumn("turn", F.col("base_n") + F.col("rn")).withColumn("till", F.col("base_w") + F.col("rw")).drop("cell", "rn", "rw", "base_n", "base_w")


#: 128 bits of a row's key and text, and a number among equal rows.
LINK = ("g", "h", "rn")


def _linked(docs: DataFrame, key: list[str], source: str, text: str, more: list[Column]) -> DataFrame:
    g, h = F.xxhash64(*(F.col(f"`{c}`") for c in key)), F.xxhash64(F.col(f"`{text}`"))
    rows = docs.select(g.alias("g"), h.alias("h"), F.struct(*(F.col(f"`{c}`") for c in key)).alias("key"), F.col(f"`{source}`").cast("string").alias("source"), *more)
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("g", "h").orderBy("g")))


def plan(docs: DataFrame, source: str, text: str, key: list[str], weights=WEIGHTS, share=SHARE, cap=CAP, shards: int = 8, blocks_per_shard: int = 64, block_words: int = BLOCK_WORDS, parts: int = PARTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks): every document with its block, and every block with its turn and what is taken of it."""
    base = store(_linked(docs, key, source, text, [word_count(F.col(f"`{text}`")).alias("size")]), "sizes")
    aims = store(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    total = aims.agg(F.sum("target")).first()[0] or 0.0
    block = max(1.0, min(float(block_words), total / (shards * blocks_per_shard)))
    aims = aims.withColumn("n_blocks", F.greatest(F.lit(1), F.round(F.col("source_size") / block)).cast("long"))
    aims = aims.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    aims = aims.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))

    # A document's place on its source's line decides its block; the line is a permutation by hash.
    place = _unit(F.lit(seed), F.col("rank"), *LINK)
    rows = base.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "weight")
    rows = rows.withColumn("place", place).withColumn("block", F.floor(F.col("place") * F.col("n_blocks")))
    rows = store(rows, "places")
    drop_stored(base)

    sums = rows.groupBy("rank", "block", "passes", "rest").agg(F.sum("size").alias("words"))
    sums = _lined(sums.withColumn("h", F.xxhash64(F.lit(seed), F.lit("turn"), F.col("rank"), F.col("block"))), ["rank"], ["block"], "words")
    sums = store(sums, "lined")
    fits = F.col("till") <= F.col("rest")
    wholes = sums.groupBy("rank").agg(F.count_if(fits).alias("wholes"), F.coalesce(F.max(F.when(fits, F.col("till"))), F.lit(0)).alias("filled"))
    sums = sums.join(wholes, "rank").withColumn("room", F.col("rest") - F.col("filled"))
    state = F.when(fits, F.lit("whole")).when((F.col("room") > 0) & (F.col("turn") <= F.col("wholes") + parts), F.lit("part")).otherwise(F.lit("none"))
    return rows, store(sums.select("rank", "block", "passes", "words", "turn", state.alias("state"), "room"), "blocks")


def split_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(rank, shard, from, to): quotas (rank, quota) parted among shards by halving level by level; a shard gets the
    units from + 1 to ``to`` of a source's line."""
    units = quotas.select("rank", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))).alias("u"))
    node, low, high = units.withColumn("low", F.lit(0)).withColumn("high", F.lit(shards)), F.col("low"), F.col("high")
    for level in range(max(0, (shards - 1).bit_length())):
        split, mid = high - low >= 2, low + F.floor((high - low) / 2).cast("int")
        ranked = _lined(node.withColumn("h", F.xxhash64(F.lit(seed), F.lit(level), F.col("rank"), F.col("u"))), ["low", "high"], ["rank", "u"])
        sizes = node.groupBy("low", "high").agg(F.count(F.lit(1)).alias("all"))
        # At most one row per shard.
        left = F.col("turn") * (high - low) <= F.col("all") * (mid - low)
        node = ranked.join(F.broadcast(sizes), ["low", "high"]).select("rank", "u", F.when(split & ~left, mid).otherwise(low).alias("low"), F.when(split & left, mid).otherwise(high).alias("high"))
        node = store(node, f"level{level}")
    # The tree says how many units of a source a shard gets; which ones, the permutation of its blocks.
    counts = node.groupBy("rank", "low").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("rank").orderBy("low").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.select("rank", F.col("low").alias("shard"), (upto - F.col("n")).alias("from"), upto.alias("to"))


def draws(blocks: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(rank, block, pass, shard, state, room): the units that the leaves of the tree draw."""
    taken = F.col("state") != "none"
    quotas = blocks.groupBy("rank").agg(F.count(F.lit(1)).alias("n_blocks"), (F.sum("passes") + F.count_if(taken)).alias("quota"))
    ranges = store(split_tree(quotas.where(F.col("quota") > 0).select("rank", "quota"), shards, seed), "ranges")
    each = F.sequence(F.lit(1).cast("long"), F.col("passes") + taken.cast("long"))
    units = blocks.where((F.col("passes") > 0) | taken).join(quotas.select("rank", "n_blocks"), "rank")
    units = units.select("rank", "block", "passes", "state", "room", "turn", "n_blocks", F.explode(each).alias("pass"))
    units = units.withColumn("u", (F.col("pass") - 1) * F.col("n_blocks") + F.col("turn"))
    at = ranges.withColumnRenamed("rank", "r")
    drawn = units.join(at, (F.col("rank") == F.col("r")) & (F.col("u") > F.col("from")) & (F.col("u") <= F.col("to")))
    in_part = (F.col("pass") > F.col("passes")) & (F.col("state") == "part")
    return store(drawn.select("rank", "block", "turn", "pass", "shard", F.when(in_part, F.col("room")).alias("room")), "draws")


def _part(rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """(rank, links, pass, shard) of the documents taken from the blocks that are drawn in part."""
    cut = drawn.where(F.col("room").isNotNull())
    line = Window.partitionBy("rank")
    so_far = line.orderBy("turn", "place", *LINK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = rows.where(F.col("size") > 0).select("rank", "block", "place", "size", *LINK).join(cut, ["rank", "block"])
    # A few blocks of a source: bounded by parts, block_words and the longest document.
    part = store(part.withColumn("took", F.sum("size").over(so_far) <= F.col("room")), "part")
    while True:
        # Of those that fit the gap, the largest ones as far as they go: what is left of it halves at least.
        gap = part.withColumn("gap", F.col("room") - F.sum(F.when(F.col("took"), F.col("size")).otherwise(F.lit(0))).over(line))
        fits = gap.withColumn("fits", ~F.col("took") & (F.col("size") <= F.col("gap")))
        first = line.orderBy(F.desc("fits"), F.desc("size"), *LINK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        more = fits.withColumn("more", F.col("fits") & (F.sum("size").over(first) <= F.col("gap")))
        after = store(more.select(*[c for c in part.columns if c != "took"], (F.col("took") | F.col("more")).alias("took"), "more"), "part")
        part, past = after.drop("more"), part
        drop_stored(past)
        if not after.where("more").limit(1).count():
            break
    return part.where("took").select("rank", *LINK, "pass", "shard")


def taken(rows: DataFrame, blocks: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(rank, links, pass, shard): every document once per copy that a leaf of the tree drew."""
    drawn = draws(blocks, shards, seed)
    whole = rows.where(F.col("size") > 0).select("rank", "block", *LINK).join(drawn.where(F.col("room").isNull()), ["rank", "block"])
    return whole.select("rank", *LINK, "pass", "shard").unionByName(_part(rows, drawn))


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: list[str] | None = None, shards: int = 8, seed: int = SEED, **options) -> DataFrame:
    """Per document: its key columns, source, size, source_size, target, copies and taken words."""
    key = key or ["doc_id"]
    rows, blocks = plan(docs, source, text, key, shards=shards, seed=seed, **options)
    copies = taken(rows, blocks, shards, seed).groupBy("rank", *LINK).agg(F.count(F.lit(1)).cast("int").alias("copies"))
    out = rows.join(store(copies, "copies"), ["rank", *LINK], "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    return out.select(*(F.col("key")[c].alias(c) for c in key), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, source: str = "source", text: str = "text", key: list[str] | None = None, shards: int = 8, seed: int = SEED, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, once per copy taken, with ``mix_shard`` and ``mix_order`` (a shuffle inside the shard)."""
    key = key or ["doc_id"]
    rows, blocks = plan(docs, source, text, key, shards=shards, seed=seed, **options)
    dealt = taken(rows, blocks, shards, seed).select(*LINK, F.col("shard").alias("mix_shard"), F.xxhash64(F.lit(seed), F.col("shard"), *LINK, F.col("pass")).alias("mix_order"))
    own = [c for c in docs.columns if c not in ("mix_shard", "mix_order")]
    linked = _linked(docs, key, source, text, [F.struct(*(F.col(f"`{c}`") for c in own)).alias("row")])
    return linked.join(store(dealt, "dealt"), list(LINK)).select(*(F.col("row")[c].alias(c) for c in own), "mix_shard", "mix_order")
