"""N-gram Jaccard join with adaptive multi-match prefixes.

Tokens are the distinct word shingles of a document, ordered by document frequency, rare first. If two
documents share at least ``need`` of their tokens, then any prefixes of ``size - need + ell`` tokens share
at least ``ell``. Each document picks its ``ell`` by estimated cost: a longer prefix reads more postings,
but a candidate must then share more of them. A pair is compared in full only if its prefixes share as
many tokens as the smaller ``ell`` of the two and its two sizes ask for.

How it is spread out:

* Frequencies are counted over all shingles of all documents (``chunks.counted``). A document with too many
  unique shingles cannot reach the threshold with any other and leaves at once.
* Equal sets form a class with one representative, so copies never meet each other.
* Links are found in rounds. In a round, the documents of one token meet one leader, not each other, so a
  group of m near copies costs m comparisons. The first leader is the document with the fewest shingles of
  its own (the text that others were made from), later ones follow a hash. Tokens whose documents are in one
  component are done. Rounds end when few pairs from different components are left, or when they no longer
  help.
* What is left are documents of one token just under the threshold, such as copies with many edits each. They are
  compared by their differences from a common leader L (``_difference_pairs``): two sets share
  |L| - missing_x - missing_y + (differences that both have), so a link asks for so many common differences. Edits of
  different places have none, so most documents drop out alone, and no pair of them is ever made. Documents far from
  a token's leader get another one in the next round; the few that never meet are compared in all pairs.

Every pair that could connect two components is thus compared, and no link that matters for components is lost.

Defined results: texts without words have no shingles and link with nothing; shorter texts than a shingle
are one shingle; rows with a null id get their shingle count and no component; repeated rows are
equal sets; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import chunks as C
from tessella.llm.common import drop_stored, store, sweep

WORDS, PERCENT = 5, 80
#: Cost of comparing two sets, in postings read; and the longest step of a prefix.
COMPARE, MOST_MATCHES = 20, 8
#: Most rounds with leaders; and pairs per posting left that are worth no further round.
ROUNDS, FEW = 12, 2
#: Documents of a token that are simply compared in pairs; bands of weight per leader's size; rounds of differences.
PAIRED, BANDS, DIFFERENCES = 8, 25, 8


def token_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    words = C.Words(texts, lower=True)
    w, b = words.hashes, words.bounds
    at, hashes = C.windows(w, b, size)
    edges = np.searchsorted(at, b)
    sets = [np.unique(hashes[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
    for n in np.flatnonzero((np.diff(b) > 0) & (np.diff(b) < size)):
        with np.errstate(over="ignore"):
            whole = C._sums(w, b[n : n + 1], b[n + 1 : n + 2]) + C.U(b[n + 1] - b[n]) * C.U(C.SILVER)
        sets[n] = C.mixed(whole)
    return sets


def choose_prefix(sizes: np.ndarray, need: int) -> int:
    """``ell`` of the cheapest prefix; ``sizes``: frequencies in order. Postings read, and the most
    documents that can share ``ell`` of them, each compared once."""
    n = len(sizes)
    read = np.cumsum(np.where(sizes > 1, sizes, 0))
    ells = np.arange(1, min(MOST_MATCHES, need) + 1)
    read = read[n - need + ells - 1]
    return int(ells[np.argmin(read * (1 + COMPARE / ells))])


def _need(n: int, percent: int) -> int:
    return -(-n * percent // 100)


OUT = "id long, n long, a long, b long, ell int, own int, prefix array<long>, tokens array<long>"
ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ell", pa.int32()), ("own", pa.int32()), ("prefix", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])


#: Shingles of documents that leave a worker at a time.
HELD = 1 << 18


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(ARROW)
    return pa.record_batch([pa.array([x.as_py() for x in columns[0]], pa.int64()), *(pa.array(list(c), f.type) for c, f in zip(columns[1:], list(ARROW)[1:], strict=True))], schema=ARROW)


def _prefixes(docs: DataFrame, key: str, text: str, size: int, percent: int, chunk_bytes: int) -> DataFrame:
    """Every document with its set's size; those that may link also with prefix and tokens."""
    table = C.chunk_table(docs, key, text, chunk_bytes)
    volume = C.total_bytes(table)
    buckets = C.buckets_for(volume // 6)
    # Enough bits that a unique shingle hardly ever looks frequent; such an error costs time only.
    drop = C.U(max(0, 64 - (max(1, volume).bit_length() + 15)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in C.rows_of(batches):
            sets = token_sets(C.read_body(row["body"])[1], size)
            keys, counts = np.unique(np.concatenate([np.zeros(0, dtype=C.U), *sets]) >> drop, return_counts=True)
            yield C.to_batch(C.deal(row["chunk"], keys << drop, buckets, counts), C.SENT_ARROW)

    with C.small_batches(docs.sparkSession):
        replies = store(C.counted(table.mapInArrow(send, C.SENT)), "frequencies")

    sweep(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=C.U)
        for row in C.rows_of(batches):
            ids, texts = C.read_body(row["body"])
            sets = token_sets(texts, size)
            got = [C.unpack(r["keys"]) for r in row["replies"] or []]
            often = np.concatenate([none, *got])
            times = np.concatenate([np.zeros(0, dtype=np.uint32), *(C.reply_counts(r["counts"], len(g)) for r, g in zip(row["replies"] or [], got, strict=True))])
            lengths = np.array([len(s) for s in sets], dtype=np.int64)
            flat = np.concatenate([none, *sets])
            cutoff = np.concatenate([[0], np.cumsum(lengths)])
            freq = np.ones(len(flat), dtype=np.int64)
            if len(often):
                short = (flat >> drop) << drop
                i = np.minimum(np.searchsorted(often, short), len(often) - 1)
                hit = often[i] == short
                freq[hit] = times[i[hit]]
            unique = np.concatenate([[0], np.cumsum(freq == 1)])
            out, held = [], 0
            for n, tokens in enumerate(sets):
                size_n, i, j = len(tokens), cutoff[n], cutoff[n + 1]
                need = _need(size_n, percent)
                if not size_n or unique[j] - unique[i] > size_n - need:
                    out.append((ids[n], size_n, None, None, None, None, None, None))
                else:
                    order = np.lexsort((tokens, freq[i:j]))
                    sizes = freq[i:j][order]
                    ell = choose_prefix(sizes, need)
                    stop = size_n - need + ell
                    with np.errstate(over="ignore"):
                        spread = np.arange(1, 2 * size_n, 2, dtype=C.U)
                        a, b = (tokens * spread).sum(dtype=C.U), C.mixed(tokens ^ C.U(C.SILVER)).sum(dtype=C.U)
                    out.append((ids[n], size_n, a.view(np.int64).item(), b.view(np.int64).item(), ell, int(unique[j] - unique[i]), tokens[order[:stop][sizes[:stop] > 1]].view(np.int64), tokens.view(np.int64)))
                    held += size_n
                if held > HELD:
                    yield _batch(out)
                    out, held = [], 0
            yield _batch(out)

    joined = table.join(replies, "chunk", "left").select("chunk", "body", "replies")
    with C.small_batches(docs.sparkSession):
        out = store(joined.mapInArrow(cut, OUT), "prefixes")
    drop_stored(table)
    drop_stored(replies)
    sweep(docs.sparkSession)
    return out


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp): smallest node of each component; ``nodes`` (node, comp) are labels so far.

    Labels spread along links and jump to their label's label, so a chain of n links takes about log n
    rounds. Each round is a table in the shared folder.
    """
    ends = links.select("a", "b")
    ca, cb = nodes.select(F.col("node").alias("a"), F.col("comp").alias("ca")), nodes.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    edges = ends.join(ca, "a").join(cb, "b").where(F.col("ca") != F.col("cb")).select("ca", "cb")
    edges = store(edges.unionByName(edges.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"))).distinct(), "edges")
    label = store(edges.groupBy("ca").agg(F.least(F.col("ca"), F.min("cb")).alias("l")), "labels")
    while True:
        near = edges.join(label.select(F.col("ca").alias("cb"), "l"), "cb").groupBy("ca").agg(F.min("l").alias("m"))
        low = label.join(near, "ca").select("ca", F.least("l", "m").alias("l"), F.col("l").alias("was"))
        jump = low.join(label.select(F.col("ca").alias("l"), F.col("l").alias("j")), "l", "left")
        label_next = store(jump.select("ca", F.least("l", F.coalesce("j", "l")).alias("l"), "was"), "labels")
        changed = label_next.where(F.col("l") != F.col("was")).limit(1).count()
        label = label_next.select("ca", "l")
        if not changed:
            break
    return nodes.join(label.select(F.col("ca").alias("comp"), "l"), "comp", "left").select("node", F.coalesce("l", "comp").alias("comp"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    x = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    y = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    linked = pairs.join(x, "a").join(y, "b").select("a", "b", both.alias("both"), (F.size("ta") + F.size("tb")).alias("sum"))
    return linked.where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("a", "b")


def _alike(x: tuple[str, str], y: tuple[str, str], percent: int) -> Column:
    """Whether sets of (size, shingles of their own) can reach the threshold: what only one of them has is not shared."""
    (n, own), (m, other) = (tuple(F.col(c) for c in names) for names in (x, y))
    most = F.least(n - own, m - other)
    return most * (100 + percent) >= (n + m) * percent


def _enough(x: tuple[str, str], y: tuple[str, str], percent: int, shared: Column) -> Column:
    """Whether ``shared`` prefix tokens of sets of (size, ell) can be enough.

    Tokens behind the prefix that ends first are at most ``need - ell`` of its set; all others that both
    have are shared prefix tokens. Together they must make up what the threshold asks of these two sizes.
    """
    (n, ell), (m, more) = (tuple(F.col(c) for c in names) for names in (x, y))
    need = lambda c: F.ceil(c * percent / 100)
    rest = F.greatest(need(n) - ell, need(m) - more)
    return (shared >= F.least(ell, more)) & ((shared + rest) * (100 + percent) >= (n + m) * percent)


def _open(tokens: DataFrame, nodes: DataFrame) -> tuple[DataFrame, float]:
    """(tokens of more than one component, with comp; how many pairs of different components they hold)."""
    placed = store(tokens.join(nodes, "node"), "placed")
    m = F.col("m").cast("double")
    sizes = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("token").agg(F.count(F.lit(1)).alias("comps"), ((F.sum(m) * F.sum(m) - F.sum(m * m)) / 2).alias("pairs"))
    several = store(sizes.where(F.col("comps") > 1).select("token", "pairs"), "several")
    pairs = several.agg(F.sum("pairs")).first()[0] or 0.0
    left = store(placed.join(several.select("token"), "token", "left_semi"), "open")
    drop_stored(placed)
    drop_stored(several)
    return left, pairs


def _meet_leaders(placed: DataFrame, sets: DataFrame, r: int, percent: int) -> DataFrame:
    """Links of documents with the leaders of their tokens: each with the leader it shares most tokens with."""
    # The same document leads all tokens it can, so a member meets few leaders.
    first = F.col("own") if r == 0 else F.lit(0)
    rank = F.struct(first.alias("first"), F.xxhash64(F.lit(r), "node").alias("h"), F.col("node").alias("lead"), F.col("comp").alias("lead_comp"), F.col("n").alias("lead_n"), F.col("own").alias("lead_own"), F.col("ell").alias("lead_ell"))
    leaders = placed.groupBy("token").agg(F.min(rank).alias("r")).select("token", "r.lead", "r.lead_comp", "r.lead_n", "r.lead_own", "r.lead_ell")
    met = placed.join(leaders, "token").where((F.col("comp") != F.col("lead_comp")) & _alike(("n", "own"), ("lead_n", "lead_own"), percent))
    counts = met.groupBy("node", "lead").agg(F.count(F.lit(1)).alias("shared"), *(F.first(c).alias(c) for c in ("n", "ell", "lead_n", "lead_ell")))
    counts = counts.where(_enough(("n", "ell"), ("lead_n", "lead_ell"), percent, F.col("shared")))
    best = counts.groupBy("node").agg(F.max(F.struct("shared", "lead")).alias("m")).select(F.col("node").alias("a"), F.col("m.lead").alias("b"))
    return store(_verified(best, sets, percent), "links")


def _by_size(left: DataFrame, paired: int) -> tuple[DataFrame, DataFrame]:
    """Postings of tokens with at most ``paired`` documents, and those of all others."""
    many = store(left.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > paired).select("token"), "many")
    return left.join(many, "token", "left_anti"), left.join(many, "token", "left_semi")


def _pairs(few: DataFrame, total: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of documents of one token that can link; ``total`` (node, total): open tokens of each node."""
    # Besides those counted here, a pair shares no more tokens than either has elsewhere.
    rest = few.groupBy("node").agg(F.count(F.lit(1)).alias("c")).join(total, "node").select("node", (F.col("total") - F.col("c")).alias("rest"))
    few = few.join(rest, "node")
    x, y = (few.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "comp", "n", "own", "ell", "rest"))) for s in "xy")
    met = x.join(y, "token").where((F.col("comp_x") < F.col("comp_y")) & _alike(("n_x", "own_x"), ("n_y", "own_y"), percent))
    shared = met.groupBy("node_x", "node_y").agg(F.count(F.lit(1)).alias("shared"), *(F.first(c).alias(c) for c in ("n_x", "ell_x", "rest_x", "n_y", "ell_y", "rest_y")))
    may = shared.where(_enough(("n_x", "ell_x"), ("n_y", "ell_y"), percent, F.col("shared") + F.least("rest_x", "rest_y")))
    return may.select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))


def _stars(big: DataFrame, sets: DataFrame, r: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(token and leader of each posting, members of each leader).

    A member has its differences from its leader: shingles it misses and others it has more (``diff``), and its
    ``weight`` u = percent * size + (100 + percent) * missing, so that x and y link if and only if they have at least
    (u_x + u_y - k) / (100 + percent) differences in common, with k = (100 + percent) * |L|.
    """
    rank = F.min(F.struct(F.col("own") if r == 0 else F.lit(0), F.xxhash64(F.lit(r), "node").alias("h"), F.col("node").alias("lead")))
    leaders = big.groupBy("token").agg(rank.alias("r")).select("token", "r.lead")
    posted = store(big.join(leaders, "token").select("token", "node", "lead"), "posted")
    pairs = posted.select("lead", "node").distinct()
    t = sets.select("node", "n", F.col("tokens").alias("t"))
    both = pairs.join(t, "node").join(t.select(F.col("node").alias("lead"), F.col("n").alias("m"), F.col("t").alias("l")), "lead")
    both = both.select("lead", "node", "n", "m", F.array_except("l", "t").alias("missing"), F.array_except("t", "l").alias("more"))
    k, gone = 100 + percent, F.size("missing").cast("long")
    either = F.col("m") + F.size("more")
    alike, linked = (F.col("m") - gone) / either, (F.col("m") - gone) * 100 >= either * percent
    u = F.col("n") * percent + gone * k
    band = F.floor((u * 2 - F.col("m") * k) * BANDS / (F.col("m") * 200)).cast("int")
    return posted, store(both.select("lead", "node", "n", "m", alike.alias("alike"), linked.alias("linked"), u.alias("u"), band.alias("band"), F.concat("missing", "more").alias("diff")), "stars")


def _difference_pairs(stars: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one leader that can link, found by the differences they have in common.

    Prefix filter again: of two sets of differences that share at least s, the first size - s + 1 of each, rare ones first,
    have one in common. How many a member must share depends on the other's weight, so members of a leader are dealt into
    bands of weight, and a member shows each band the prefix that its lightest members ask for. Differences that nobody
    else has come first and match nobody.
    """
    k = F.lit(100 + percent)
    # A linked pair is within 1 - percent of each other, so one of them within half of the leader is enough.
    members = stars.where(F.col("alike") >= 0.5 - (1 - percent / 100)).join(nodes, "node")
    token = members.select("lead", "node", F.explode("diff").alias("d"))
    counts = token.groupBy("lead", "d").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") > 1)
    shared = token.join(counts, ["lead", "d"]).groupBy("lead", "node").agg(F.sort_array(F.collect_list(F.struct("f", "d"))).alias("s"))
    bands = members.groupBy("lead").agg(F.collect_set("band").alias("bands"))
    each = members.join(shared, ["lead", "node"]).join(bands, "lead")
    each = each.select("lead", "node", "comp", "band", F.size("diff").alias("n_diff"), "s", "u", "m", F.explode("bands").alias("other"))
    lightest = F.col("other") * F.col("m") * 200 / BANDS / 2 + F.col("m") * k / 2
    asked = F.greatest(F.lit(1), F.ceil((F.col("u") + lightest - F.col("m") * k) / k - 1e-6))
    # Of the first n_diff - asked + 1, all that nobody else has come before the shared ones.
    shown = F.col("n_diff") - asked + 1 - (F.col("n_diff") - F.size("s"))
    each = each.withColumn("shown", shown.cast("int")).where(F.col("shown") > 0)
    each = each.withColumn("low", F.least("band", "other")).withColumn("high", F.greatest("band", "other"))
    each = store(each.select("lead", "node", "comp", "band", "other", "low", "high", F.transform(F.slice("s", F.lit(1), F.col("shown")), lambda x: x["d"]).alias("d")), "shown")
    answers = each.select("lead", F.col("other").alias("band"), F.col("band").alias("other")).distinct()
    shown = each.join(answers, ["lead", "band", "other"], "left_semi").select("lead", "low", "high", "band", "node", "comp", F.explode("d").alias("d"))
    x, y = (shown.select("lead", "low", "high", "d", *(F.col(c).alias(f"{c}_{s}") for c in ("band", "node", "comp"))) for s in "xy")
    apart = (F.col("low") == F.col("high")) | (F.col("band_x") != F.col("band_y"))
    met = x.join(y, ["lead", "low", "high", "d"]).where((F.col("comp_x") < F.col("comp_y")) & apart)
    return met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def _last_links(left: DataFrame, sets: DataFrame, percent: int, paired: int = PAIRED, rounds: int = DIFFERENCES) -> DataFrame:
    """Links between the documents of the tokens that are left, as far as components need them.

    Members of a leader whose weights alone make them link need no common difference; both then link with the leader.
    """
    nodes = store(left.select("node", "comp").distinct(), "left")
    total = store(left.groupBy("node").agg(F.count(F.lit(1)).alias("total")), "total")
    pairs, links = [], []
    for r in range(rounds):
        few, big = _by_size(left, paired)
        pairs.append(_pairs(few, total, percent))
        if not big.limit(1).count():
            break
        posted, stars = _stars(big, sets, r, percent)
        links.append(stars.where(F.col("linked") & (F.col("node") != F.col("lead"))).select(F.col("node").alias("a"), F.col("lead").alias("b")))
        pairs.append(_difference_pairs(stars, nodes, percent))
        # What is within half of a token's leader has met all that it can link with.
        done = posted.join(stars.where(F.col("alike") >= 0.5).select("lead", "node"), ["lead", "node"], "left_semi").select("token", "node")
        left = store(big.join(done, ["token", "node"], "left_anti"), "far")
    else:
        pairs.append(_pairs(left, total, percent))
    every = store(reduce(DataFrame.unionByName, pairs).distinct(), "pairs")
    return reduce(DataFrame.unionByName, [_verified(every, sets, percent), *links]).distinct()


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT, chunk_bytes: int = C.CHUNK_BYTES, rounds: int = ROUNDS, paired: int = PAIRED) -> DataFrame:
    """(id, n, component) of every document: the size of its set and the smallest id that links reach."""
    all_docs = _prefixes(docs, key, text, size, percent, chunk_bytes)
    may = all_docs.where(F.col("a").isNotNull() & F.col("id").isNotNull())
    classes = store(may.groupBy("a", "b").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")), "classes")
    # One row per class: that of its smallest id (equal rows of that id are dropped).
    sets = store(may.join(classes.select("node"), F.col("id") == F.col("node"), "left_semi").withColumnRenamed("id", "node").dropDuplicates(["node"]).select("node", "n", "ell", "own", "prefix", "tokens"), "sets")
    ids = store(all_docs.select("id", "n", "a", "b"), "ids")
    drop_stored(all_docs)
    nodes = store(sets.select("node", F.col("node").alias("comp")), "nodes")
    left, pairs = _open(sets.select("node", "n", "ell", "own", F.explode("prefix").alias("token")), nodes)
    for r in range(rounds):
        if pairs <= FEW * left.count():
            break
        found = _meet_leaders(left, sets, r, percent)
        nodes = store(components(nodes, found), "nodes")
        before, past = pairs, left
        left, pairs = _open(past.drop("comp"), nodes)
        drop_stored(past)
        if r and pairs > 0.9 * before:
            break

    links = store(_last_links(left, sets, percent, paired), "links")
    nodes = store(components(nodes, links), "nodes")

    named = classes.join(nodes, "node").select("a", "b", "comp")
    out = ids.join(named, ["a", "b"], "left")
    return out.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id. Rows without an id stay; of rows of
    one id one stays. Columns of any name are carried along in a struct, so none meets a name of ours."""
    found = store(join(docs, key, text, **options), "components")
    losers = store(found.where(F.col("id") != F.col("component")).select("id").distinct(), "losers")
    k = F.col(f"`{key}`").cast("long")
    rows = docs.select(k.alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = rows.join(losers, "id", "left_anti")
    doubled = store(found.where(F.col("id") == F.col("component")).groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).select("id"), "doubled")
    if doubled.limit(1).count():
        once = kept.join(doubled, "id", "left_semi").dropDuplicates(["id"])
        kept = kept.join(doubled, "id", "left_anti").unionByName(once)
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
