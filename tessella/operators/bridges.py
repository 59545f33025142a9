"""Which pairs of classes of sets meet: the fact is wanted, not each pair of sets, so facts that hold are looked for no more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import graph as G

#: Sets compared at once in a round, sets of a tile of the last pass, rounds, and most classes whose facts are kept on the driver.
RUN, TILE, ROUNDS, CLASSES = 2048, 4096, 6, 1024
#: Rows of a block of counts, and most entries that one piece adds to it.
STRIPE, PIECE = 256, 1 << 20


def shared_counts(x: tuple, y: tuple) -> Iterator[tuple[int, int, np.ndarray]]:
    """(lo, hi, counts) of the elements that sets lo to hi of x share with each of y. Each side: sizes, and hashes one set after another.

    Elements that many sets of both sides have are counted by a product of 0/1 matrices, the others where they occur.
    """
    (nx, hx), (ny, hy) = x, y
    u, k = np.unique(np.concatenate([hx, hy]), return_inverse=True)
    kx, ky = k[: len(hx)], k[len(hx) :]
    rx, ry = np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)
    cx, cy = np.bincount(kx, minlength=len(u)), np.bincount(ky, minlength=len(u))
    dense = cx * cy > 0.005 * len(nx) * len(ny) + 1
    at = np.cumsum(dense) - 1
    wide = np.zeros((len(ny), int(dense.sum())), dtype=np.float32)
    wide[ry[dense[ky]], at[ky[dense[ky]]]] = 1
    owner, start = ry[np.argsort(ky, kind="stable")], np.cumsum(cy) - cy
    here = (~dense & (cy > 0))[kx]
    ex, ox = kx[here], rx[here]
    sum_x = np.concatenate([[0], np.cumsum(cy[ex])])
    for lo in range(0, len(nx), STRIPE):
        hi = min(lo + STRIPE, len(nx))
        tall = np.zeros((hi - lo, wide.shape[1]), dtype=np.float32)
        f, t = np.searchsorted(rx, [lo, hi])
        often = dense[kx[f:t]]
        tall[rx[f:t][often] - lo, at[kx[f:t][often]]] = 1
        shared = (tall @ wide.T).ravel()
        f, t = np.searchsorted(ox, [lo, hi])
        while f < t:
            e = min(t, max(f + 1, int(np.searchsorted(sum_x, sum_x[f] + PIECE, side="right")) - 1))
            c = cy[ex[f:e]]
            spot = np.arange(sum_x[e] - sum_x[f]) - np.repeat(sum_x[f:e] - sum_x[f], c) + np.repeat(start[ex[f:e]], c)
            shared += np.bincount(np.repeat(ox[f:e] - lo, c) * len(ny) + owner[spot], minlength=len(shared))
            f = e
        yield lo, hi, shared.reshape(hi - lo, len(ny))


def meeting(x: tuple, y: tuple, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of sets of x and y with a Jaccard index over ``least``."""
    found = [(np.zeros(0, dtype=np.int64),) * 2]
    for lo, hi, shared in shared_counts(x, y):
        both = shared.astype(np.float64)
        i, j = np.nonzero(both / (x[0][lo:hi, None] + y[0][None, :] - both) > least)
        found.append((i + lo, j))
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


def _sets(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy()


def _compared(rows: DataFrame, least: float, fact: np.ndarray, held: np.ndarray) -> DataFrame:
    """(fact) that sets of one run of ``rows`` (c, s) show, in the order in which the rows come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, RUN) for i in range(0, batch.num_rows, RUN)):
                c, side = part.column(0).to_numpy(), _sets(part.column(1))
                i, j = meeting(side, side, least)
                shown = np.unique(fact[c[i], c[j]])
                shown = shown[shown >= 0]
                yield pa.record_batch([pa.array(shown[~held[shown]])], names=["fact"])

    return rows.mapInArrow(run, "fact long").distinct()


def _tiles(rows: DataFrame, least: float) -> DataFrame:
    """(ca, cb) of sets of other projects in rows (c, p, s, t, lo, hi): the tiles lo and hi of one group are compared."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        table, lo, hi = table.combine_chunks(), key[0].as_py(), key[1].as_py()
        x, y = table.filter(pc.equal(table["t"], lo)).combine_chunks(), table.filter(pc.equal(table["t"], hi)).combine_chunks()
        pairs = np.zeros((0, 2), dtype=np.int64)
        if x.num_rows and y.num_rows:
            i, j = meeting(*(_sets(d["s"].combine_chunks()) for d in (x, y)), least)
            apart = x["p"].to_numpy()[i] != y["p"].to_numpy()[j]
            pairs = np.unique(np.stack([x["c"].to_numpy()[i][apart], y["c"].to_numpy()[j][apart]], axis=1), axis=0)
        return pa.table({"ca": pairs[:, 0], "cb": pairs[:, 1]})

    return rows.groupBy("lo", "hi").applyInArrow(one, "ca long, cb long")


def bridged(sets: DataFrame, shared: int, least: float) -> DataFrame:
    """(project_a, project_b, tags) of sets (id, project, tags, s: hashes, not empty) of different projects that have fewer than
    ``shared`` tags in common, these tags, and a Jaccard index over ``least``. Each once.

    Sets of a project with the same tags are a class. Pairs of classes stand for few results, so those that hold are found by
    comparing sets that are sorted by a smallest hash, in rounds; every other one is settled by comparing all its pairs of
    sets, tile by tile. With more than ``CLASSES`` classes all tiles meet.
    """
    spark = sets.sparkSession
    raw = G.cut(sets.select("id", "project", F.array_sort("tags").alias("tags"), "s"))
    same = G.cut(raw.groupBy("project", "tags").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("n")))
    few = same.limit(CLASSES + 1).collect()
    once = lambda d: d.select("*", F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(1), "s").alias("k2")).dropDuplicates(["c", "k1", "k2"])
    if len(few) > CLASSES:
        first = same.groupBy("project").agg(F.min("c").alias("p"))
        base = G.cut(once(raw.join(same, ["project", "tags"]).join(first, "project").select("c", "p", "s")))
        tiles = max(1, -(-base.count() // TILE))
        t = F.pmod("k2", F.lit(tiles)).cast("int")
        dealt = base.select("c", "p", "s", t.alias("t"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("u"))
        found = _tiles(dealt.select("c", "p", "s", "t", F.least("t", "u").alias("lo"), F.greatest("t", "u").alias("hi")), least).distinct()
        a, b = (same.select(F.col("c").alias(f"c{i}"), F.col("project").alias(f"p{i}"), F.col("tags").alias(f"t{i}")) for i in "ab")
        both = found.join(a, "ca").join(b, "cb").withColumn("tags", F.array_sort(F.array_intersect("ta", "tb"))).where(F.size("tags") < shared)
        return both.select(F.least("pa", "pb").alias("project_a"), F.greatest("pa", "pb").alias("project_b"), "tags").distinct()

    # Classes by number, in order of projects; a fact is a result that a pair of them would show.
    few.sort(key=lambda r: (r.project, r.c))
    tags, fact, known = [frozenset(r.tags) for r in few], np.full((len(few), len(few)), -1), {}
    for i, a in enumerate(few):
        for j in range(i):
            if few[j].project != a.project and len(both := tags[i] & tags[j]) < shared:
                fact[i, j] = fact[j, i] = known.setdefault((*sorted((a.project, few[j].project)), both), len(known))
    held = np.zeros(len(known), dtype=bool)
    numbered = spark.createDataFrame([(r.c, i) for i, r in enumerate(few)], "c long, k int")
    base = G.cut(once(raw.join(same.join(numbered, "c").select("project", "tags", "k"), ["project", "tags"]).select(F.col("k").alias("c"), "s")))
    for n in range(ROUNDS):
        if held.all():
            break
        low = lambda seed: F.array_min(F.transform("s", lambda h: F.xxhash64(h, F.lit(seed))))
        keyed = base.select("c", "s", low(2 * n).alias("m1"), low(2 * n + 1).alias("m2"))
        before = held.sum()
        held[[r.fact for r in _compared(keyed.repartitionByRange("m1", "m2").sortWithinPartitions("m1", "m2").select("c", "s"), least, fact, held).collect()]] = True
        if held.sum() - before < 0.02 * (~held).sum():
            break
    if not held.all():
        wanted = np.zeros(fact.shape, dtype=bool)
        wanted[fact >= 0] = ~held[fact[fact >= 0]]
        # Only classes that still matter are laid out in tiles.
        sizes = {r.c: r.n for r in base.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        n = np.array([sizes.get(i, 0) if wanted[i].any() else 0 for i in range(len(few))])
        begin = np.cumsum(n) - n
        lies = np.zeros((len(few), int(n.sum() // TILE) + 1), dtype=bool)
        for i in np.nonzero(n)[0]:
            lies[i, begin[i] // TILE : (begin[i] + n[i] - 1) // TILE + 1] = True
        reach = wanted.astype(np.float32) @ lies.astype(np.float32) > 0
        plan = [(int(i), int(n[i]), int(begin[i]), int(t), int(min(t, u)), int(max(t, u))) for i in np.nonzero(n)[0] for t in np.nonzero(lies[i])[0] for u in np.nonzero(reach[i])[0]]
        place = spark.createDataFrame(plan, "c int, n long, begin long, t long, lo long, hi long")
        dealt = base.join(place, "c").where(F.floor((F.col("begin") + F.pmod("k2", "n")) / TILE) == F.col("t"))
        firsts = {r.project: i for i, r in reversed(list(enumerate(few)))}
        owners = spark.createDataFrame([(i, firsts[r.project]) for i, r in enumerate(few)], "c int, p long")
        last = _tiles(dealt.join(owners, "c").select(F.col("c").cast("long").alias("c"), "p", "s", "t", "lo", "hi"), least).distinct().toPandas()
        shown = fact[last.ca.to_numpy(dtype=int), last.cb.to_numpy(dtype=int)]
        held[shown[shown >= 0]] = True
    rows = [(a, b, sorted(both)) for (a, b, both), i in known.items() if held[i]]
    return spark.createDataFrame(rows, "project_a string, project_b string, tags array<string>")
