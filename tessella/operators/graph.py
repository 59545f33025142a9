"""Graph operators as joins and grouped sums; iterative ones cut lineage with checkpoint()."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import model as M


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the folder that the session names. Only a local master, whose executors share the machine, gets one
    of its own where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessella-"))
    return df.checkpoint()


def in_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``place``, from 1, in an order of the whole table: sorted in ranges, numbered inside them, and shifted by the
    counts of the ranges before. No task gets all rows."""
    parts = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    # One row per range.
    before = counts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rn = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("rn", rn).join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("rn")).drop("part", "rn", "before")


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("source", "target")]
    flipped = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *rest)
    return edges.select("source", "target", *rest).unionByName(flipped)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).union(edges.select(F.col("target").alias("node"))).distinct()


def upsert_nodes(mentions: DataFrame) -> DataFrame:
    """(name, type, at) mentions to one node per canonical name and type."""
    return mentions.groupBy(F.lower(F.btrim("name")).alias("name_norm"), "type").agg(F.count(F.lit(1)).alias("mention_count"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def reinforce(observed: DataFrame, start: float = 1.0, step: float = 0.1, cap: float = 10.0) -> DataFrame:
    """Repeated edges gain weight; loops are dropped."""
    n = observed.where(F.col("source") != F.col("target")).groupBy("source", "target", "relation").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("weight", F.least(F.lit(cap), start + step * (F.col("n") - 1)))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, hop): nodes within ``depth`` undirected hops of each seed."""
    steps = both_ways(edges.select("source", "target")).distinct()
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"))
    front = seen
    for h in range(1, depth + 1):
        reached = front.join(steps, front.node == steps.source).select("seed", F.col("target").alias("node")).distinct()
        front = cut(reached.join(seen, ["seed", "node"], "left_anti").withColumn("hop", F.lit(h)))
        seen = seen.unionByName(front)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    keep = nodes.select("node").distinct()
    return edges.join(keep.withColumnRenamed("node", "source"), "source", "left_semi").join(keep.withColumnRenamed("node", "target"), "target", "left_semi")


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """Weighted and undirected; a node's mass without edges is lost and ranks are scaled to sum 1 at the end."""
    e = both_ways(edges.select("source", "target", "weight"))
    out = e.groupBy("source").agg(F.sum("weight").alias("total"))
    share = cut(e.join(out, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("share")).groupBy("source", "target").agg(F.sum("share").alias("share")))
    nodes = cut(nodes_of(edges))
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(1, n)))
    for i in range(rounds):
        sent = rank.join(share, rank.node == share.source).groupBy(F.col("target").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = nodes.join(sent, "node", "left").select("node", ((1 - damping) / max(1, n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 5 == 4:
            rank = cut(rank)
    total, most = F.sum("rank").alias("total"), F.max("rank").alias("most")
    return rank.crossJoin(F.broadcast(rank.agg(total, most))).select("node", (F.col("rank") / F.col("total")).alias("rank"), M.rounded(F.col("rank") / F.col("most"), 4).alias("importance"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node that can be reached; labels also jump to their label's label."""
    e = cut(both_ways(edges.select("source", "target")).where(F.col("source") != F.col("target")).distinct())
    label = nodes_of(edges).withColumn("component", F.col("node"))
    while True:
        near = e.join(label.withColumnRenamed("node", "target"), "target").groupBy(F.col("source").alias("node")).agg(F.min("component").alias("low"))
        low = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("low", "component")).alias("component"), F.col("component").alias("was"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
        nxt = cut(low.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "was"))
        label = nxt.select("node", "component")
        if not nxt.where(F.col("component") != F.col("was")).limit(1).count():
            return label


def shortest_paths(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """(seed, node, length, path) of all nodes within ``depth`` undirected hops; of equally short paths the first in
    order. A path is an array of nodes, the seed first."""
    steps = both_ways(edges.select("source", "target")).distinct()
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("length"), F.array("node").alias("path"))
    front = seen
    for h in range(1, depth + 1):
        longer = front.join(steps, front.node == steps.source).select("seed", F.col("target").alias("node"), F.array_append("path", F.col("target")).alias("path"))
        new = longer.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").groupBy("seed", "node").agg(F.min("path").alias("path"))
        front = cut(new.select("seed", "node", F.lit(h).alias("length"), "path"))
        seen = seen.unionByName(front)
    return seen


def communities(edges: DataFrame, least: int = 3) -> DataFrame:
    """(node, component, size, rank) of components with at least ``least`` nodes, the largest first."""
    c = components(edges)
    sizes = c.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    ranked = in_order(sizes, [F.desc("size"), F.col("component").asc()]).withColumnRenamed("place", "rank")
    return c.join(ranked, "component").select("node", "component", "size", "rank")


def activation_weight(w: Column) -> Column:
    return F.when(w > 1, F.least(w / 10.0, F.lit(1.0))).otherwise(w)


def spread(edges: DataFrame, seeds: DataFrame, threshold: float = 0.3, hops: tuple[float, ...] = (1.0, 0.7, 0.4, 0.2), depth: int = 3) -> DataFrame:
    """Spreading activation: (node, activation, depth); several paths to a node strengthen it.

    Bonus by number of paths: 2 1.2, 3 1.5, 4 1.8, 5 and more 2.0 (fixed values).
    """
    steps = both_ways(edges.select("source", "target", "weight")).withColumn("w", activation_weight(F.col("weight")))
    seen = seeds.select("node", F.lit(1.0).alias("activation"), F.lit(0).alias("depth"))
    front = seen
    n = F.col("paths")
    bonus = F.when(n >= 5, 2.0).when(n == 4, 1.8).when(n == 3, 1.5).when(n == 2, 1.2).otherwise(1.0)
    for d in range(1, depth + 1):
        sent = front.join(steps, front.node == steps.source).select(F.col("target").alias("node"), (F.col("activation") * F.col("w") * hops[d]).alias("a"))
        new = sent.join(seen, "node", "left_anti").groupBy("node").agg(F.max("a").alias("a"), F.count(F.lit(1)).alias("paths"))
        front = cut(new.select("node", F.least(F.lit(1.0), F.col("a") * bonus).alias("activation"), F.lit(d).alias("depth")).where(F.col("activation") >= threshold))
        seen = seen.unionByName(front)
    return seen


def spread_each(edges: DataFrame, seeds: DataFrame, threshold: float = 0.3, hops: tuple[float, ...] = (1.0, 0.7, 0.4, 0.2), depth: int = 2) -> DataFrame:
    """Spreading activation of many queries at once: (qid, node, activation) from seeds (qid, node)."""
    steps = both_ways(edges.select("source", "target", "weight")).withColumn("w", activation_weight(F.col("weight")))
    seen = cut(seeds.select("qid", "node", F.lit(1.0).alias("activation")).distinct())
    front = seen
    n = F.col("paths")
    bonus = F.when(n >= 5, 2.0).when(n == 4, 1.8).when(n == 3, 1.5).when(n == 2, 1.2).otherwise(1.0)
    for d in range(1, depth + 1):
        sent = front.join(steps, front.node == steps.source).select("qid", F.col("target").alias("node"), (F.col("activation") * F.col("w") * hops[d]).alias("a"))
        new = sent.join(seen, ["qid", "node"], "left_anti").groupBy("qid", "node").agg(F.max("a").alias("a"), F.count(F.lit(1)).alias("paths"))
        front = cut(new.select("qid", "node", F.least(F.lit(1.0), F.col("a") * bonus).alias("activation")).where(F.col("activation") >= threshold))
        seen = seen.unionByName(front)
    return seen


def co_occurrence(links: DataFrame, least: int = 2) -> DataFrame:
    """Ordered node pairs on the same record, with how many records share them."""
    a, b = links.select("record", F.col("node").alias("a")), links.select("record", F.col("node").alias("b"))
    return a.join(b, "record").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


#: Parts that the nodes of one neighbourhood are dealt into.
SALTS = 32


def _neighbourhoods(pairs: DataFrame, node: str, via: str) -> DataFrame:
    """(node, rep): nodes with the same set of neighbours ``via`` go to the smallest of them; ``pairs`` are distinct."""
    own = pairs.groupBy(node).agg(F.bit_xor(F.xxhash64(via)).alias("k1"), F.bit_xor(F.xxhash64(F.lit(1), via)).alias("k2"), F.count(F.lit(1)).alias("n"))
    return own.join(own.groupBy("k1", "k2", "n").agg(F.min(node).alias("rep")), ["k1", "k2", "n"]).select(node, "rep")


def transitive(edges: DataFrame, first: str, second: str, result: str, weight: float = 0.3) -> DataFrame:
    """source -first-> x -second-> target gives source -result-> target where no such edge exists.

    Sources with the same set of x share their targets and targets their sources, so only one node of each such class
    meets over x; the pairs of nodes follow from pairs of classes, each once, however many x lie between.
    """
    a = edges.where(F.col("relation") == first).select("source", F.col("target").alias("via")).distinct()
    b = edges.where(F.col("relation") == second).select(F.col("source").alias("via"), "target").distinct()
    ma, mb = cut(_neighbourhoods(a, "source", "via")), cut(_neighbourhoods(b, "target", "via"))
    x = a.join(ma.where(F.col("source") == F.col("rep")).select("source"), "source").select("via", F.col("source").alias("ca"))
    y = b.join(mb.where(F.col("target") == F.col("rep")).select("target"), "target").select("via", F.col("target").alias("cb"))
    met = x.join(y, "via").select("ca", "cb").distinct()
    known = edges.where(F.col("relation") == result).groupBy("source").agg(F.collect_set("target").alias("known"))
    left = met.join(ma.withColumnRenamed("rep", "ca"), "ca").join(known, "source", "left").withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int"))
    right = mb.withColumnRenamed("rep", "cb").withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    there = F.coalesce(F.array_contains("known", F.col("target")), F.lit(False))
    new = left.join(right, ["cb", "salt"]).where((F.col("source") != F.col("target")) & ~there)
    return new.select("source", "target", F.lit(result).alias("relation"), F.lit(weight).alias("weight"))


def merge_duplicates(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(winner map, edges with ends replaced): the node with most mentions, then the oldest, then the smallest id wins."""
    best = Window.partitionBy("name_norm", "type").orderBy(F.desc("mention_count"), "first_seen", "node")
    winners = nodes.select("node", F.first("node").over(best).alias("winner"))
    s, t = winners.select(F.col("node").alias("source"), F.col("winner").alias("s")), winners.select(F.col("node").alias("target"), F.col("winner").alias("t"))
    moved = edges.join(s, "source", "left").join(t, "target", "left").select(F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"), "relation", "weight")
    moved = moved.where(F.col("source") != F.col("target"))
    total = F.least(F.lit(10.0), F.max("weight") + 0.5 * (F.sum("weight") - F.max("weight")))
    return winners, moved.groupBy("source", "target", "relation").agg(total.alias("weight"))


def expand(edges: DataFrame, links: DataFrame, seeds: DataFrame, least: float = 0.3, hops: int = 1) -> DataFrame:
    """(record, score) of records on nodes within ``hops`` steps of the seeds' nodes, without the seeds: the best product of
    edge weights times link strength."""
    steps = both_ways(edges.select("source", "target", "weight")).withColumn("s", activation_weight(F.col("weight")))
    on = seeds.select(F.col("id").alias("record")).join(links, "record").select("node").distinct().withColumn("w", F.lit(1.0))
    for _ in range(hops):
        on = on.join(steps, on.node == steps.source).groupBy(F.col("target").alias("node")).agg(F.max(F.col("w") * F.col("s")).alias("w"))
    hits = on.join(links, "node").groupBy("record").agg(F.max(F.col("w") * F.col("strength")).alias("score")).where(F.col("score") >= least)
    return hits.join(seeds.select(F.col("id").alias("record")), "record", "left_anti")
