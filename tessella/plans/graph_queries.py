"""Graph queries on supplier-part edges and order-part links."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import model as M
from tessella.operators import graph as G
from tessella.plans.registry import query
from tessella.session import table

R = M.rounded_sql
BOTH = f"{M.EDGES_SQL}, both_ways AS (SELECT source, target, weight FROM edges UNION ALL SELECT target, source, weight FROM edges)"


def edges(spark, sf_dir):
    return M.edges(spark, sf_dir)


@query("SELECT lower(trim(event_type)) AS name_norm, 'event' AS type, count(*) AS mention_count, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1")
def g1_upsert_nodes(spark, sf_dir):
    m = table(spark, sf_dir, "events").select(F.concat(F.lit(" "), F.upper("event_type")).alias("name"), F.lit("event").alias("type"), F.col("ts").alias("at"))
    return G.upsert_nodes(m)


@query(f"WITH {M.EDGES_SQL} SELECT source, target, relation, weight, n FROM edges")
def g2_reinforced_edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    seen = li.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 40 + 1_000_000).alias("target"), M.pick(M.RELATIONS, F.col("l_partkey") % 3).alias("relation"))
    return G.reinforce(seen).select("source", "target", "relation", "weight", "n")


@query(f"WITH {M.LINKS_SQL} SELECT record, node, {R('strength')} AS strength FROM links")
def g4_record_links(spark, sf_dir):
    return M.links(spark, sf_dir).select("record", "node", M.rounded(F.col("strength")).alias("strength"))


#: A sparse chain-like graph for hop counts: customer k and its order's priority group.
SPARSE = "sp AS (SELECT DISTINCT n_nationkey AS source, n_regionkey + 100 AS target FROM nation UNION SELECT c_nationkey, c_custkey + 1000 FROM customer)"


def sparse(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("source"), (F.col("n_regionkey") + 100).cast("long").alias("target"))
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("source"), (F.col("c_custkey") + 1000).cast("long").alias("target"))
    return a.union(b).distinct()


BFS_SQL = f"""{SPARSE}, st AS (SELECT source, target FROM sp UNION SELECT target, source FROM sp),
 w(seed, node, hop) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation WHERE n_nationkey IN (0, 5) UNION SELECT w.seed, st.target, w.hop + 1 FROM w JOIN st ON st.source = w.node WHERE w.hop < 4),
 bfs AS (SELECT seed, node, min(hop) AS hop FROM w GROUP BY ALL)"""


def seeds(spark, sf_dir):
    return table(spark, sf_dir, "nation").where("n_nationkey IN (0, 5)").select(F.col("n_nationkey").cast("long").alias("node")).distinct()


@query(f"WITH RECURSIVE {BFS_SQL} SELECT seed, node, hop FROM bfs")
def g5_neighbourhood(spark, sf_dir):
    return G.bfs(sparse(spark, sf_dir), seeds(spark, sf_dir), 4)


@query(f"""WITH RECURSIVE {BFS_SQL}, p(seed, node, hop, path) AS (SELECT seed, node, hop, [node] FROM bfs WHERE hop = 0 UNION ALL
 SELECT b.seed, b.node, b.hop, min(list_append(p.path, b.node)) FROM p JOIN st ON st.source = p.node JOIN bfs b ON b.seed = p.seed AND b.node = st.target AND b.hop = p.hop + 1 GROUP BY b.seed, b.node, b.hop)
 SELECT seed, node, hop AS length, array_to_string(path, '>') AS path FROM p WHERE node > 1000""")
def g6_shortest_path(spark, sf_dir):
    found = G.shortest_paths(sparse(spark, sf_dir), seeds(spark, sf_dir), 4).where("node > 1000")
    return found.select("seed", "node", "length", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"WITH RECURSIVE {BFS_SQL} SELECT node FROM bfs GROUP BY node HAVING count(DISTINCT seed) = (SELECT count(DISTINCT seed) FROM bfs)")
def g7_common_reachable(spark, sf_dir):
    b = G.bfs(sparse(spark, sf_dir), seeds(spark, sf_dir), 4)
    n = b.agg(F.count_distinct("seed").alias("all"))
    return b.groupBy("node").agg(F.count_distinct("seed").alias("n")).join(F.broadcast(n), F.col("n") == F.col("all")).select("node")


@query(f"WITH {BOTH} SELECT target AS node, max(weight) AS weight FROM both_ways WHERE source IN (1, 2, 3) GROUP BY target")
def g8_by_concepts(spark, sf_dir):
    return G.both_ways(edges(spark, sf_dir).select("source", "target", "weight")).where(F.col("source").isin(1, 2, 3)).groupBy(F.col("target").alias("node")).agg(F.max("weight").alias("weight"))


@query(f"""WITH RECURSIVE {BOTH}, tot AS (SELECT source, sum(weight) AS t FROM both_ways GROUP BY source), sh AS (SELECT b.source, b.target, sum(b.weight / t) AS s FROM both_ways b JOIN tot USING (source) GROUP BY ALL),
 nodes AS (SELECT DISTINCT source AS node FROM both_ways), cnt AS (SELECT count(*) AS c FROM nodes),
 pr(i, node, r) AS (SELECT 0, node, 1.0::double / c FROM nodes, cnt UNION ALL SELECT i + 1, target, r FROM (SELECT pr.i, sh.target, 0.15 / any_value(c) + 0.85 * sum(pr.r * sh.s) AS r FROM pr JOIN sh ON sh.source = pr.node, cnt WHERE pr.i < 20 GROUP BY pr.i, sh.target)),
 f AS (SELECT node, r FROM pr WHERE i = 20) SELECT node, {R('r / (SELECT sum(r) FROM f)')} AS rank, {R('r / (SELECT max(r) FROM f)', 4)} AS importance FROM f""")
def g9_pagerank(spark, sf_dir):
    return G.pagerank(edges(spark, sf_dir)).select("node", M.rounded(F.col("rank")).alias("rank"), "importance")


@query(f"""WITH RECURSIVE {SPARSE}, st AS (SELECT source, target FROM sp UNION SELECT target, source FROM sp), r(node, c) AS (SELECT source, source FROM st UNION SELECT st.target, r.c FROM r JOIN st ON st.source = r.node)
 SELECT node, min(c) AS component FROM r GROUP BY node""")
def g10_components(spark, sf_dir):
    return G.components(sparse(spark, sf_dir))


@query(f"""WITH RECURSIVE {SPARSE}, st AS (SELECT source, target FROM sp UNION SELECT target, source FROM sp), r(node, c) AS (SELECT source, source FROM st UNION SELECT st.target, r.c FROM r JOIN st ON st.source = r.node),
 c AS (SELECT node, min(c) AS component FROM r GROUP BY node), s AS (SELECT component, count(*) AS size FROM c GROUP BY component HAVING count(*) >= 3) SELECT node, component, size, rank FROM c JOIN (SELECT *, row_number() OVER (ORDER BY size DESC, component) AS rank FROM s) USING (component)""")
def g10_communities(spark, sf_dir):
    return G.communities(sparse(spark, sf_dir))


CO = f"{M.LINKS_SQL}, co AS (SELECT a.node AS a, b.node AS b, count(*) AS n FROM links a JOIN links b ON a.record = b.record AND a.node < b.node GROUP BY ALL)"


@query(f"WITH {CO} SELECT a, b, n FROM co WHERE n >= 3")
def g11_co_occurrence(spark, sf_dir):
    return G.co_occurrence(M.links(spark, sf_dir), 3)


@query(f"WITH {CO} SELECT a, b, least(0.5 + 0.1 * n, 5.0)::double AS w1, least(0.3 + 0.1 * n, 3.0)::double AS w2, least(0.5 + 0.15 * n, 3.0)::double AS w3 FROM co WHERE n >= 2")
def g12_edge_weights(spark, sf_dir):
    n = F.col("n")
    w = lambda base, step, cap: F.least(base + step * n, F.lit(cap))
    return G.co_occurrence(M.links(spark, sf_dir), 2).select("a", "b", w(0.5, 0.1, 5.0).alias("w1"), w(0.3, 0.1, 3.0).alias("w2"), w(0.5, 0.15, 3.0).alias("w3"))


TREE = "t AS (SELECT source, target % 97 AS target, relation FROM edges UNION SELECT target % 97, source, 'depends_on' FROM edges WHERE relation = 'part_of')"


@query(f"""WITH {M.EDGES_SQL}, {TREE}, n AS (SELECT DISTINCT a.source, b.target FROM t a JOIN t b ON a.target = b.source WHERE a.relation = 'uses' AND b.relation = 'depends_on' AND a.source <> b.target)
 SELECT source, target, 'depends_on' AS relation, 0.3::double AS weight FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.source = n.source AND t.target = n.target AND relation = 'depends_on')""")
def g13_transitive_edges(spark, sf_dir):
    e = edges(spark, sf_dir)
    back = e.where("relation = 'part_of'").select((F.col("target") % 97).alias("source"), F.col("source").alias("target"), F.lit("depends_on").alias("relation"))
    t = e.select("source", (F.col("target") % 97).alias("target"), "relation").union(back).distinct()
    return G.transitive(t, "uses", "depends_on", "depends_on")


@query(f"WITH {M.EDGES_SQL}, nn AS (SELECT s_suppkey + 5 AS node FROM supplier) SELECT node FROM nn WHERE node NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)")
def j5_orphan_nodes(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 5).alias("node")).join(G.nodes_of(edges(spark, sf_dir)), "node", "left_anti")


@query(f"""WITH {M.EDGES_SQL}, nd AS (SELECT s_suppkey AS node, 'n' || (s_suppkey % 7) AS name_norm, 'x' AS type, s_suppkey * 3 % 5 AS mention_count FROM supplier),
 w AS (SELECT node, first_value(node) OVER (PARTITION BY name_norm, type ORDER BY mention_count DESC, node) AS winner FROM nd),
 m AS (SELECT coalesce(ws.winner, source) AS source, coalesce(wt.winner, target) AS target, relation, weight FROM edges LEFT JOIN w ws ON ws.node = source LEFT JOIN w wt ON wt.node = target)
 SELECT source, target, relation, {R('least(10.0, max(weight) + 0.5 * (sum(weight) - max(weight)))')} AS weight FROM m WHERE source <> target GROUP BY ALL""")
def g16_merge_duplicate_nodes(spark, sf_dir):
    k = F.col("s_suppkey")
    nodes = table(spark, sf_dir, "supplier").select(k.alias("node"), F.concat(F.lit("n"), (k % 7).cast("string")).alias("name_norm"), F.lit("x").alias("type"), (k * 3 % 5).alias("mention_count"), F.lit(0).alias("first_seen"))
    return G.merge_duplicates(nodes, edges(spark, sf_dir))[1].withColumn("weight", M.rounded(F.col("weight")))


@query(f"WITH {M.EDGES_SQL}, ns(x) AS (SELECT unnest([1, 2, 3, 4, 1000001, 1000002, 1000003])) SELECT source, target, relation, weight, n FROM edges WHERE source IN (SELECT x FROM ns) AND target IN (SELECT x FROM ns)")
def g24_subgraph(spark, sf_dir):
    ns = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 1000001, 1000002, 1000003)], "node long")
    return G.induced(edges(spark, sf_dir), ns).select("source", "target", "relation", "weight", "n")


@query(f"""WITH {BOTH}, deg AS (SELECT source AS node, count(*) AS d FROM both_ways GROUP BY source)
 SELECT (SELECT count(*) FROM deg) AS nodes, (SELECT count(*) FROM edges) AS edges, {R('(SELECT avg(d) FROM deg)')} AS avg_degree, {R('(SELECT count(*) FROM edges)::double / ((SELECT count(*) FROM deg) * ((SELECT count(*) FROM deg) - 1))')} AS density""")
def a22_graph_statistics(spark, sf_dir):
    e = edges(spark, sf_dir)
    deg = G.both_ways(e.select("source", "target")).groupBy("source").agg(F.count(F.lit(1)).alias("d"))
    both = deg.agg(F.count(F.lit(1)).alias("nodes"), F.avg("d").alias("avg")).crossJoin(e.agg(F.count(F.lit(1)).alias("edges")))  # one row each
    return both.select("nodes", "edges", M.rounded(F.col("avg")).alias("avg_degree"), M.rounded(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).alias("density"))


ACT = "CASE WHEN weight > 1 THEN least(weight / 10, 1.0) ELSE weight END"


@query(f"""WITH {BOTH}, s AS (SELECT unnest([1, 2]) AS node), b AS (SELECT source, target, {ACT} AS w FROM both_ways),
 h1 AS (SELECT target AS node, least(1.0, max(1.0 * w * 0.7) * CASE WHEN count(*) >= 5 THEN 2.0 WHEN count(*) = 4 THEN 1.8 WHEN count(*) = 3 THEN 1.5 WHEN count(*) = 2 THEN 1.2 ELSE 1.0 END) AS a FROM s JOIN b ON b.source = s.node WHERE target NOT IN (SELECT node FROM s) GROUP BY target),
 k1 AS (SELECT * FROM h1 WHERE a >= 0.05),
 h2 AS (SELECT target AS node, least(1.0, max(a * w * 0.4) * CASE WHEN count(*) >= 5 THEN 2.0 WHEN count(*) = 4 THEN 1.8 WHEN count(*) = 3 THEN 1.5 WHEN count(*) = 2 THEN 1.2 ELSE 1.0 END) AS a FROM k1 JOIN b ON b.source = k1.node WHERE target NOT IN (SELECT node FROM s UNION SELECT node FROM k1) GROUP BY target)
 SELECT node::bigint AS node, 1.0::double AS activation, 0 AS depth FROM s UNION ALL SELECT node, {R('a')}, 1 FROM k1 UNION ALL SELECT node, {R('a')}, 2 FROM h2 WHERE a >= 0.05""")
def r28_spreading_activation(spark, sf_dir):
    s = spark.createDataFrame([(1,), (2,)], "node long")
    out = G.spread(edges(spark, sf_dir), s, 0.05, depth=2)
    return out.select("node", M.rounded(F.col("activation")).alias("activation"), "depth")


@query(f"""WITH {M.LINKS_SQL}, pr AS (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey), k AS (SELECT DISTINCT node, n_name FROM links JOIN orders ON record = o_orderkey JOIN pr ON c_custkey = o_custkey),
 p AS (SELECT a.n_name AS a, b.n_name AS b, count(*) AS n FROM k a JOIN k b ON a.node = b.node AND a.n_name < b.n_name GROUP BY ALL) SELECT a, b, n, least(1 + 0.2 * n, 5.0)::double AS weight FROM p WHERE n >= 2""")
def a24_project_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = M.links(spark, sf_dir).join(o.select(F.col("o_orderkey").alias("record"), "n_name"), "record").select(F.col("node").alias("record"), F.col("n_name").alias("node")).distinct()
    return G.co_occurrence(k, 2).withColumn("weight", F.least(1 + 0.2 * F.col("n"), F.lit(5.0)))


@query(f"""WITH {M.LINKS_SQL} SELECT node AS concept, count(DISTINCT c_nationkey) AS projects, string_agg(DISTINCT n_name, ' ||| ' ORDER BY n_name) AS names
 FROM links JOIN orders ON record = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE strength > 0.9 GROUP BY node HAVING count(DISTINCT c_nationkey) >= 2""")
def a5_a23_cross_project_patterns(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    x = M.links(spark, sf_dir).where("strength > 0.9").join(o.select(F.col("o_orderkey").alias("record"), "n_name", "c_nationkey"), "record")
    names = F.array_join(F.sort_array(F.collect_set("n_name")), " ||| ")
    return x.groupBy(F.col("node").alias("concept")).agg(F.count_distinct("c_nationkey").alias("projects"), names.alias("names")).where("projects >= 2")
