"""Building the graph from records: links, edges by tags, sessions, hierarchies, orphans, events, display edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators.consolidate import alike_sets
from tessella.operators.graph import co_occurrence, reinforce

#: Parts of categories, and what depends on what.
HIERARCHY = {
    "backend": ("php", "symfony", "go", "golang", "python", "fastapi", "django", "flask", "grpc", "protobuf"),
    "frontend": ("vue", "nuxt", "typescript", "javascript", "tailwind", "pinia", "eslint"),
    "database": ("postgresql", "postgres", "sqlite", "redis", "chromadb"),
    "devops": ("docker", "makefile", "nginx", "git"),
    "messaging": ("rabbitmq", "grpc"),
    "testing": ("phpunit", "phpstan"),
    "monitoring": ("prometheus", "grafana", "sentry"),
}
DEPENDENCIES = (
    ("symfony", "php"), ("phpstan", "php"), ("phpunit", "php"), ("nuxt", "vue"), ("pinia", "vue"), ("vue", "typescript"), ("vue", "javascript"), ("tailwind", "css"), ("fastapi", "python"), ("django", "python"),
    ("flask", "python"), ("sqlalchemy", "python"), ("pydantic", "python"), ("celery", "python"), ("bitrix24", "bitrix"), ("protobuf", "grpc"), ("eslint", "javascript"), ("chromadb", "python"),
)
ERROR_WORDS = ("error", "fix", "bug", "issue", "problem", "ошибк")
PLAIN_TAGS = ("reusable", "session-summary", "session-autosave", "context-recovery", "2026", "self-reflection")
#: Kinds of nodes that an event is about, and how many of them at most.
ENTITY_TYPES = ("technology", "project", "company", "person", "concept", "tool", "doc", "article", "repo", "pattern", "skill")
EVENT_ENTITIES = 12


def first_of(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("n", n).where(F.col("n") <= k).drop("n")


def atomic_links(observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of observed pairs (source, source_type, target, target_type, relation): both ends are upserted by
    lower-cased name and type, then the edge between them is added or reinforced. Names are node keys."""
    name = lambda c: F.lower(F.btrim(c))
    end = lambda c: observed.select(name(c).alias("name"), F.col(f"{c}_type").alias("type"))
    nodes = end("source").unionByName(end("target")).groupBy("name", "type").agg(F.count(F.lit(1)).alias("mention_count"))
    return nodes, reinforce(observed.select(name("source").alias("source"), name("target").alias("target"), "relation"))


def semantic_edges(records: DataFrame, links: DataFrame, least: float = 0.3, nodes: int = 3, pairs: int = 5) -> DataFrame:
    """(source, target, relation, weight): nodes of records of one project whose tags are alike, the first three nodes of each, five
    pairs of nodes per pair of records; the strongest pair of records gives the weight."""
    tagged = records.where((F.col("status") == "active") & (F.col("project") != "general") & (F.size("tags") > 0))
    alike = alike_sets(tagged.select("id", "project", F.array_distinct("tags").alias("s")), ["project"], least)
    head = first_of(links.select(F.col("record").alias("id"), "node"), ["id"], ["node"], nodes)
    x, y = head.select(F.col("id").alias("a"), F.col("node").alias("x")), head.select(F.col("id").alias("b"), F.col("node").alias("y"))
    met = alike.join(x, "a").join(y, "b").where(F.col("x") != F.col("y"))
    some = first_of(met, ["a", "b"], ["x", "y"], pairs)
    weight = F.floor(F.col("jaccard") * 2.0 * 100 + 0.5) / 100
    return some.groupBy(F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target")).agg(F.max(weight).alias("weight")).select("source", "target", F.lit("semantic_similarity").alias("relation"), "weight")


def session_edges(records: DataFrame, links: DataFrame, sizes: tuple[int, int] = (2, 50), most_nodes: int = 30, most_pairs: int = 20) -> DataFrame:
    """(source, target, relation, weight): nodes that occur in one session, of sessions with 2 to 50 records and 2 to 30 nodes,
    at most twice as many pairs as nodes and twenty."""
    active = records.where((F.col("status") == "active") & F.col("session_id").isNotNull())
    n = active.groupBy("session_id").agg(F.count(F.lit(1)).alias("records")).where(F.col("records").between(*sizes)).select("session_id")
    nodes = active.join(n, "session_id").join(links.withColumnRenamed("record", "id"), "id").select("session_id", "node").distinct()
    count = nodes.groupBy("session_id").agg(F.count(F.lit(1)).alias("nodes")).where(F.col("nodes").between(2, most_nodes))
    kept = nodes.join(count, "session_id")
    a, b = kept.select("session_id", "nodes", F.col("node").alias("source")), kept.select("session_id", F.col("node").alias("target"))
    pairs = a.join(b, "session_id").where(F.col("source") < F.col("target"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("source", "target"))
    return pairs.withColumn("n", place).where(F.col("n") <= F.least(F.col("nodes") * 2, F.lit(most_pairs))).select("source", "target").distinct().select("source", "target", F.lit("co_occurred").alias("relation"), F.lit(0.5).alias("weight"))


def solution_edges(records: DataFrame, links: DataFrame, nodes: int = 3, pairs: int = 5) -> DataFrame:
    """(source, target, relation, weight): nodes of a solution to nodes of the errors told of in its session."""
    active = records.where(F.col("status") == "active")
    low, told = F.lower("content"), F.lit(False)
    for w in ERROR_WORDS:
        told = told | F.contains(low, F.lit(w))
    solved = active.where(F.col("type") == "solution").select("session_id", F.col("id").alias("a"))
    errors = active.where(F.col("type").isin("lesson", "fact") & told).select("session_id", F.col("id").alias("b"))
    head = first_of(links.select(F.col("record").alias("id"), "node"), ["id"], ["node"], nodes)
    met = solved.join(errors, "session_id").join(head.select(F.col("id").alias("a"), F.col("node").alias("source")), "a").join(head.select(F.col("id").alias("b"), F.col("node").alias("target")), "b")
    some = first_of(met.where(F.col("source") != F.col("target")), ["a", "b"], ["source", "target"], pairs)
    return some.select("source", "target").distinct().select("source", "target", F.lit("solves").alias("relation"), F.lit(1.5).alias("weight"))


def hierarchy_edges(nodes: DataFrame) -> DataFrame:
    """(source, target, relation, weight) by name, for the active nodes (name) that are there: parts of categories, and
    dependencies where both ends are there."""
    spark = nodes.sparkSession
    names = nodes.select(F.col("name").alias("source")).distinct()
    parts = spark.createDataFrame([(c, k) for k, v in HIERARCHY.items() for c in v], "source string, target string")
    needs = spark.createDataFrame(list(DEPENDENCIES), "source string, target string")
    part_of = parts.join(names, "source", "left_semi").select("source", "target", F.lit("part_of").alias("relation"), F.lit(2.0).alias("weight"))
    depends = needs.join(names, "source", "left_semi").join(names.withColumnRenamed("source", "target"), "target", "left_semi")
    return part_of.unionByName(depends.select("source", "target", F.lit("depends_on").alias("relation"), F.lit(3.0).alias("weight")))


def orphan_links(records: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, name, role, strength) for active records without a link: names (name) that are one of their words, names of several
    words in their text, their project, their tags. The first role in this order counts."""
    orphans = records.where(F.col("status") == "active").join(links.select(F.col("record").alias("id")).distinct(), "id", "left_anti")
    names = nodes.select(F.lower("name").alias("name")).distinct()
    token = orphans.select("id", F.explode(F.array_distinct(X.tokens(F.col("content"), 2))).alias("name")).join(names, "name", "left_semi")
    # Names of several words become runs of words, so they are found by equality.
    spaced = names.where(F.col("name").rlike("[ _-]")).select("name", F.regexp_replace("name", "[_-]", " ").alias("run"))
    w = F.filter(F.split(F.regexp_replace(F.lower("content"), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    runs = orphans.select("id", w.alias("w")).select("id", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w"))), lambda i: i + n - 1 <= F.size("w")), lambda i: F.array_join(F.slice("w", i, n), " ")))))).alias("run"))
    several = runs.join(spaced, "run").select("id", "name")
    project = orphans.where(F.col("project") != "general").select("id", F.lower("project").alias("name"))
    tags = orphans.select("id", F.explode("tags").alias("t")).where(F.length("t") >= 3).select("id", F.translate(F.lower("t"), "- ", "__").alias("name"))
    role = lambda d, r, s, n: d.select("id", "name", F.lit(r).alias("role"), F.lit(s).alias("strength"), F.lit(n).alias("turn"))
    every = role(token, "mentions", 0.7, 0).unionByName(role(several, "mentions", 0.8, 1)).unionByName(role(project, "belongs_to", 1.0, 2)).unionByName(role(tags, "tagged", 0.8, 3))
    return first_of(every.distinct(), ["id", "name"], ["turn"], 1).drop("turn")


def base_links(chunks: DataFrame) -> DataFrame:
    """(id, target, role) of chunks (id, parent_id, prev_id, file_path, symbol, project, tags): parent, next, file, defined symbol,
    project, tags."""
    one = lambda target, role, cond: F.when(cond, F.struct(target.cast("string").alias("target"), F.lit(role).alias("role")))
    c = F.col
    simple = F.array_compact(
        F.array(
            one(F.concat(F.lit("k-"), c("parent_id").cast("string")), "parent", c("parent_id").isNotNull()),
            one(F.concat(F.lit("k-"), c("prev_id").cast("string")), "next", c("prev_id").isNotNull()),
            one(c("file_path"), "from_file", F.coalesce(c("file_path"), F.lit("")) != ""),
            one(F.lower("symbol"), "defines", F.coalesce(c("symbol"), F.lit("")) != ""),
            one(c("project"), "belongs_to", F.coalesce(c("project"), F.lit("general")) != "general"),
        )
    )
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.struct(F.lower(t).alias("target"), F.lit("tagged").alias("role")))
    return chunks.select("id", F.explode(F.concat(simple, tags)).alias("l")).select("id", "l.target", "l.role").distinct()


def backfilled(records: DataFrame, links: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new links of records that had none, co-occurrence edges of all links with weight min(.2 n, 3)). ``nodes``: node, name."""
    new = orphan_links(records, links, nodes).join(nodes.select("node", F.lower("name").alias("name")), "name").select(F.col("id").alias("record"), "node", "strength")
    every = links.select("record", "node").unionByName(new.select("record", "node")).distinct()
    pairs = co_occurrence(every, 1)
    return new, pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("mentioned_with").alias("relation"), F.least(F.col("n") * 0.2, F.lit(3.0)).alias("weight"))


def event_links(records: DataFrame, links: DataFrame, nodes: DataFrame, most: int = EVENT_ENTITIES) -> DataFrame:
    """(source, target, relation, weight): an event node per saved record that has entities, and an edge from each of its first
    entities (node, type) to it."""
    entities = nodes.where(F.col("type").isin(*ENTITY_TYPES)).select("node")
    about = first_of(links.join(entities, "node", "left_semi").select("record", "node").distinct(), ["record"], ["node"], most)
    saved = records.select(F.col("id").alias("record"))
    return about.join(saved, "record", "left_semi").select(F.col("node").alias("source"), F.concat(F.lit("save:"), F.col("record").cast("string")).alias("target"), F.lit("MENTIONED_IN").alias("relation"), F.lit(1.0).alias("weight"))


def display_edges(records: DataFrame, limit: int = 1600) -> DataFrame:
    """(a, b, type) between the records shown (the most recalled, then the newest): neighbours in that order of one
    session (2 to 8 records, 3 edges), of a tag (2 to 15, 4) and of a project (5); a pair once, in this order of kinds."""
    order = [F.desc("recall_count"), F.desc("created_at"), "id"]
    shown = records.where(F.col("status") == "active").orderBy(*order).limit(limit)

    def chain(rows: DataFrame, by: str, sizes: tuple[int, int], edges: int, kind: Column, turn: int) -> DataFrame:
        w = Window.partitionBy(by).orderBy(*order)
        n = F.count(F.lit(1)).over(Window.partitionBy(by))
        linked = rows.select(by, "id", F.lead("id").over(w).alias("next"), F.row_number().over(w).alias("place"), n.alias("n"))
        kept = linked.where(F.col("next").isNotNull() & F.col("n").between(*sizes) & (F.col("place") <= edges))
        return kept.select(F.least("id", "next").alias("a"), F.greatest("id", "next").alias("b"), kind.alias("type"), F.lit(turn).alias("turn"))

    everyone = 1 << 60
    tags = shown.select("id", "recall_count", "created_at", F.explode("tags").alias("tag")).where(~F.col("tag").isin(*PLAIN_TAGS))
    every = (
        chain(shown.where(F.col("session_id").isNotNull()), "session_id", (2, 8), 3, F.lit("co-session"), 0)
        .unionByName(chain(tags, "tag", (2, 15), 4, F.concat(F.lit("shared-tag:"), F.col("tag")), 1))
        .unionByName(chain(shown, "project", (2, everyone), 5, F.lit("same-project"), 2))
    )
    return first_of(every, ["a", "b"], ["turn", "type"], 1).select("a", "b", "type")


def competence_edges(actions: DataFrame, nodes: DataFrame, first: int = 5, weight: float = 0.3, step: float = 0.1) -> DataFrame:
    """(source, target, relation, weight): pairs of the first five known concepts of successful actions (id, concepts); repeats
    reinforce. ``nodes``: node, name."""
    named = actions.select("id", F.posexplode(F.slice("concepts", 1, first)).alias("place", "c")).select("id", F.lower("c").alias("name"))
    known = named.join(nodes.select("node", F.lower("name").alias("name")), "name").select("id", "node").distinct()
    a, b = known.select("id", F.col("node").alias("source")), known.select("id", F.col("node").alias("target"))
    pairs = a.join(b, "id").where(F.col("source") < F.col("target")).withColumn("relation", F.lit("mentioned_with"))
    return reinforce(pairs, weight, step).select("source", "target", "relation", "weight")
