"""Reports over records: profiles, predictors, velocity, bundles, citations, bridges, phases, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import rules as U
from tessella.functions import text as X

#: Shares of a context bundle, characters of a token, tags that mean nothing for likeness.
SHARES = {"knowledge": 0.40, "episodes": 0.20, "skills": 0.15, "rules": 0.15, "meta": 0.10}
TOKEN_CHARS = 4
GENERIC_TAGS = ("reusable", "solution", "auto", "session-autosave", "context-recovery")
WEEKDAY, RECENT, DUE = 0.4, 0.35, 0.25


def best(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` of each group, with ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def assess(queries: DataFrame, competencies: DataFrame, spots: DataFrame) -> DataFrame:
    """(qid, level, confidence, spots, note): mean level and confidence of a query's known concepts (qid, concept), and how many
    active blind spots (domain, id) they touch."""
    known = queries.join(competencies.withColumnRenamed("domain", "concept"), "concept", "left").groupBy("qid").agg(F.avg("level").alias("level"), F.avg("confidence").alias("confidence"))
    blind = queries.join(spots.withColumnRenamed("domain", "concept"), "concept").groupBy("qid").agg(F.count_distinct("id").alias("spots"))
    out = known.join(blind, "qid", "left").withColumn("spots", F.coalesce("spots", F.lit(0)))
    word = F.when(F.col("level").isNull(), "Unknown").when(F.col("level") > 0.8, "Strong").when(F.col("level") > 0.5, "Moderate").otherwise("Weak")
    r3 = lambda c: F.floor(c * 1000 + 0.5) / 1000
    return out.select("qid", r3(F.coalesce("level", F.lit(0.5))).alias("level"), r3(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), "spots", word.alias("note"))


def competency_fold(outcomes: DataFrame) -> DataFrame:
    """(domain, level, confidence, n, trend) after an ordered list of successes (domain, at, ok): the first sets .5 or .3, later
    ones add .02 or take .03; a step over .01 is a trend."""
    first = F.struct(F.when(F.get("o", F.lit(0))["ok"], 0.5).otherwise(0.3).alias("level"), F.lit("unknown").alias("trend"))

    def step(a: Column, e: Column) -> Column:
        level = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a["level"] + F.when(e["ok"], 0.02).otherwise(-0.03)))
        moved = level - a["level"]
        trend = F.when(moved > 0.01, "improving").when(moved < -0.01, "declining").when(level < 0.3, "stable_low").otherwise("stable")
        return F.struct(level.alias("level"), trend.alias("trend"))

    lists = outcomes.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("at", "seq", "ok"))).alias("o"))
    folded = lists.select("domain", F.size("o").alias("n"), F.aggregate(F.slice("o", F.lit(2), F.greatest(F.lit(0), F.size("o") - 1)), first, step).alias("s"))
    return folded.select("domain", "s.level", F.least(F.lit(1.0), 0.3 + 0.01 * (F.col("n") - 1)).alias("confidence"), "n", "s.trend")


def next_project(records: DataFrame, due: DataFrame, now: Column) -> DataFrame:
    """(project, score, rank): .4 by the weekday's share in 30 days, .35 by the last 3 days' share, .25 with a task due (project)."""
    r = records.where((F.col("status") == "active") & (F.col("project") != "general"))
    since = lambda d: F.col("created_at") > now - F.make_interval(days=F.lit(d))
    days = r.where(since(30) & (F.weekday("created_at") == F.weekday(now))).groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    late = r.where(since(3)).groupBy("project").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "project").limit(10)
    scaled = lambda d, w: d.crossJoin(d.agg(F.max("n").alias("most"))).select("project", (F.col("n") / F.col("most") * w).alias("s"))  # noqa: E731  one row
    scores = scaled(days, WEEKDAY).unionByName(scaled(late, RECENT)).groupBy("project").agg(F.sum("s").alias("s"))
    # Due tasks only add to projects that have a score.
    with_due = scores.join(due.select("project").distinct().withColumn("due", F.lit(DUE)), "project", "left")
    return with_due.select("project", F.least(F.lit(1.0), F.col("s") + F.coalesce("due", F.lit(0.0))).alias("score"))


def deadlines(tasks: DataFrame, now: Column) -> DataFrame:
    """(id, days, risk): open tasks with a deadline ahead; at risk within a day, or within two at less than one task done a day
    over the last 14."""
    done = tasks.agg((F.count_if((F.col("status") == "done") & (F.col("updated_at") > now - F.expr("INTERVAL 14 DAYS"))) / 14.0).alias("velocity"))  # one row
    ahead = tasks.where((F.col("status") != "done") & (F.col("deadline") >= now))
    days = (F.unix_timestamp("deadline") - F.unix_timestamp(now)) / 86400
    return ahead.crossJoin(done).select("id", days.alias("days"), ((days < 1) | ((days < 2) & (F.col("velocity") < 1))).alias("risk"))


def bundle(sections: DataFrame, tokens: int = 4000) -> DataFrame:
    """(qid, section, id, used): what fits each section's share of the token budget, best first. ``sections``: qid, section, id,
    score, size (characters). An item that doesn't fit ends its section."""
    share = F.lit(0)
    for name, s in SHARES.items():
        share = F.when(F.col("section") == name, int(tokens * s)).otherwise(share)
    w = Window.partitionBy("qid", "section").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cost = F.greatest(F.lit(1), F.floor(F.col("size") / TOKEN_CHARS))
    return sections.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= share).select("qid", "section", "id", "used")


def file_warnings(paths: DataFrame, records: DataFrame, limit: int = 5) -> DataFrame:
    """(path, id, rank): the newest records about a file: with its path, name or ``file:`` path as a tag, or that name it in
    their text. Paths are the stated query set."""
    from tessella.operators.search import containing

    norm = lambda c: F.lower(F.regexp_replace(c, r"\\", "/"))
    p = paths.select("path", norm(F.col("path")).alias("p"), F.substring_index(norm(F.col("path")), "/", -1).alias("base"))
    keys = p.select("path", F.explode(F.array_distinct(F.array(F.col("p"), F.concat(F.lit("file:"), F.col("p")), F.col("base")))).alias("key"))
    tagged = records.select("id", F.explode("tags").alias("t")).select("id", norm(F.col("t")).alias("key")).join(keys, "key").select("path", "id")
    names = p.select("path", F.explode(F.array_compact(F.array(F.col("p"), F.when(F.length("base") > 3, F.col("base"))))).alias("term")).distinct()
    # A path may stand anywhere in a text, a bare name only as a word.
    near = containing(records.select("id", norm(F.col("content")).alias("content")), names.select("term")).join(names, "term")
    held = near.join(records.select("id", norm(F.col("content")).alias("c")), "id")
    word = F.expr(r"c RLIKE concat('\\b', '\\Q', term, '\\E', '\\b')")
    told = held.where(F.contains("term", F.lit("/")) | word).select("path", "id")
    hits = tagged.unionByName(told).distinct().join(records.select("id", "created_at"), "id")
    return best(hits, ["path"], [F.desc("created_at"), "id"], limit).select("path", "id", "rank")


def triples_of(keys: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 12, names: int = 5, strongest: int = 100) -> DataFrame:
    """(qid, source, relation, target, score, rank) for structured keys (qid, subject, actions): edges from nodes whose name is the
    subject or begins with it; 2 for each action in the relation, 1 for each in the target; weight settles ties."""
    low = lambda c: F.lower(c)
    prefix = keys.select("qid", "actions", low(F.col("subject")).alias("s"))
    # A name begins with the subject: found by equality with the names' heads of that length.
    lengths = prefix.select(F.length("s").alias("n")).distinct()
    heads = nodes.select("node", low(F.col("name")).alias("name")).join(lengths, F.length("name") >= F.col("n")).select("node", "name", F.expr("substring(name, 1, n)").alias("s"))
    found = best(prefix.join(heads, "s").select("qid", "actions", "node", "name").distinct(), ["qid"], ["name", "node"], names).drop("rank")
    out = found.withColumnRenamed("node", "source").join(edges, "source")
    out = best(out, ["qid"], [F.desc("weight"), "source", "relation", "target"], strongest).drop("rank")
    target = out.join(nodes.select(F.col("node").alias("target"), low(F.col("name")).alias("t")), "target")
    hit = lambda c, w: F.aggregate("actions", F.lit(0.0), lambda a, x: a + F.when((x != "") & F.contains(c, F.lower(x)), w).otherwise(0.0))
    scored = target.withColumn("score", hit(low(F.col("relation")), 2.0) + hit(F.col("t"), 1.0))
    return best(scored, ["qid"], [F.desc("score"), F.desc("weight"), "source", "relation", "target"], limit).select("qid", "source", "relation", "target", "score", "rank")


def pattern_bridge(solutions: DataFrame, shared: int = 2, least: float = 0.3) -> DataFrame:
    """(project_a, project_b, tags) of solutions (id, project, content, tags) of different projects with two telling tags in
    common, else with keywords that are alike; each pair of projects and tags once."""
    from tessella.operators.bridges import bridged
    from tessella.operators.consolidate import hashed

    s = solutions.where(F.col("project") != "general").select("id", "project", F.filter(F.array_distinct("tags"), lambda t: ~t.isin(*GENERIC_TAGS)).alias("tags"), F.col("content"))
    # Tags first: pairs of projects meet on pairs of tags, so solutions are not paired.
    two = s.where(F.size("tags") >= shared).select("project", F.array_sort("tags").alias("tags")).distinct()
    x, y = two.select(F.col("project").alias("project_a"), F.col("tags").alias("ta")), two.select(F.col("project").alias("project_b"), F.col("tags").alias("tb"))
    by_tag = x.select("*", F.explode("ta").alias("t")).join(y.select("*", F.explode("tb").alias("t")), "t").where(F.col("project_a") < F.col("project_b")).select("project_a", "project_b", F.array_sort(F.array_intersect("ta", "tb")).alias("tags")).where(F.size("tags") >= shared).distinct()
    told = s.where(F.col("tags").isNotNull()).select("id", "project", "tags", hashed(U.keywords(F.col("content"))).alias("s"))
    by_word = bridged(told.where(F.size("s") > 0), shared, least).withColumn("tags", F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit("keyword-match"))))
    return by_tag.unionByName(by_word).distinct().select("project_a", "project_b", F.array_join("tags", ",").alias("tags"))


def phases(log: DataFrame) -> DataFrame:
    """(task, phase, entered, rejected) after an ordered log (task, level, seq, wanted) of wanted phases: a task begins in its level's
    first phase and may only enter the next one; anything else is rejected and changes nothing."""
    table = F.create_map(*(F.lit(x) if isinstance(x, int) else F.array(*(F.lit(p) for p in x)) for kv in U.TASK_PHASES.items() for x in kv))
    lists = log.groupBy("task", "level").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "wanted"))), lambda e: e["wanted"]).alias("w"))
    own = lists.withColumn("p", F.try_element_at(table, F.col("level")))
    step = lambda a, w: F.when(F.get(F.col("p"), a["at"] + 1) == w, F.struct((a["at"] + 1).alias("at"), a["no"].alias("no"))).otherwise(F.struct(a["at"].alias("at"), (a["no"] + 1).alias("no")))
    end = own.withColumn("s", F.aggregate("w", F.struct(F.lit(0).alias("at"), F.lit(0).alias("no")), step))
    return end.select("task", F.get("p", F.col("s.at")).alias("phase"), (F.col("s.at") + 1).alias("entered"), F.col("s.no").alias("rejected"))


def coverage(memories: DataFrame, concepts: DataFrame, named: DataFrame) -> DataFrame:
    """(qid, id, concept): what each memory (qid, id, content) covers of a query's concepts (qid, concept): by the names of its nodes
    (id, name); a memory that none of them covers, by its text."""
    low = concepts.select("qid", "concept", F.lower("concept").alias("name"))
    linked = memories.select("qid", "id").join(named.select("id", F.lower("name").alias("name")), "id").join(low, ["qid", "name"]).select("qid", "id", "concept").distinct()
    rest = memories.join(linked.select("qid", "id").distinct(), ["qid", "id"], "left_anti")
    told = rest.join(low, "qid").where(F.contains(F.lower("content"), F.col("name"))).select("qid", "id", "concept")
    return linked.unionByName(told)


def conflicts(covered: DataFrame, memories: DataFrame) -> DataFrame:
    """(qid, concept, sources, advice) of concepts that several chosen memories (id, type, confidence) cover."""
    rows = covered.join(memories.select("id", "type", "confidence"), "id").groupBy("qid", "concept")
    spread = rows.agg(F.count(F.lit(1)).alias("sources"), F.count_distinct("type").alias("types"), (F.max("confidence") - F.min("confidence")).alias("apart")).where(F.col("sources") >= 2)
    advice = F.when(F.col("types") > 1, "most specific").when(F.col("apart") > 0.3, "higher confidence").otherwise("merge")
    return spread.select("qid", "concept", "sources", advice.alias("advice"))


def keyword_scores(records: DataFrame, stops: list[str], per_record: int = 5) -> DataFrame:
    """(id, word, score, rank): words of three letters or more by .3 x length + .5 x occurrences (three at most)."""
    w = F.filter(F.regexp_extract_all(F.lower("content"), F.lit("[a-zЀ-ӿ]{3,}"), F.lit(0)), lambda x: ~x.isin(*stops))
    each = records.select("id", F.explode(w).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    scored = each.withColumn("score", F.length("word") * 0.3 + F.least("n", F.lit(3)) * 0.5)
    return best(scored, ["id"], [F.desc("score"), "word"], per_record).select("id", "word", "score", "rank")


#: Words that say nearly the same.
REPHRASED = {"implement": "build", "create": "make", "add": "introduce", "fix": "resolve", "update": "modify", "delete": "remove", "configuration": "setup", "integration": "connecting", "error": "problem", "bug": "issue", "feature": "capability", "deploy": "launch", "migrate": "move", "refactor": "restructure",
             "реализовать": "сделать", "создать": "построить", "добавить": "внедрить", "исправить": "решить", "обновить": "изменить", "удалить": "убрать", "настройка": "конфигурация", "интеграция": "подключение", "ошибка": "проблема", "баг": "дефект"}


def paraphrase(content: Column, keywords: Column) -> Column:
    """A test question without a text's own words: its first sentence of over 20 characters, rephrased and without the first three
    keywords; a plain question if little is left, the keywords if there is no such sentence."""
    trim = lambda c: F.btrim(c, F.lit(" \t\r\n"))
    first = F.get(F.filter(F.transform(F.split(content, r"[.\n]", -1), lambda s: trim(s)), lambda s: F.length(s) > 20), F.lit(0))
    said = F.lower(F.substring(first, 1, 150))
    for old, new in REPHRASED.items():
        said = F.replace(said, F.lit(old), F.lit(new))
    bare = F.aggregate(F.slice(keywords, 1, 3), said, lambda t, k: F.replace(t, F.lower(k), F.lit("")))
    bare = trim(F.regexp_replace(bare, r"\s+", " "))
    question = F.concat(F.lit("how to "), F.array_join(F.slice(keywords, 1, 2), " "))
    return F.when(first.isNull(), F.array_join(keywords, " ")).when(F.length(bare) < 15, question).otherwise(bare)


def decisions(rows: DataFrame) -> DataFrame:
    """(id, selected, total, context, summary): options with criteria (id, option, criterion, rating, selected) as one record: the
    context as JSON, and the sum of the chosen option's ratings."""
    by_criterion = rows.groupBy("id", "criterion").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("option", "rating")))).alias("ratings"))
    matrix = by_criterion.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("criterion", F.to_json("ratings").alias("r"))))).alias("m"))
    chosen = rows.where("selected").groupBy("id").agg(F.first("option").alias("selected"), F.sum("rating").alias("total"))
    context = F.to_json(F.struct(F.col("selected"), F.col("m").alias("criteria")))
    return chosen.join(matrix, "id").select("id", "selected", "total", context.alias("context"), F.concat(F.lit("Chose "), F.col("selected")).alias("summary"))


def style_change(records: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """(tag, before, lately, change) shares of tags in the last ``days`` against those before."""
    t = records.select((F.col("created_at") > now - F.make_interval(days=F.lit(days))).alias("new"), F.explode("tags").alias("tag"))
    n = t.groupBy("tag").agg(F.count_if(F.col("new")).alias("a"), F.count_if(~F.col("new")).alias("b"))
    total = n.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))  # one row
    share = lambda c, t: F.coalesce(F.try_divide(c, t), F.lit(0.0))
    both = n.crossJoin(total).select("tag", share(F.col("b"), F.col("tb")).alias("before"), share(F.col("a"), F.col("ta")).alias("lately"))
    return both.withColumn("change", F.when(F.col("lately") > F.col("before") * 1.2, "more").when(F.col("lately") < F.col("before") * 0.8, "less").otherwise("same"))


def view_texts(content: Column) -> Column:
    """(summary, keywords, compressed) of a record without a model: its first sentence, its longest words, its text without
    stop words; a model's views replace them where there is one."""
    first = F.regexp_extract(content, r"^[^.!?\n]*[.!?]?", 0)
    words = F.slice(F.array_sort(U.keywords(content), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), 1, 8)
    short = F.array_join(F.filter(X.words(content), lambda w: ~w.isin(*U.KEYWORD_STOPS)), " ")
    return F.struct(F.btrim(first).alias("summary"), F.array_join(words, ", ").alias("keywords"), short.alias("compressed"))
