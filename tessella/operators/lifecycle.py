"""Retention, decay, duplicates and consolidation: each returns a new table, never changes one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import model as M
from tessella.functions import text as X
from tessella.operators.search import whole_days


def exact_duplicates(records: DataFrame) -> DataFrame:
    """(id, keep): records of equal normalised text go to the smallest id. Grouped by digest: texts don't shuffle."""
    d = records.select("id", F.sha2(X.normalised(F.col("content")), 256).alias("digest"))
    first = d.groupBy("digest").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return d.join(first, "digest").select("id", "keep", "n")


def retention(records: DataFrame, as_of: Column) -> DataFrame:
    """What happens to each active or archived record by age and use."""
    age = whole_days(as_of, F.coalesce("last_recalled", "created_at"))
    unused = (F.col("recall_count") == 0) & (F.col("confidence") < 0.8)
    act = F.when((F.col("status") == "active") & (age > M.ARCHIVE_DAYS) & unused, "archive").when((F.col("status") == "archived") & (age > M.PURGE_DAYS), "purge").otherwise("keep")
    return records.withColumn("age", age).withColumn("action", act)


def intelligent_decay(records: DataFrame, as_of: Column, auto_tag: str = "tag0", immortal: tuple[str, ...] = ("decision", "convention")) -> DataFrame:
    """Retention score: half-life on the effective age, confidence, a discount for automatic records."""
    age = whole_days(as_of, F.col("created_at"))
    recall = whole_days(as_of, F.col("last_recalled")) + F.floor(age / (F.col("recall_count") + 1))
    effective = F.least(age, F.coalesce(recall, age))
    auto = F.array_contains("tags", auto_tag)
    score = F.pow(F.lit(2.0), -effective / M.HALF_LIFE) * (0.5 + 0.5 * F.col("confidence")) * F.when(auto, 0.8).otherwise(1.0)
    limit = F.when(auto, 0.15).otherwise(0.10)
    return records.withColumn("retention", M.rounded(score)).withColumn("archive", ~F.col("type").isin(*immortal) & (score < limit))


def confidence_decay(records: DataFrame, as_of: Column, factor: float = 0.95, floor: float = 0.05, idle: int = 30) -> DataFrame:
    stale = F.coalesce(whole_days(as_of, F.col("last_recalled")), F.lit(idle + 1)) > idle
    return records.withColumn("confidence", F.when(stale, F.greatest(F.lit(floor), F.col("confidence") * factor)).otherwise(F.col("confidence")))


def keep_longest(groups: DataFrame, records: DataFrame) -> DataFrame:
    """(seed, keep, dropped): of each group the longest text stays, the first on a tie."""
    g = groups.join(records.select("id", F.length("content").alias("n")), "id")
    return g.groupBy("seed").agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("keep"), (F.count(F.lit(1)) - 1).alias("dropped"))


def resolve_entities(names: DataFrame, canon: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pronouns, exact names, aliases, else missing."""
    norm = F.lower(F.btrim(F.regexp_replace("name", r"[ \t]+", " ")))
    n = names.withColumn("name_norm", norm)
    out = n.join(canon.select("name_norm", F.col("entity_id").alias("exact")), "name_norm", "left").join(aliases.select(F.col("alias_norm").alias("name_norm"), F.col("entity_id").alias("by_alias")), "name_norm", "left")
    how = F.when(norm.isin("he", "she", "it", "they", "this", "that"), "pronoun").when(F.col("exact").isNotNull(), "exact").when(F.col("by_alias").isNotNull(), "alias").otherwise("missing")
    return out.withColumn("how", how).withColumn("entity_id", F.when(F.col("how") != "pronoun", F.coalesce("exact", "by_alias"))).drop("exact", "by_alias")


#: Largest vocabulary that is sent to all tasks; a larger one is joined by Spark as it sees fit.
SENT_WORDS = 20_000


def canonical_tags(tags: DataFrame, vocabulary: DataFrame, least: float = 0.8) -> DataFrame:
    """Best word (word, alias) of a vocabulary for each distinct tag: its alias or itself, one that contains it or that it contains,
    or one close in spelling. ``alias`` may be null.

    Equal ones are found by an equality join; only the tags left are compared with every word. A vocabulary of up to
    SENT_WORDS rows is broadcast.
    """
    v = vocabulary.select("word", F.lower(F.coalesce("alias", "word")).alias("name")).unionByName(vocabulary.select("word", F.lower("word").alias("name"))).distinct()
    t = tags.select("tag").distinct().withColumn("name", F.lower("tag"))
    equal = t.join(v, "name").groupBy("tag").agg(F.min("word").alias("canonical"))
    rest = t.join(equal.select("tag"), "tag", "left_anti")
    words = vocabulary.select("word").distinct()
    near = F.broadcast(words) if words.count() <= SENT_WORDS else words
    w = F.lower("word")
    score = F.when(F.contains("name", w) | F.contains(w, F.col("name")), 1.5).otherwise(X.levenshtein_ratio(F.col("name"), w))
    best = F.max_by(F.struct("word", "score"), F.struct("score", -F.length("word"), "word"))
    found = rest.join(near, F.lit(True)).withColumn("score", score).groupBy("tag").agg(best.alias("b")).select("tag", F.when(F.col("b.score") >= least, F.col("b.word")).alias("canonical"))
    return equal.unionByName(found)


def pending(outbox: DataFrame, done: DataFrame) -> DataFrame:
    """Entries whose hash was not written yet: replay is idempotent."""
    hashed = outbox.withColumn("hash", F.sha1(F.concat_ws("\u0001", *outbox.columns)))
    return hashed.join(done, "hash", "left_anti").dropDuplicates(["hash"])
