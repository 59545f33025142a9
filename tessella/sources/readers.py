"""Readers and writers: transcripts, event logs, HTML, inbox folders, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: A transcript line; ``content`` is a string or a list of parts, so it is read as JSON text.
TRANSCRIPT = T.StructType([T.StructField("type", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("message", T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))])


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(role, text, at) of user and assistant messages of JSON-lines transcripts; broken lines are left out."""
    raw = spark.read.schema(TRANSCRIPT).option("mode", "DROPMALFORMED").json(path)
    content = F.col("message.content")
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    text = F.when(content.startswith("["), joined).otherwise(content)
    return raw.select(F.col("message.role").alias("role"), text.alias("text"), F.to_timestamp("timestamp").alias("at")).where(F.col("role").isin("user", "assistant") & (F.length("text") > 0))


def append_log(entries: DataFrame, path: str) -> None:
    """Append-only event log, one JSON object per line."""
    entries.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as a stream: (path, kind, content); kind by extension."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin("md", "txt"), "text").when(ext.isin("py", "js", "ts", "java", "go", "rs"), "code").when(ext.isin("png", "jpg", "jpeg"), "image").when(ext == "pdf", "pdf").when(ext.isin("url", "html"), "url").otherwise("other")
    return files.select("path", kind.alias("kind"), "content")


def export_json(records: DataFrame, path: str, version: str = "1") -> None:
    """Active records, one JSON object per line, with a version tag."""
    records.where("status = 'active'").withColumn("export_version", F.lit(version)).write.json(path)


def markdown_lines(records: DataFrame) -> DataFrame:
    """(project, type, place, line): the lines of each project's document in their order, newest first in a section. A project
    of any size stays in rows."""
    line = F.concat(F.lit("- "), F.regexp_replace(F.substring("content", 1, 200), r"[ \t\n\r]+", " "))
    place = F.struct("type", (-F.unix_timestamp("created_at")).alias("t"), "id")
    return records.select("project", "type", place.alias("place"), line.alias("line"))


def write_markdown(records: DataFrame, path: str) -> None:
    """One folder of text per project: a heading per type, then its lines. Large projects become several files in order."""
    heads = records.select("project", "type").distinct().select("project", "type", F.struct("type", F.lit(-(1 << 62)).alias("t"), F.lit(-1).cast("long").alias("id")).alias("place"), F.concat(F.lit("## "), F.col("type")).alias("line"))
    every = markdown_lines(records).unionByName(heads)
    every.repartitionByRange("project", "place").sortWithinPartitions("project", "place").select("project", F.col("line").alias("value")).write.partitionBy("project").text(path)


def frontmatter(files: DataFrame, text: str = "value") -> DataFrame:
    """Notes with a head between two lines of three dashes: its ``key: value`` lines as a map, and the body."""
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n", 1)
    pairs = F.transform(F.filter(F.split(head, "\n"), lambda s: s.contains(":")), lambda s: F.struct(F.btrim(F.split_part(s, F.lit(":"), F.lit(1))).alias("k"), F.btrim(F.regexp_replace(s, r"^[^:]*:", "")).alias("v")))
    return files.withColumn("meta", F.map_from_entries(F.array_distinct(pairs))).withColumn("body", F.regexp_replace(text, r"(?s)^---\n.*?\n---\n", ""))


def wiki(records: DataFrame, k: int = 10) -> DataFrame:
    """(project, part, rank, line): each project's page as rows: top decisions, active solutions, conventions, latest changes."""
    line = F.concat(F.lit("- "), F.regexp_replace(F.substring("content", 1, 160), r"[ \t\n\r]+", " "))
    active = records.where("status = 'active'").withColumn("line", line)

    def part(rows: DataFrame, name: str, order: list) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("project").orderBy(*order, "id"))
        return rows.withColumn("rank", n).where(F.col("rank") <= k).select("project", F.lit(name).alias("part"), "rank", "id", "line")

    newest = [F.desc("created_at")]
    parts = [part(active.where("type = 'decision'"), "decisions", [F.desc("confidence")]), part(active.where("type = 'solution'"), "solutions", [F.desc("recall_count")]), part(active.where("type = 'convention'"), "conventions", newest), part(active, "changes", newest)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sqlite_table(spark: SparkSession, path: str, query: str, schema: str, rows: int, step: int = 100_000) -> DataFrame:
    """Rows of a query on a database file in a shared folder, read in ranges of ``rowid``. ``query`` has ``{low}`` and ``{high}``; ``rows``
    is the largest rowid."""
    import pandas as pd

    names = [f.name for f in T.StructType.fromDDL(schema)]

    def run(batches):
        import sqlite3

        for b in batches:
            for low in b.id:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
                    yield pd.DataFrame(c.execute(query.format(low=low, high=low + step)).fetchall(), columns=names)

    return spark.range(0, rows + 1, step).mapInPandas(run, schema)


def import_notes(notes: DataFrame, known: DataFrame, least: float = 0.8) -> DataFrame:
    """Notes (path, body) whose words are not mostly those of a known text (content) or of an earlier note: a note in a class of
    equal word sets, or close to a kept one, is left out."""
    from tessella.functions.text import words
    from tessella.operators.consolidate import absorbed, alike_sets
    from tessella.operators.graph import in_order

    old = known.select(F.lit("").alias("path"), F.col("content").alias("body"), F.lit(0).alias("new")).dropDuplicates(["body"])
    every = old.unionByName(notes.select("path", "body", F.lit(1).alias("new")))
    order = [F.col(c).asc() for c in ("new", "path", "body")]
    numbered = in_order(every, order).select("path", "body", "new", F.array_distinct(words(F.col("body"))).alias("s"), F.col("place").cast("long").alias("id")).where(F.size("s") > 0)
    pairs = alike_sets(numbered.select("id", "s", F.lit(0).alias("g")), ["g"], least).select("a", "b")
    kept = absorbed(pairs, numbered.select("id")).where(F.col("id") == F.col("seed")).select("id")
    return numbered.where("new = 1").join(kept, "id", "left_semi").select("path", "body")
