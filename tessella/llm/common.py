"""What the operators of this package share: shared-folder tables and native word helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class and what is not.
WHITE_RE = "[\\x20\\x09-\\x0D]"
WORD_RE = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Only a local master, whose executors share the
    machine, gets one of its own where the setting is absent."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host of its file system: a bare one belongs to the cluster's default."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(place).toString()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}/{label}"


def store(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write to the shared folder and reread: cuts lineage and outlives any executor. The shuffles of the write go with it; one
    thread of the driver stores at a time."""
    spark = df.sparkSession
    path = new_path(spark, label)
    jvm = spark.sparkContext._jsc.sc()
    first = jvm.newShuffleId()
    df.write.options(**options).parquet(path)
    if (cleaner := jvm.cleaner()).isDefined():
        # Nothing reads these shuffles any more; left to the garbage collector they fill the executors' disks for long.
        for i in range(first, jvm.newShuffleId() + 1):
            cleaner.get().doCleanupShuffle(i, True)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffles of jobs that are done: it removes their files once the driver has forgotten them,
    which an idle driver may put off for long while executors' disks fill."""
    spark.sparkContext._jvm.System.gc()


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by ``store`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        if "/tessella-" in path.toString():
            path.getFileSystem(conf).delete(path, True)


def carried(docs: DataFrame, without: Iterable[str] = ()) -> tuple[list[str], Column]:
    """(names, one struct ``row``) of the columns that pass through an operator: names of theirs never meet its own."""
    names = [c for c in docs.columns if c not in set(without)]
    return names, F.struct(*(F.col(f"`{c}`") for c in names), *([] if names else [F.lit(0).alias("none")])).alias("row")


def unpacked(names: list[str]) -> list[Column]:
    return [F.col("row")[c].alias(c) for c in names]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` evaluated once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def split_words(text: Column, gap: str = WHITE_RE) -> Column:
    """Maximal runs outside ``gap`` (a character class); an empty array for null and for no word."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap + "+", -1), "")


def split_lower(text: Column, gap: str = WHITE_RE) -> Column:
    """As ``split_words``, A-Z to lower case and nothing else. Letters are looked at one by one only in words that are not
    ASCII, which are few."""
    one = lambda w: F.when(_is_ascii(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.when(_is_ascii(text), split_words(F.lower(text), gap)).otherwise(F.transform(split_words(text, gap), one))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text (null and empty alike)."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(7), t, F.lit(11)).alias("b"))


def grams(words: Column, k: int) -> Column:
    """Hashes of every ``k`` neighbours. Elements are named one by one: a slice would copy them."""
    at = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + j if j else i) for j in range(k))))


def sliding_min(values: Column, size: int) -> Column:
    """The smallest of every ``size`` neighbours, from the smallest of thirds of them."""

    def wider(a: Column, have: int) -> Column:
        if have == size:
            return a
        reach = min(3 * have, size)
        offsets = sorted({0, -(-(reach - have) // 2), reach - have})
        n = lambda x: F.size(x) - (reach - have)
        at = lambda x: F.when(n(x) > 0, F.sequence(F.lit(0), n(x) - 1)).otherwise(F.array().cast("array<int>"))
        pick = lambda x, i: F.least(*(F.get(x, i + o if o else i) for o in offsets))
        return let(a, lambda x: wider(F.transform(at(x), lambda i: pick(x, i)), reach))

    return wider(values, 1)
