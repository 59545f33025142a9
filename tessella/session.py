"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "tessella", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Tables of texts, and sizes between which one that lies in fewer files than there are cores is dealt out to all of them.
TEXTS, SPREAD_FROM, SPREAD_TO = ("documents", "pages"), 8 << 20, 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; Parquet carries its own schema, so nothing is inferred from rows.

    A small table of texts in a few files, each perhaps one row group, would be read by a few tasks while the other
    cores wait. A large one has row groups for all.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXTS and len(df.inputFiles()) < cores:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        if SPREAD_FROM < size < SPREAD_TO:
            return df.repartition(cores)
    return df
