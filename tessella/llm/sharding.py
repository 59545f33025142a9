"""Sharding by jump consistent hash.

A stable key and the shard count alone decide the shard (law ``key``): no ring table, and one more
shard takes rows only into itself. The hash runs over blocks of keys in numpy; texts never enter Python.

Slots number the rows of a shard from 0 without gaps. A shard holds an unbounded share of the
table, so rows are numbered inside fixed sub-ranges of the key space and shifted by counts of the
sub-ranges before: no task gets a whole shard.

Defined results: rows with a null key share one shard, that of key -1; a null text has size 1
and crc32 0; repeated rows take neighbouring slots; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import carried, unpacked

#: Cells (shard, sub-range) in which rows are numbered; their counts are the only thing that is broadcast.
CELLS = 1 << 15


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; all keys take each jump together until none has one left."""
    key = keys.astype(np.uint64).copy()
    at = np.zeros(len(key), dtype=np.int64)
    todo = np.arange(len(key))
    jump = np.zeros(len(key), dtype=np.int64)
    while len(todo):
        at[todo] = jump[todo]
        with np.errstate(over="ignore"):
            key[todo] = key[todo] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (key[todo] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[todo] = ((at[todo] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        todo = todo[jump[todo] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a bigint key column (hash other keys to one first)."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return jump(F.coalesce(key, F.lit(-1).cast("long")))


def assign(rows: DataFrame, key: str, shards: int, order: list[str] | None = None, cells: int = CELLS) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (columns of these names are replaced, all others stay).

    ``order`` settles slots between rows of one key. The counting pass reads the key column only.
    """
    names, row = carried(rows, ("shard", "slot"))
    spread = max(16, cells // shards)
    # A third of all rows may share a key: its rows are numbered in sub-ranges by their other columns too.
    by = [F.col(f"`{c}`") for c in [key, *(c for c in (order or []) if c != key)]]
    sub = F.pmod(F.xxhash64(*by), F.lit(spread)).cast("int")
    shard = shard_of(F.col(f"`{key}`").cast("long"), shards)
    counts = rows.select(sub.alias("sub"), shard.alias("shard")).groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = rows.select(sub.alias("sub"), shard.alias("shard"), F.struct(*by).alias("turn"), row)
    numbered = placed.withColumn("rn", F.row_number().over(Window.partitionBy("shard", "sub").orderBy("turn")))
    # At most max(cells, 16 x shards) rows, both parameters: small enough to broadcast at any input size.
    out = numbered.join(F.broadcast(bases), ["shard", "sub"])
    return out.select(*unpacked(names), "shard", (F.col("base") + F.col("rn") - 1).cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """One folder per shard, each in several files so that no task writes a whole shard."""
    part = F.pmod(F.col("slot"), F.lit(files_per_shard)).cast("int")
    rows.withColumn("part", part).repartition("shard", "part").drop("part").write.partitionBy("shard").parquet(path)
