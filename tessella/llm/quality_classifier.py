"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of all texts are computed block by block in numpy. Trees grow level by level from histograms of
binned statistics and are kept as flat arrays (complete binary trees), so scoring a block is a fixed number of
numpy gathers, without a branch per document.

The classifier is fitted on at most ``max_rows`` labelled rows, taken in the order of a hash of their id (a
documented bound: the model's needs do not grow with the table); statistics and scores cover every row.

Defined results: null and empty texts have all statistics 0 and get a score like any other; without labels
of both classes the score is their share (0.5 without any); labels other than 0 and 1 and null ids
are not learned from; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import chunks as C
from tessella.llm.common import store

# --- statistics --------------------------------------------------------------------------------------

#: Character classes, as bytes.
CLASSES = {
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "stop": b".!?",
    "comma": b",;:",
    "symbol": b"#*$%&|<>",
    "other_mark": b"\"'()-/=@[\\]^_`{}~+",
    "line": b"\n",
    "beyond_ascii": bytes(range(128, 256)),
}
NAMES = ("log_words", "word_bytes", "longest_word", "distinct_words", "commonest_word", "repeated_3", "repeated_8", "capital_words", "symbol_words", "one_byte_words", "words_a_line", "repeated_lines", *CLASSES)
_TABLES = [np.isin(np.arange(256), np.frombuffer(c, dtype=np.uint8)) for c in CLASSES.values()]
_SYMBOL, _UPPER = _TABLES[4], _TABLES[0]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _again(keys: np.ndarray) -> tuple[int, int]:
    """(distinct, count of the commonest)."""
    if not len(keys):
        return 0, 0
    counts = np.unique(keys, return_counts=True)[1]
    return len(counts), int(counts.max())


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of NAMES for each text."""
    out = np.zeros((len(texts), len(NAMES)), dtype=np.float32)
    if not texts:
        return out
    words = C.Words(texts)
    b = words.bounds
    n = np.diff(b)
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    begin = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    sums = lambda mask: np.add.reduceat(mask, begin, dtype=np.int64)
    start, stop = words.start, words.stop
    length = stop - start
    running = lambda a: np.concatenate([[0], np.cumsum(a)])
    per_text = lambda a: running(a)[b[1:]] - running(a)[b[:-1]]
    out[:, 0] = np.log1p(n)
    out[:, 1] = _share(per_text(length), n)
    symbols = running(_SYMBOL[raw].astype(np.int32))
    out[:, 7] = _share(per_text(_UPPER[raw[start]]), n)
    out[:, 8] = _share(per_text(symbols[stop] > symbols[start]), n)
    out[:, 9] = _share(per_text(length == 1), n)
    grams = [C.windows(words.hashes, b, k) for k in (3, 8)]
    for i, text in enumerate(texts):
        if not n[i]:
            continue
        out[i, 2] = length[b[i] : b[i + 1]].max()
        distinct, most = _again(words.hashes[b[i] : b[i + 1]])
        out[i, 3], out[i, 4] = distinct / n[i], most / n[i]
        for at, (first, keys) in zip((5, 6), grams, strict=True):
            lo, hi = np.searchsorted(first, b[i : i + 2])
            if hi > lo:
                out[i, at] = 1 - _again(keys[lo:hi])[0] / (hi - lo)
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[i, 10], out[i, 11] = n[i] / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines))
    for j, t in enumerate(_TABLES, 12):
        out[:, j] = _share(sums(t[raw].view(np.int8)), sizes)
    return out


STATS = "id long, stats array<float>"


def table_of_statistics(docs: DataFrame, key: str, text: str, rows: int = 512) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                stats = statistics(part.column(1).to_pylist())
                flat = pa.array(stats.ravel())
                offsets = pa.array(np.arange(0, stats.size + 1, len(NAMES), dtype=np.int32))
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["id", "stats"])

    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return store(docs.select(F.col(f"`{key}`").cast("long").alias("id"), body.alias("text")).mapInArrow(run, STATS), "statistics")


# --- trees -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Options:
    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.2
    ridge: float = 1.0
    least_weight: float = 5.0


@dataclass
class Model:
    """``edges`` bin the statistics; trees are rows of ``feature`` and ``cut`` (inner nodes, by level) and ``leaf``."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(x) else np.zeros(x.shape, dtype=np.uint8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, total = self.bins(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for t in range(len(self.leaf)):
            node = np.zeros(len(x), dtype=np.int64)
            while len(x) and node[0] < inner:  # all rows are at the same level
                node = 2 * node + 1 + (binned[rows, self.feature[t][node]] > self.cut[t][node])
            total += self.leaf[t][node - inner] if len(x) else 0
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, o: Options = Options()) -> Model:
    """Logistic loss, second order; every level of a tree from one histogram of all its nodes."""
    inner, leaves, width = 2**o.depth - 1, 2**o.depth, x.shape[1]
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    points = np.linspace(0, 1, o.bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], points)) if len(x) else np.zeros(0) for j in range(width)]
    feature, cut, leaf = (np.zeros((0, k), dtype=d) for k, d in ((inner, np.int64), (inner, np.int64), (leaves, np.float64)))
    model = Model(edges, feature, cut, leaf, start)
    if len(y) == 0 or y.min() == y.max():
        return model
    binned = model.bins(x).astype(np.int64)
    margin, rows = np.full(len(y), start), np.arange(len(y))
    trees = []
    for _ in range(o.trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), dtype=np.int64)
        f, c = np.zeros(inner, dtype=np.int64), np.full(inner, 255, dtype=np.int64)
        for level in range(o.depth):
            base, count = 2**level - 1, 2**level
            local = node - base
            best = np.zeros(count)
            for j in range(width):
                at = local * o.bins + binned[:, j]
                g = np.bincount(at, grad, count * o.bins).reshape(count, -1).cumsum(axis=1)
                h = np.bincount(at, hess, count * o.bins).reshape(count, -1).cumsum(axis=1)
                gr, hr = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + o.ridge) + gr**2 / (hr + o.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + o.ridge)
                gain[(h < o.least_weight) | (hr < o.least_weight)] = 0
                where = gain.argmax(axis=1)
                top = gain[np.arange(count), where]
                better = top > best + 1e-9
                best[better] = top[better]
                f[base : base + count][better], c[base : base + count][better] = j, where[better]
            node = 2 * node + 1 + (binned[rows, f[node]] > c[node])
        last = node - inner
        value = -o.rate * np.bincount(last, grad, leaves) / (np.bincount(last, hess, leaves) + o.ridge)
        margin += value[last]
        trees.append((f, c, value))
    return Model(edges, *(np.stack(part) for part in zip(*trees, strict=True)), start)


def train(stats: DataFrame, labels: DataFrame, key: str, label: str, learn: Column, max_rows: int = 20_000, options: Options = Options()) -> Model:
    """``learn`` tells which ids of ``labels`` may be learned from."""
    rows = labels.where(learn & F.col(f"`{label}`").isin(0, 1)).groupBy(F.col(f"`{key}`").cast("long").alias("id")).agg(F.avg(F.col(f"`{label}`")).alias("y"))
    sample = rows.where(F.col("id").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    got = stats.join(sample, "id").select("id", "stats", F.round("y").alias("y")).dropDuplicates(["id"]).orderBy("id").toArrow()  # at most max_rows rows
    x = got.column("stats").combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES))
    return fit(x.astype(np.float64), got.column("y").to_numpy().astype(np.float64), options)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(id, score) of every row."""
    shared = stats.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(NAMES)).astype(np.float64)
            yield pa.record_batch([batch.column(0), pa.array(shared.value.score(x))], names=["id", "score"])

    return stats.mapInArrow(run, "id long, score double")
