"""Blocks of documents and exchanges of sorted keys between them, in numpy.

``chunk_table`` lays a table out as rows of about ``chunk_bytes`` of text (Arrow IPC, zstd), each with a
chunk number that later passes can rely on: it is written once to the shared folder.

``counted`` answers, for each key of each chunk, how often the key occurs in the whole table. Chunks send
their distinct keys with counts (so a key that a third of all rows share costs one entry per chunk),
dealt by ranges of the key space into buckets of bounded size; buckets reply to each chunk with those of its keys
that occur at least twice. Keys travel as sorted, differenced and compressed arrays.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import store

CHUNK_BYTES = 2 << 20
BUCKET_KEYS = 1 << 18
U = np.uint64
#: A column of counts in replies stops here.
MOST = np.uint32(0xFFFFFFFF)


# --- words -------------------------------------------------------------------------------------------

#: Odd multipliers of the polynomial hashes, from the fractional digits of the golden ratio and of the square root of 2.
GOLD, SILVER = 0x9E3779B97F4A7C15, 0x6A09E667F3BCC909
_IS_GAP = np.zeros(256, dtype=bool)
_IS_GAP[[32, 9, 10, 11, 12, 13]] = True


def sliding(a: np.ndarray, size: int, pick=np.minimum) -> np.ndarray:
    """``pick`` over every ``size`` neighbours, by doubling."""
    have = 1
    out = a
    while 2 * have <= size:
        out = pick(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = size - have
    return out if not rest else pick(out[:-rest], out[rest:]) if len(out) > rest else out[:0]


def member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among ``sorted_keys``."""
    if not len(sorted_keys):
        return np.zeros(len(x), dtype=bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n - 1) modulo 2 ** 64, by doubling; kept for the next call."""
    out = _POWERS.get(base)
    if out is None or len(out) < n:
        have, step, size = 1, base, max(1 << 16, 1 << (n - 1).bit_length())
        out = np.ones(size, dtype=U)
        with np.errstate(over="ignore"):
            while have < size:
                out[have : 2 * have] = out[:have] * U(step)
                have, step = 2 * have, step * step % (1 << 64)
        _POWERS[base] = out
    return out[:n]


def _sums(values: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int = GOLD) -> np.ndarray:
    """Polynomial hash of values[start:stop] for many spans, from one running sum."""
    n = len(values)
    total = np.zeros(n + 1, dtype=U)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(base, n), out=total[1:])
        return (total[stop] - total[start]) * powers(pow(base, -1, 1 << 64), n + 1)[start]


#: Bytes hashed at a time: the running sums stay in the cache, and a very long text needs no more memory per byte.
SEGMENT = 1 << 18


class Words:
    """Words of a list of texts as hashes: ``hashes``, and ``bounds`` of each text's words among them."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        # One gap after each text, so that no word crosses texts.
        raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        if lower:
            raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        edge = np.flatnonzero(np.diff(_IS_GAP[raw].view(np.int8), prepend=np.int8(1)))
        start, stop = edge[0::2], edge[1::2]
        self.start, self.stop = start, stop
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        self.bounds = np.concatenate([[0], np.searchsorted(start, ends)])
        cuts = np.unique(np.concatenate([np.searchsorted(start, np.arange(0, len(raw), SEGMENT)), [len(start)]]))
        parts = [np.zeros(0, dtype=U)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            first, last = start[i], stop[j - 1]
            with np.errstate(over="ignore"):
                parts.append(_sums(raw[first:last].astype(U) + U(1), start[i:j] - first, stop[i:j] - first) + (stop[i:j] - start[i:j]).astype(U) * U(SILVER))
        with np.errstate(over="ignore"):
            self.hashes = mixed(np.concatenate(parts))


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int, base: int = GOLD) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of ``size`` words that lies inside one text."""
    last = np.repeat(bounds[1:], np.diff(bounds))
    at = np.flatnonzero(np.arange(len(hashes)) + size <= last)
    return at, mixed(_sums(hashes, at, at + size, base)) if len(at) else np.zeros(0, dtype=U)


# --- packed keys -------------------------------------------------------------------------------------


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys: differences, their bytes transposed, compressed."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=keys.dtype.type(0))
    return len(keys).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(len(keys), -1).T).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, dtype=U) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=dtype)
    n, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    raw = pa.decompress(data[8:], n * width, codec="zstd", asbytes=True)
    steps = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T).view(dtype).ravel()
    return np.cumsum(steps, dtype=dtype)


# --- tables of chunks --------------------------------------------------------------------------------


def chunk_table(docs: DataFrame, key: str, text: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, body, n_bytes) in the shared folder; ``body`` holds key (bigint) and text (null: empty) of its rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, size = 0, [], 0
        part = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(whole)
            return pa.record_batch([pa.array([(part << 33) + made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([size], pa.int64())], names=["chunk", "body", "n_bytes"])

        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            at = 0
            # Rows that start inside the same chunk_bytes go together.
            cut = (size + np.cumsum(lengths) - lengths) // chunk_bytes
            for stop in [*(np.flatnonzero(np.diff(cut)) + 1), batch.num_rows]:
                held.append(batch.slice(at, stop - at))
                size += int(lengths[at:stop].sum())
                at = int(stop)
                if at < batch.num_rows or size >= chunk_bytes:
                    yield out()
                    made, held, size = made + 1, [], 0
        if held:
            yield out()
        held = []
        slim()

    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), body.alias("text"))
    # The bodies are compressed already.
    return store(rows.mapInArrow(write, "chunk long, body binary, n_bytes long"), "chunks", compression="uncompressed")


def read_body(body: bytes) -> tuple[pa.Array, list[bytes]]:
    """(keys, texts) of a chunk."""
    t = pa.ipc.open_stream(pa.py_buffer(body)).read_all().combine_chunks()
    return t.column("key").combine_chunks(), t.column("text").to_pylist()


def slim() -> None:
    """Hand unused memory back: workers live on between tasks, beside others on the same executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, so that only one chunk is open at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
            slim()
    _POWERS.clear()
    slim()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows that hold whole chunks reach Python a few at a time (set while the jobs inside run)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name, None)
    spark.conf.set(name, str(8 << 20))
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def total_bytes(chunks: DataFrame) -> int:
    return chunks.agg(F.sum("n_bytes")).first()[0] or 0


def buckets_for(expected_keys: int) -> int:
    """A power of two that leaves about BUCKET_KEYS keys to a bucket."""
    return 1 << max(6, int(np.ceil(np.log2(max(1, expected_keys) / BUCKET_KEYS))))


def parts_of(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys, by the top bits of the key."""
    top = keys >> U(64 - int(np.log2(buckets)))
    edges = np.concatenate([[0], np.flatnonzero(np.diff(top)) + 1, [len(keys)]]).tolist() if len(keys) else [0]
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        yield int(top[i]), i, j


def squeeze(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def few(data: bytes, n: int) -> np.ndarray:
    """Counts as ``deal`` packs them: nothing at all where each is one."""
    return np.ones(n, dtype=np.int64) if not data else np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), dtype=np.uint32).astype(np.int64)


def deal(chunk: int, keys: np.ndarray, buckets: int, counts: np.ndarray) -> list[tuple]:
    """Rows (bucket, chunk, keys, counts) of sorted distinct keys."""
    return [(b, chunk, pack(keys[i:j]), b"" if counts[i:j].max() == 1 else squeeze(counts[i:j].astype(np.uint32))) for b, i, j in parts_of(keys, buckets)]


SENT = "bucket int, chunk long, keys binary, counts binary"
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


REPLY = "chunk long, keys binary, counts binary"
REPLY_ARROW = pa.schema([("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def answer(sent: pa.Table) -> pa.Table:
    """One bucket: which keys of each chunk occur at least twice in the whole table, and how often."""
    keys = [unpack(k) for k in sent.column("keys").to_pylist()]
    flat = np.concatenate(keys)
    n = np.concatenate([few(c, len(k)) for k, c in zip(keys, sent.column("counts").to_pylist(), strict=True)])
    order = np.argsort(flat, kind="stable")
    group = np.cumsum(np.concatenate([[True], np.diff(flat[order]) != 0])) - 1
    total = np.bincount(group, weights=n[order]).astype(np.int64)
    count = np.empty(len(flat), dtype=np.int64)
    count[order] = total[group]
    rows, at = [], 0
    for chunk, k in zip(sent.column("chunk").to_pylist(), keys, strict=True):
        c = count[at : at + len(k)]
        at += len(k)
        often = c > 1
        if often.any():
            rows.append((chunk, pack(k[often]), pa.compress(np.minimum(c[often], MOST).astype(np.uint32).tobytes(), codec="zstd", asbytes=True)))
    return pa.Table.from_batches([to_batch(rows, REPLY_ARROW)])


def exchanged(sent: DataFrame, answer: Callable[[pa.Table], pa.Table], reply: str) -> DataFrame:
    """Replies of all buckets, one row per chunk: (chunk, replies) with replies sorted by bucket."""

    def one(key: tuple, group: pa.Table) -> pa.Table:
        out = answer(group)
        slim()
        return out.append_column("bucket", pa.array([key[0].as_py()] * len(out), pa.int32()))

    replies = sent.groupBy("bucket").applyInArrow(one, reply + ", bucket int")
    fields = [c for c in replies.columns if c not in ("bucket", "chunk")]
    return replies.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", *fields))).alias("replies"))


def counted(sent: DataFrame) -> DataFrame:
    """For each chunk, which of its keys occur at least twice in the whole table, and how often."""
    return exchanged(sent, answer, REPLY)


def reply_counts(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), dtype=np.uint32)
