"""Substring deduplication in the manner of relative Lempel-Ziv parsing.

Every block of the table is indexed as reference, and every document is parsed greedily against all blocks: left to
right it takes the longest factor that copies one place of one reference block. Factors of at least ``span`` words are
duplicate spans. Where a factor ends, the windows that reach over its boundary belong to no factor before; they
are looked up one by one and begin the next factor if they stand elsewhere, so no shared span is lost at a cut.

The index is distributed by key, not held per block (``chunks.exchanged``). It works in three steps.
Anchors (the smallest ``k``-gram hash of each window; equal windows have equal anchors) that occur once
rule out most windows. The windows left are looked up by 128 bits of their words; the index answers with the
place (block, word) of the first such window in the table, the reference. Last, the words themselves of the first and
last window of every factor are fetched from the reference block and compared: a factor counts only if both agree.

Defined results: null, empty and wordless texts have no words; repeated rows are duplicates of each other;
rows with a null key are judged like all others; an empty table gives an empty result. Windows of different words with
equal 128-bit keys at a factor's ends (never seen) would leave that factor in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import chunks as C
from tessella.llm.common import store, sweep

SPAN, K = 35, 8
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Windows:
    """Windows of a block's texts with their anchors."""

    def __init__(self, texts: list[bytes], span: int, k: int):
        self.words = C.Words(texts)
        w, b = self.words.hashes, self.words.bounds
        at, self.grams = C.windows(w, b, k)
        # A window begins where a k-gram begins; both lists leave the ends of texts out.
        last = np.repeat(b[1:], np.diff(b))
        self.at = np.flatnonzero(np.arange(len(w)) + span <= last)
        self.gram = np.searchsorted(at, self.at)
        self.wide = span - k + 1
        self.least = C.sliding(self.grams, self.wide)[self.gram] if len(self.at) else np.zeros(0, dtype=C.U)

    def chosen(self) -> np.ndarray:
        """Which k-grams are the anchor of a window that holds them (all of them where they tie)."""
        best = np.zeros(len(self.grams) + self.wide - 1, dtype=C.U)
        best[self.gram + self.wide - 1] = self.least
        return (C.sliding(best, self.wide, np.maximum) == self.grams) & (self.grams > 0) if len(self.at) else np.zeros(len(self.grams), dtype=bool)

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """First words of the windows whose anchor is among ``repeated``."""
        kept = np.where(self.chosen() & C.member(repeated, self.grams), self.grams, NONE)
        return self.at[C.sliding(kept, self.wide)[self.gram] == self.least] if len(self.at) else self.at

    def keys(self, at: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
        """Distinct 128-bit keys in order, their counts and first places, and which of them each window has."""
        one = C.mixed(C._sums(self.words.hashes, at, at + span, C.GOLD)) if len(at) else np.zeros(0, dtype=C.U)
        two = C.mixed(C._sums(self.words.hashes, at, at + span, C.SILVER)) if len(at) else one
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0)]) if len(a) else np.zeros(0, dtype=bool)
        which = np.empty(len(at), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        return a[new], b[new], np.bincount(which, minlength=int(new.sum())), at[order[new]], which


ASKED = "bucket int, chunk long, keys binary, more binary, counts binary, places binary"
ASKED_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])
FOUND = "chunk long, found binary, refs binary, places binary"
FOUND_ARROW = pa.schema([("chunk", pa.int64()), ("found", pa.binary()), ("refs", pa.binary()), ("places", pa.binary())])


def _open(data: bytes, dtype, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, np.dtype(dtype).itemsize * n, codec="zstd", asbytes=True), dtype=dtype)


def locate(sent: pa.Table) -> pa.Table:
    """One bucket of the index: which keys of each block occur at least twice, and where the first of them stands."""
    keys = [C.unpack(k) for k in sent.column("keys").to_pylist()]
    sizes = [len(k) for k in keys]
    chunks = sent.column("chunk").to_pylist()
    one, two = np.concatenate(keys), np.concatenate([np.frombuffer(m, dtype=C.U) for m in sent.column("more").to_pylist()])
    n = np.concatenate([C.few(c, k) for c, k in zip(sent.column("counts").to_pylist(), sizes, strict=True)])
    place = np.concatenate([_open(p, np.uint32, k) for p, k in zip(sent.column("places").to_pylist(), sizes, strict=True)])
    chunk = np.repeat(np.array(chunks, dtype=np.int64), sizes)
    order = np.lexsort((chunk, two, one))
    new = np.concatenate([[True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)])
    group = np.empty(len(one), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    often = np.bincount(group, weights=n)[group] > 1
    first = order[new][group]
    rows, at = [], 0
    for c, size in zip(chunks, sizes, strict=True):
        yes = np.flatnonzero(often[at : at + size]) + at
        if len(yes):
            bits = np.packbits(often[at : at + size]).tobytes()
            rows.append((c, size.to_bytes(8, "little") + bits, C.squeeze(chunk[first[yes]]), C.squeeze(place[first[yes]])))
        at += size
    return pa.Table.from_batches([C.to_batch(rows, FOUND_ARROW)])


def _references(replies: list, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, word) of the reference of each distinct key that the block asked for; block -1 for keys that stand nowhere else."""
    ref, place = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    got = {r["bucket"]: r for r in replies or []}
    for b, i, j in C.parts_of(keys, buckets):
        if r := got.get(b):
            yes = i + np.flatnonzero(np.unpackbits(np.frombuffer(r["found"][8:], dtype=np.uint8), count=j - i))
            ref[yes], place[yes] = _open(r["refs"], np.int64, len(yes)), _open(r["places"], np.uint32, len(yes))
    return ref, place


def factors(at: np.ndarray, ref: np.ndarray, place: np.ndarray, span: int) -> np.ndarray:
    """Greedy factors (first word, word after, reference block, reference word): from the first window that stands
    elsewhere, a factor goes on while the next window is the next one of the same reference block."""
    if not len(at):
        return np.zeros((0, 4), dtype=np.int64)
    new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(ref) != 0) | (np.diff(place) != 1)])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(at)]]) - 1
    return np.stack([at[head], at[tail] + span, ref[head], place[head]], axis=1)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans; those that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _repeated(replies) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=C.U), *(C.unpack(r["keys"]) for r in replies or [])])


def window_texts(texts: list[bytes], words: C.Words, at: list[int], span: int) -> list[bytes]:
    """The words of windows, joined by one space."""
    raw = b" ".join(texts)
    return [b" ".join(raw[words.start[i] : words.stop[i + span - 1]].split()) for i in at]


OUT = "key long, n_words long, spans array<struct<start:int,end:int>>, kept string"
OUT_ARROW = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.string())])
ASKERS = 1024


class Parse:
    """A block's factors, from what the index found."""

    def __init__(self, row: dict, texts: list[bytes], span: int, k: int, buckets: int):
        self.windows = w = Windows(texts, span, k)
        at = w.candidates(_repeated(row["anchors"]))
        one, _, _, _, which = w.keys(at, span)
        ref, place = (x[which] for x in _references(row["windows"], one, buckets))
        yes = ref >= 0
        self.factors = factors(at[yes], ref[yes], place[yes], span)
        first, end, block, word = self.factors.T
        #: The reference window itself needs no comparison; of all others the first and the last window do.
        self.copy = (block != row["chunk"]) | (word != first)
        # (block, word of the reference window, word of the window here), for both ends of each factor.
        self.ends = np.concatenate([np.stack([block, word, first], axis=1), np.stack([block, word + (end - first) - span, end - span], axis=1)])[np.tile(self.copy, 2)]


def parse(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, k: int = K, chunk_bytes: int = C.CHUNK_BYTES, askers: int = ASKERS) -> DataFrame:
    """(key, n_words, spans, kept): duplicate spans in words, and the other words joined by one space."""
    table = C.chunk_table(docs, key, text, chunk_bytes)
    volume = C.total_bytes(table)
    small, many = C.buckets_for(volume // 70), C.buckets_for(volume // 10)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in C.rows_of(batches):
            w = Windows(C.read_body(row["body"])[1], span, k)
            keys, counts = np.unique(w.grams[w.chosen()], return_counts=True)
            yield C.to_batch(C.deal(row["chunk"], keys, small, counts), C.SENT_ARROW)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in C.rows_of(batches):
            w = Windows(C.read_body(row["body"])[1], span, k)
            one, two, counts, places, _ = w.keys(w.candidates(_repeated(row["anchors"])), span)
            parts = C.parts_of(one, many)
            yield C.to_batch([(b, row["chunk"], C.pack(one[i:j]), two[i:j].tobytes(), b"" if counts[i:j].max() == 1 else C.squeeze(counts[i:j].astype(np.uint32)), C.squeeze(places[i:j].astype(np.uint32))) for b, i, j in parts], ASKED_ARROW)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in C.rows_of(batches):
            ends = Parse(row, C.read_body(row["body"])[1], span, k, many).ends
            blocks = np.unique(ends[:, 0])
            rows = [(int(b), row["chunk"], C.pack(np.unique(ends[ends[:, 0] == b, 1]).astype(C.U))) for b in blocks]
            yield C.to_batch(rows, pa.schema([("ref", pa.int64()), ("chunk", pa.int64()), ("places", pa.binary())]))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("ref", pa.int64()), ("texts", pa.binary())])
        for row in C.rows_of(batches):
            texts = C.read_body(row["body"])[1]
            words = C.Words(texts)
            for a in row["asks"]:
                got = window_texts(texts, words, C.unpack(a["places"]).astype(np.int64).tolist(), span)
                yield C.to_batch([(a["chunk"], row["chunk"], zstandard.compress(b"\n".join(got), 1))], schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in C.rows_of(batches):
            keys, texts = C.read_body(row["body"])
            found, bounds = np.zeros((0, 4), dtype=np.int64), None
            if row["windows"]:
                p = Parse(row, texts, span, k, many)
                found, bounds = p.factors[_agree(p, texts, row["told"], span)], p.windows.words.bounds
            out = []
            for n, t in enumerate(texts):
                parts, spans = t.split(), []
                total = len(parts)
                if len(found):
                    i, j = np.searchsorted(found[:, 0], bounds[n : n + 2])
                    spans = merged([(a, b) for a, b in (found[i:j, :2] - bounds[n]).tolist()])
                    for a, b in reversed(spans):
                        del parts[a:b]
                out.append((total, [{"start": a, "end": b} for a, b in spans], b" ".join(parts).decode()))
            rest = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.record_batch([keys, *(pa.array(list(c), f.type) for c, f in zip(rest, list(OUT_ARROW)[1:], strict=True))], schema=OUT_ARROW)

    with C.small_batches(docs.sparkSession):
        first = store(C.counted(table.mapInArrow(anchors, C.SENT)).withColumnRenamed("replies", "anchors"), "anchors")
        sweep(docs.sparkSession)
        asked = table.join(first, "chunk").select("chunk", "body", "anchors")
        second = store(C.exchanged(asked.mapInArrow(look_up, ASKED), locate, FOUND).withColumnRenamed("replies", "windows"), "windows")
        sweep(docs.sparkSession)
        parsed = table.join(first.join(second, "chunk"), "chunk").select("chunk", "body", "anchors", "windows")
        asks = parsed.mapInArrow(ask, "ref long, chunk long, places binary")
        # A passage that all blocks hold has one reference block: its askers come in groups of bounded size.
        groups = volume // (chunk_bytes * askers) + 1
        asks = asks.groupBy("ref", F.pmod(F.xxhash64("chunk"), F.lit(groups)).alias("part")).agg(F.collect_list(F.struct("chunk", "places")).alias("asks"))
        told = table.join(asks, F.col("chunk") == F.col("ref")).select("chunk", "body", "asks").mapInArrow(tell, "chunk long, ref long, texts binary")
        third = store(told.groupBy("chunk").agg(F.collect_list(F.struct("ref", "texts")).alias("told")), "told")

    sweep(docs.sparkSession)
    every = first.join(second, "chunk", "left").join(third, "chunk", "left")
    return table.join(every, "chunk", "left").select("chunk", "body", "anchors", "windows", "told").mapInArrow(cut, OUT)


def _agree(p: Parse, texts: list[bytes], told: list | None, span: int) -> np.ndarray:
    """Which factors have the words of their reference at both ends."""
    good = np.ones(len(p.ends), dtype=bool)
    here = window_texts(texts, p.windows.words, p.ends[:, 2].tolist(), span)
    answers = {t["ref"]: t["texts"] for t in told or []}
    for b in np.unique(p.ends[:, 0]):
        mine = np.flatnonzero(p.ends[:, 0] == b)
        places = np.unique(p.ends[mine, 1])
        there = zstandard.decompress(answers[int(b)]).split(b"\n")
        for m, i in zip(mine.tolist(), np.searchsorted(places, p.ends[mine, 1]).tolist(), strict=True):
            good[m] = there[i] == here[m]
    out = np.ones(len(p.factors), dtype=bool)
    half = len(good) // 2
    out[p.copy] = good[:half] & good[half:]
    return out
