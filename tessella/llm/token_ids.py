"""Token ids in binary files: frequency-ranked, byte-aligned, control bytes apart from data bytes.

Ids are replaced by their rank (most frequent first), so most take one byte. A file holds blocks; a block
holds the ranks of some documents as one stream of control bytes (two bits per id: its length in bytes,
less one) and one stream of data bytes. Control bytes are looked up in a table of 256 entries that gives the
offsets of four ids at once, so decoding is a few numpy gathers.

Layout of a file (little-endian)::

    "TSLTOK1\0"
    per block: u32 documents, u64 ids, u64 data bytes, u64 first position,
               i64[documents] keys, u8[documents] 1 where the key is null, u32[documents] ids of each,
               u8[(ids + 3) // 4] control bytes, u8[data bytes] data

The rank table is a file of its own: u32 ids by rank. It has an entry per id of the vocabulary, not per document.

A tokenizer file that normalises, lower-cases and splits by PATTERN never joins two white-space pieces to one token,
nor letters to the ASCII punctuation behind them (unless a letter turns into a letter and a mark, which is asked of
the tokenizer itself, character by character). Texts are then cut there and each distinct piece is encoded once
per worker. With any other file, or ``pieces=False``, whole texts are encoded.

Defined results: a null or empty text is the end id alone; documents with equal keys keep apart, in the order of
their text; null keys come first; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import chunks as C
from tessella.llm.common import drop_stored, new_path, qualified, store

MAGIC = b"TSLTOK1\0"
HEAD = struct.Struct("<IQQQ")
#: Distinct parts that a worker remembers, ids in a block, and bytes of text encoded at a time.
REMEMBER, BLOCK_IDS, BATCH_BYTES = 1 << 19, 1 << 20, 4 << 20
#: Punctuation that never joins the letters before it to one token, in tokenizers that split by PATTERN.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Fixed value: the words of the tokenizers whose white-space pieces are encoded alone.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# --- coding ------------------------------------------------------------------------------------------

_TWO = np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8) & 3
#: Bytes of the four ids of a control byte, where each begins, and all together.
LENGTHS = (_TWO + 1).astype(np.int64)
OFFSETS = np.cumsum(LENGTHS, axis=1) - LENGTHS
TOTALS = LENGTHS.sum(axis=1)
MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros((len(ranks) + 3) // 4 * 4, dtype=np.uint8)
    padded[: len(ranks)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8)[None, :] <= code[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse: table lookups give every id's place, one gather its bytes."""
    c = np.frombuffer(control, dtype=np.uint8)
    first = np.cumsum(TOTALS[c]) - TOTALS[c]
    # Padding of the last control byte points past the data, hence the spare bytes.
    at = (first[:, None] + OFFSETS[c]).ravel()[:n]
    raw = np.frombuffer(data + bytes(8), dtype=np.uint8)
    four = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        four |= raw[at + k].astype(np.uint32) << np.uint32(8 * k)
    return four & MASKS[_TWO[c].ravel()[:n]]


# --- tokenizing --------------------------------------------------------------------------------------


def width(tokenizer: str, end: int) -> str:
    """The narrowest type of ids in intermediate tables."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"


def cuts_at_white_space(path: str) -> bool:
    """Whether the tokenizer is known to encode each white-space piece of a text alone, letters and the
    ASCII punctuation behind them apart: NFC, white space and lower case first, then words by PATTERN."""
    with open(path) as f:
        setup = json.load(f)
    split, byte_level = (setup.get("pre_tokenizer") or {}).get("pretokenizers", [{}, {}])[:2]
    steps = [n.get("type") for n in (setup.get("normalizer") or {}).get("normalizers", [])]
    plain = not any(setup.get(k) for k in ("truncation", "padding", "post_processor"))
    added = all(" " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in setup.get("added_tokens", []))
    pattern = (split.get("type"), (split.get("pattern") or {}).get("Regex"), split.get("behavior"), split.get("invert"))
    byte_level = (byte_level.get("type"), byte_level.get("add_prefix_space"), byte_level.get("use_regex"))
    return plain and added and steps == ["NFC", "Replace", "Lowercase"] and pattern == ("Split", PATTERN, "Removed", True) and byte_level == ("ByteLevel", False, False)


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 .. for sizes[0] places, then those of the next one, and so on."""
    till = np.cumsum(sizes)
    return np.repeat(first - (till - sizes), sizes) + np.arange(till[-1] if len(till) else 0, dtype=first.dtype)


def _starts(values: pa.StringArray) -> np.ndarray:
    return np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)


class Memory:
    """Parts with their ids, found by hash and told apart by their texts.

    Everything is an array: hashes in order with the slot of each, and by slot the text, where its ids are, and the number of
    the last batch that had it. Parts that the last batches did not have are dropped when it is full.
    """

    def __init__(self, dtype: np.dtype, most: int, batches: int = 4):
        self.most, self.batches, self.now = most, batches, 0
        self.hashes, self.slots = np.zeros(0, dtype=C.U), np.zeros(0, dtype=np.int64)
        self.texts, self.ids = pa.array([], pa.string()), np.zeros(0, dtype=dtype)
        self.first, self.size, self.used = (np.zeros(0, dtype=np.int64) for _ in range(3))

    @staticmethod
    def hash(texts: pa.StringArray) -> np.ndarray:
        at = _starts(texts)
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
        with np.errstate(over="ignore"):
            return C.mixed(C._sums(raw.astype(C.U) + C.U(1), at[:-1] - at[0], at[1:] - at[0]) + np.diff(at).astype(C.U) * C.U(C.SILVER))

    def find(self, texts: pa.StringArray, hashes: np.ndarray) -> np.ndarray:
        """The slot of each text, -1 for unknown ones."""
        out = np.full(len(texts), -1, dtype=np.int64)
        if len(self.hashes) and len(texts):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            near = np.flatnonzero(self.hashes[at] == hashes)
            slots = self.slots[at[near]]
            same = pc.equal(self.texts.take(pa.array(slots)), texts.take(pa.array(near))).to_numpy(zero_copy_only=False)
            out[near[same]] = slots[same]
            self.used[slots[same]] = self.now
        return out

    def add(self, texts: pa.StringArray, hashes: np.ndarray, values: list[bytes]) -> np.ndarray:
        """Slots of new texts with their ids."""
        slots = np.arange(len(self.size), len(self.size) + len(texts))
        size = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // self.ids.itemsize
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size, self.used = np.concatenate([self.size, size]), np.concatenate([self.used, np.full(len(size), self.now)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(values), dtype=self.ids.dtype)])
        self.texts = pa.concat_arrays([self.texts, texts])
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.slots = np.insert(self.hashes, at, hashes[order]), np.insert(self.slots, at, slots[order])
        return slots

    def next_batch(self) -> None:
        self.now += 1
        if len(self.size) > self.most:
            keep = np.flatnonzero(self.used >= self.now - self.batches)
            self.ids = self.ids[_spread(self.first[keep], self.size[keep])]
            self.texts, self.size, self.used = self.texts.take(pa.array(keep)), self.size[keep], self.used[keep]
            self.first = np.cumsum(self.size) - self.size
            hashes = self.hash(self.texts)
            self.slots = np.argsort(hashes, kind="stable")
            self.hashes = hashes[self.slots]


class Encoder:
    """Ids of texts by a tokenizer file; parts seen before are not encoded again."""

    def __init__(self, path: str, end: int, dtype: str, pieces: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        self.pieces = pieces and cuts_at_white_space(path)
        self.end = np.array([end], dtype=dtype)
        self.known = Memory(self.dtype, REMEMBER)
        self.letters: dict[str, bool] = {}
        if self.pieces:
            # The id that ends a word.
            self.ends = np.zeros(1 << 8 * self.dtype.itemsize if self.dtype.itemsize < 4 else self.tokenizer.get_vocab_size(), dtype=bool)
            suffix = self.tokenizer.model.end_of_word_suffix
            self.ends[[i for w, i in self.tokenizer.get_vocab().items() if suffix and w.endswith(suffix)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in got]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """As ``_encode`` of words of letters, many to a text, parted where the ids end a word."""
        got = self.tokenizer.encode_batch_fast([" ".join(words[i : i + 500]) for i in range(0, len(words), 500)], add_special_tokens=False)
        ids = np.concatenate([self.end[:0], *(np.array(e.ids, dtype=self.dtype) for e in got)])
        ends = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
        if len(ends) != len(words) or (len(ends) and ends[-1] != ids.nbytes):
            return self._encode(words)
        raw, at = ids.tobytes(), [0, *ends.tolist()]
        return [raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]

    def _is_letter(self, c: str) -> bool:
        """Whether a character is letters still after normalising: it can then not join what follows it."""
        if c not in self.letters:
            found = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(c) + ".")
            self.letters[c] = c.isalpha() and len(found) == 2 and found[1][0] == "."
        return self.letters[c]

    def _slots(self, parts: pa.StringArray, words: np.ndarray) -> np.ndarray:
        """Where the ids of distinct parts are; ``words`` tells which are letters only."""
        hashes = Memory.hash(parts)
        slots = self.known.find(parts, hashes)
        for which, encode in ((words, self._encode_words), (~words, self._encode)):
            new = np.flatnonzero((slots < 0) & which)
            texts = parts.take(pa.array(new))
            slots[new] = self.known.add(texts, hashes[new], encode(texts.to_pylist()))
        return slots

    def _table(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, how many each has).

        Pieces of letters and a tail of punctuation share their parts; others are encoded as they are.
        """
        cores = pc.utf8_rtrim(pieces, characters=TAIL)
        clean = pc.ascii_is_alpha(cores).to_numpy(zero_copy_only=False).copy()
        foreign = np.flatnonzero(~pc.string_is_ascii(cores).to_numpy(zero_copy_only=False))
        if len(foreign):
            texts = cores.take(pa.array(foreign))
            odd = [c for c in set("".join(texts.to_pylist())) if not self._is_letter(c)]
            pattern = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in odd) + "]"
            clean[foreign] = ~pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) if odd else True
        start, size = _starts(pieces), np.diff(_starts(cores))
        length = np.diff(start)
        core = pc.if_else(pa.array(clean), pc.ascii_lower(cores), pieces).dictionary_encode()
        tail_size = np.where(clean, length - size, 0)
        raw = np.frombuffer(pieces.buffers()[2] or b"", dtype=np.uint8)[_spread(start[:-1] + size, tail_size)]
        edges = np.concatenate([[0], np.cumsum(tail_size)]).astype(np.int32)
        tail = pa.StringArray.from_buffers(len(pieces), pa.py_buffer(edges), pa.py_buffer(raw)).dictionary_encode()
        words = np.zeros(len(core.dictionary), dtype=bool)
        words[core.indices.to_numpy()] = clean
        cores = self._slots(core.dictionary, words)[core.indices.to_numpy()]
        tails = self._slots(tail.dictionary, np.zeros(len(tail.dictionary), dtype=bool))[tail.indices.to_numpy()]
        both = np.stack([cores, tails], axis=1)
        n = self.known.size[both]
        return self.known.ids[_spread(self.known.first[both.ravel()], n.ravel())], n.sum(axis=1)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each with the end id; how many each text has)."""
        if not self.pieces:
            got = [np.concatenate([np.frombuffer(x, dtype=self.dtype), self.end]) for x in self._encode(texts.to_pylist())]
            return np.concatenate([self.end[:0], *got]), np.array([len(x) for x in got], dtype=np.int64)
        split = pc.ascii_split_whitespace(texts)
        named = pc.list_flatten(split).dictionary_encode()
        self.known.next_batch()
        flat, sizes = self._table(named.dictionary)
        flat, first = np.concatenate([flat, self.end]), np.cumsum(sizes) - sizes
        # The end id stands behind the last piece of each text, as a piece of its own.
        words = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        which = np.insert(named.indices.to_numpy(), np.cumsum(words), len(sizes))
        first, sizes = np.append(first, len(flat) - 1).astype(np.int32), np.append(sizes, 1).astype(np.int32)
        n = sizes[which]
        till = np.cumsum(n, dtype=np.int64)
        return flat[_spread(first[which], n)], np.diff(till[np.cumsum(words + 1) - 1], prepend=0)


#: Kept by a worker from task to task.
_ENCODERS: dict[tuple, Encoder] = {}


def encoder_for(*setup) -> Encoder:
    if setup not in _ENCODERS:
        _ENCODERS[setup] = Encoder(*setup)
    return _ENCODERS[setup]


IDS = "key long, tie binary, ids binary, n_ids long"


def tokenize(docs: DataFrame, key: str, text: str, tokenizer: str, end: int, dtype: str, pieces: bool = True) -> DataFrame:
    """(key, tie, ids, n_ids) in the shared folder; ``tie`` orders documents of one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        encoder = encoder_for(tokenizer, end, dtype, pieces)
        for batch in batches:
            # Rows that start inside the same BATCH_BYTES go together.
            sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
            cut = (np.cumsum(sizes) - sizes) // BATCH_BYTES
            at = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
            for i, j in zip(at[:-1], at[1:], strict=True):
                part = batch.slice(i, j - i)
                ids, n = encoder.batch(part.column(2))
                edges = (np.concatenate([[0], np.cumsum(n)]) * ids.itemsize).astype(np.int32)
                body = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(ids)])
                yield pa.record_batch([part.column(0), part.column(1), body, pa.array(n, pa.int64())], names=["key", "tie", "ids", "n_ids"])

    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.unhex(F.md5(body.cast("binary"))).alias("tie"), body.alias("text"))
    return store(rows.mapInArrow(run, IDS), "ids", compression="zstd")


def rank_table(tokens: DataFrame, dtype: str) -> np.ndarray:
    """Ids by falling frequency over all documents: one row per id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=dtype))
            if len(n) > len(total):
                n[: len(total)] += total
                total = n
            else:
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # Bounded by the vocabulary.
    rows = counts.orderBy(F.desc("n"), "id").select("id").collect()
    return np.array([r[0] for r in rows], dtype="<u4")


# --- files -------------------------------------------------------------------------------------------


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def put(path: str, parts: Iterator[bytes]) -> int:
    """Write a file beside its place and move it there: a task that runs twice leaves one whole file."""
    fs, name = _open(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    aside, n = f"{name}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(aside) as out:
        for p in parts:
            out.write(p)
            n += len(p)
    fs.move(aside, name)
    return n


def reader(path: str) -> pa.NativeFile:
    """A file to read from front to back, so that a task holds a part of it only."""
    fs, name = _open(path)
    return fs.open_input_stream(name)


def _blocks(rows: Iterator[tuple], rank_of: np.ndarray, position: list[int], dtype: str) -> Iterator[bytes]:
    held, n, size = [], 0, np.dtype(dtype).itemsize

    def block() -> bytes:
        ids = np.frombuffer(b"".join(x for _, x in held), dtype=dtype)
        control, data = encode_ranks(rank_of[ids])
        head = HEAD.pack(len(held), len(ids), len(data), position[0])
        position[0] += len(ids)
        keys = np.array([k or 0 for k, _ in held], dtype="<i8").tobytes()
        null = np.array([k is None for k, _ in held], dtype=np.uint8).tobytes()
        return head + keys + null + np.array([len(x) // size for _, x in held], dtype="<u4").tobytes() + control + data

    yield MAGIC
    for k, x in rows:
        held.append((k, x))
        n += len(x) // size
        if n >= BLOCK_IDS:
            yield block()
            held, n = [], 0
    if held:
        yield block()


def write_files(tokens: DataFrame, path: str, ranks: np.ndarray, dtype: str) -> DataFrame:
    """Files of ascending keys under ``path``; returns their manifest (file, part, n_docs, n_ids, n_bytes)."""
    spark = tokens.sparkSession
    put(f"{path}/ranks", iter([ranks.tobytes()]))
    rank_of = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, dtype="<u4")
    rank_of[ranks] = np.arange(len(ranks), dtype="<u4")
    # An entry per id of the vocabulary.
    shared = spark.sparkContext.broadcast(rank_of)
    ordered = tokens.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0, 0]

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    seen[0] += 1
                    seen[1] += len(x) // np.dtype(dtype).itemsize
                    yield k, x

        name = f"{path}/part-{part:06d}.tok"
        size = put(name, _blocks(rows(), shared.value, [0], dtype))
        yield pa.record_batch([pa.array([name]), pa.array([part], pa.int64()), pa.array([seen[0]], pa.int64()), pa.array([seen[1]], pa.int64()), pa.array([size], pa.int64())], names=["file", "part", "n_docs", "n_ids", "n_bytes"])

    return store(ordered.select("key", "ids").mapInArrow(run, "file string, part long, n_docs long, n_ids long, n_bytes long"), "manifest")


DOCS = "key long, start long, n_ids long, ids binary"


def _take(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError("a token file is cut off")
    return data


def read_blocks(f, ranks: np.ndarray) -> Iterator[tuple[list, int, np.ndarray, np.ndarray]]:
    """(keys, position of the first id in the file, ids of each document, ids) per block of an open file."""
    if _take(f, len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while head := f.read(HEAD.size):
        if len(head) != HEAD.size:
            raise ValueError("a token file is cut off")
        docs, n, size, first = HEAD.unpack(head)
        keys, null, lengths = (np.frombuffer(_take(f, w * docs), t) for t, w in (("<i8", 8), ("u1", 1), ("<u4", 4)))
        control, data = _take(f, (n + 3) // 4), _take(f, size)
        yield [None if z else int(k) for k, z in zip(keys, null, strict=True)], first, lengths, ranks[decode_ranks(control, data, n)]


def read_files(spark: SparkSession, path: str, manifest: DataFrame, each=None, schema: str = DOCS, arrow: pa.Schema | None = None) -> DataFrame:
    """Documents of the files: key, start (ids of all documents before it), n_ids, ids.

    ``each(ids)`` may replace the last column's bytes by what ``schema`` says, so that ids need not leave the reader.
    """
    # One row per file.
    parts = manifest.select("file", "part", "n_ids").orderBy("part").collect()
    before = np.cumsum([0, *(r["n_ids"] for r in parts)])
    files = spark.createDataFrame([(r["file"], int(b)) for r, b in zip(parts, before[:-1], strict=True)], "file string, before long")
    arrow = arrow or pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with reader(f"{path}/ranks") as table:
            ranks = np.frombuffer(table.read(), dtype="<u4")
        for batch in batches:
            for row in batch.to_pylist():
                with reader(row["file"]) as file:
                    for keys, first, lengths, ids in read_blocks(file, ranks):
                        ends = np.cumsum(lengths, dtype=np.int64)
                        last = [(each or bytes)(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                        columns = (keys, row["before"] + first + ends - lengths, lengths.astype(np.int64), last)
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return files.repartition(max(1, len(parts))).mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", path: str | None = None, pieces: bool = True) -> tuple[str, DataFrame]:
    """Write ``docs`` as token files; (their folder, their manifest)."""
    path = qualified(docs.sparkSession, path or new_path(docs.sparkSession, "tokens"))
    dtype = width(tokenizer, end)
    tokens = tokenize(docs, key, text, tokenizer, end, dtype, pieces)
    manifest = write_files(tokens, path, rank_table(tokens, dtype), dtype)
    drop_stored(tokens)
    return path, manifest
