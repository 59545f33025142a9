"""WARC archives: writing with deduplication and segmentation, reading with reassembly.

Writing: a payload of at least ``revisit_from`` bytes that several pages share is stored once, with the smallest
id (``response``); the others become ``revisit`` records that refer to it. HTTP bodies are chunk-framed, and a block
longer than ``segment`` bytes is cut: the first record has segment number 1, continuation records name
it as their origin, and the last of them states the total length. Every record is a gzip member of its own.

Reading: records are grouped by origin, ordered by segment number, checked for gaps and against the total
length, joined, and freed of chunk framing; the payload must have the digest that its header states.
Segments may stand in any file. Only a record's own segments ever meet in one task.

Defined results: a null page is an empty payload; a null id is kept and never shared; rows of one id and payload
are all responses; an empty table writes no record and reads as an empty table. A broken record raises.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import new_path, qualified, store
from tessella.llm.token_ids import put, reader

SEGMENT, CHUNK, REVISIT_FROM = 16 << 10, 4 << 10, 100
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"


def record_id(page: int | None, tie: str) -> str:
    h = hashlib.md5(f"{page}/{tie}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def frame(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [b"%x" % len(piece), CRLF, piece, CRLF]
    return b"".join([*parts, b"0", CRLF, CRLF])


def unframe(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(parts)
        at = end + 2
        if body[at + n : at + n + 2] != CRLF:
            raise ValueError("chunk framing is broken")
        parts.append(body[at : at + n])
        at += n + 2


def render(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + CRLF + CRLF


def records(page: int | None, url: str | None, payload: bytes, refers_to: int | None, tie: str, segment: int = SEGMENT, refers_url: str | None = None) -> Iterator[bytes]:
    """The record of a page, or its first segment and the continuation records."""
    digest = hashlib.sha256(payload).hexdigest()
    own = record_id(page, tie)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head if refers_to is not None else head + frame(payload)
    plain = lambda u: None if u is None else "".join(c for c in u if c not in "\r\n")
    uri = plain(url)
    common = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", len(payload)), ("WARC-Page-ID", page)]
    if refers_to is not None:
        yield render([("WARC-Type", "revisit"), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", plain(refers_url)), ("WARC-Refers-To-Date", DATE), ("WARC-Refers-To-Page-ID", refers_to)], block)
        return
    cuts = range(0, max(1, len(block)), segment)
    for n, i in enumerate(cuts, 1):
        piece = block[i : i + segment]
        if n == 1:
            yield render([("WARC-Type", "response"), *common, ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", 1 if len(cuts) > 1 else None)], piece)
        else:
            total = len(block) if n == len(cuts) else None
            yield render([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page, f"{tie}/{n}")), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], piece)


def revisits(pages: DataFrame, key: str, payload: str, least: int = REVISIT_FROM, url: str = "url") -> DataFrame:
    """(id, first, first_url) of the pages whose payload a page of a smaller id has."""
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    rows = pages.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n"), F.col(f"`{url}`").cast("string").alias("url")).where(F.col("n") >= least).select("id", "url", F.unhex("digest").alias("digest"))
    first = rows.groupBy("digest").agg(F.min(F.struct("id", "url")).alias("f"), F.count(F.lit(1)).alias("pages")).where(F.col("pages") > 1).select("digest", F.col("f.id").alias("first"), F.col("f.url").alias("first_url"))
    return rows.join(first, "digest").where(F.col("id") > F.col("first")).select("id", "first", "first_url", "digest").distinct()


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", segment: int = SEGMENT, least: int = REVISIT_FROM) -> DataFrame:
    """Archives under ``path``; returns their manifest (file, records, n_bytes)."""
    again = store(revisits(pages, key, payload, least, url), "revisits")
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"))
    # An id may come with several payloads; the digest tells which of them is the revisit.
    marked = rows.join(again.withColumnRenamed("digest", "d"), "id", "left").withColumn("first", F.when(F.unhex(F.sha2("payload", 256)) == F.col("d"), F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), [0]

        def members() -> Iterator[bytes]:
            for batch in batches:
                for r in batch.to_pylist():
                    for rec in records(r["id"], r["url"], r["payload"], r["first"], f"{part}/{n[0]}", segment, r["first_url"]):
                        yield gzip.compress(rec, 1, mtime=0)
                    n[0] += 1

        name = f"{path}/part-{part:06d}.warc.gz"
        size = put(name, members())
        yield pa.record_batch([pa.array([name]), pa.array([n[0]], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "n_bytes"])

    return store(marked.select("id", "url", "payload", "first", "first_url").mapInArrow(run, "file string, records long, n_bytes long"), "archives")


def parse(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, read from front to back, one record at a time."""
    f = io.BufferedReader(io.BytesIO(data) if isinstance(data, bytes) else data, 1 << 18)
    stream = gzip.GzipFile(fileobj=f) if f.peek(2)[:2] == b"\x1f\x8b" else f
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline().rstrip(CRLF)):
            k, _, v = line.decode().partition(":")
            headers[k.lower()] = v.strip()
        block = stream.read(n := int(headers["content-length"]))
        if len(block) != n:
            raise ValueError("a record is cut off")
        yield headers, block


def _records_of(name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    with reader(name) as f:
        yield from parse(f)


RECORDS = "origin string, number int, total long, type string, id long, url string, digest string, length long, refers_to long, block binary"
RECORDS_ARROW = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("type", pa.string()), ("id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("length", pa.int64()), ("refers_to", pa.int64()), ("block", pa.binary())])


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """All records of the archives, one row each."""
    files = manifest.select("file").repartition(max(1, manifest.count()), "file")
    num = lambda h, k: int(h[k]) if k in h else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), RECORDS_ARROW, strict=True)], schema=RECORDS_ARROW)

        rows: list[tuple] = []
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for h, block in _records_of(name):
                    origin = h.get("warc-segment-origin-id", h["warc-record-id"])
                    rows.append((origin, num(h, "warc-segment-number"), num(h, "warc-segment-total-length"), h["warc-type"], num(h, "warc-page-id"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha256:"), num(h, "warc-payload-length"), num(h, "warc-refers-to-page-id"), block))
                    if len(rows) >= 256:
                        yield out(rows)
                        rows = []
        if rows:
            yield out(rows)

    return files.mapInArrow(run, RECORDS)


def join_segments(segments: list[dict]) -> bytes:
    """The block of one record from its segments in order; raises where one is missing or lengths differ."""
    if len(segments) == 1 and segments[0]["number"] is None:
        return segments[0]["block"]
    if [s["number"] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("a segment is missing or doubled")
    block = b"".join(s["block"] for s in segments)
    if segments[-1]["total"] != len(block):
        raise ValueError("segments do not have the stated total length")
    return block


PAGES = "id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
PAGES_ARROW = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Pages of the archives: payloads of responses are reassembled and checked; revisits carry no payload."""
    found = read_records(spark, manifest)
    names = ("type", "id", "url", "digest", "length", "refers_to", "total", "block")
    groups = found.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", *names))).alias("segments"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                for segments in batch.column(0).slice(i, 256).to_pylist():
                    head = segments[0]
                    payload, digest, n = None, head["digest"], head["length"]
                    block = join_segments(segments)
                    if head["type"] == "response":
                        http, _, body = block.partition(CRLF + CRLF)
                        payload = unframe(body) if b"transfer-encoding: chunked" in http.lower() else body
                        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if digest != head["digest"]:
                            raise ValueError("a payload does not have its digest")
                    rows.append((head["id"], head["url"], payload, n, digest, head["type"], head["refers_to"]))
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), PAGES_ARROW, strict=True)], schema=PAGES_ARROW)

    return groups.select("segments").mapInArrow(run, PAGES)


def unresolved(read_pages: DataFrame) -> DataFrame:
    """Revisits (id, refers_to) whose response is missing or has another payload: none in an archive that is whole. Both sides are
    reduced to digests first, so no payload moves."""
    light = read_pages.select("id", "payload_digest", "record_type", "refers_to")
    there = light.where(F.col("record_type") == "response").select(F.col("id").alias("refers_to"), "payload_digest").distinct()
    return light.where(F.col("record_type") == "revisit").join(there, ["refers_to", "payload_digest"], "left_anti").select("id", "refers_to")


def archive(pages: DataFrame, path: str | None = None, **options) -> tuple[str, DataFrame]:
    path = qualified(pages.sparkSession, path or new_path(pages.sparkSession, "warc"))
    return path, write(pages, path, **options)
