"""Text of simple PDF files, without other programs: page streams are unpacked and their text operators read.

Fonts with tables of their own (most scans and some exports) give no usable text; such files come out empty, and a
recogniser of images is to be plugged in by the caller.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_TEXT = re.compile(rb"BT\b(.*?)\bET\b", re.S)
_SHOWN = re.compile(rb"(\((?:\\.|[^\\()])*\))\s*(?:Tj|'|\")|\[((?:\s*(?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|-?[\d.]+))*)\s*\]\s*TJ|(T\*|(?:Td|TD|Tm)\b)", re.S)
_PIECE = re.compile(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]*)>|(-?[\d.]+)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _plain(raw: bytes) -> str:
    text = re.sub(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)", lambda m: _ESCAPES.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1].strip() == b"" else m[1]), raw)
    return text[2:].decode("utf-16-be", "replace") if text.startswith(b"\xfe\xff") else text.decode("latin-1")


def pdf_text(data: bytes) -> str:
    """The text of all streams in their order; a line per line operator, a blank line between streams."""
    pages = []
    for head, body in _STREAM.findall(data):
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        elif b"/Filter" in head:
            continue
        lines = [""]
        for block in _TEXT.findall(body):
            for one, many, move in _SHOWN.findall(block):
                if move:
                    lines += [""] if lines[-1] else []
                elif one:
                    lines[-1] += _plain(one[1:-1])
                else:
                    for text, hexed, gap in _PIECE.findall(many):
                        # A wide step back between two pieces is a space.
                        lines[-1] += " " if gap and float(gap) < -200 else bytes.fromhex(hexed.decode()).decode("latin-1") if hexed else _plain(text)
            lines += [""] if lines[-1] else []
        page = "\n".join(x for x in lines if x)
        if page:
            pages.append(page)
    return "\n\n".join(pages)


def pdf_texts(files: DataFrame) -> DataFrame:
    """(path, text) of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b.path, "text": [pdf_text(bytes(c)) if c is not None else "" for c in b.content]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")
