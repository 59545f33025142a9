"""Texts cut into chunks by what they are: markdown, prose, code, logs. Native columns: a chunk list per row.

A chunk is (n, kind, language, text). Long parts are cut between paragraphs (one of which is repeated) or between lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import let

#: Most characters of a chunk, paragraphs repeated, and where parts begin.
MOST, OVERLAP = 1500, 1
FENCE = r"(?ms)^```([\w+\-./]*)\s*\n(.*?)\n```\s*$"
HEADING = r"(?m)(?=^#{1,6}\s+.+?\s*$)"
DEFINITION = r"(?m)(?=^(?:async\s+)?(?:def|class|func|fn|function|public|private|protected|static)\b)"
TRACEBACK = r"(?m)(?=Traceback \(most recent call last\):|^goroutine \d+ \[|Exception in thread \"[^\"]+\")"
LEVEL_LINE = r"(?m)(?=^.{0,40}\b(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|TRACE)\b)"
KINDS = {"markdown": ("markdown",), "text": ("text", "mixed", "unknown"), "code": ("code", "source", "patch", "diff"), "log": ("log", "logs", "stacktrace", "traceback")}

_WHITE = " \t\n\r\x0b\x0c"


def _strip(t: Column, chars: str = _WHITE) -> Column:
    return F.btrim(t, F.lit(chars))


def _filled(parts: Column) -> Column:
    return F.filter(parts, lambda p: _strip(p) != "")


def packed(parts: Column, most: int, glue: str, overlap: int = 0) -> Column:
    """Neighbouring parts joined as long as they fit; a part that is too long alone stays alone. A new chunk begins with the
    last ``overlap`` parts of the one before, if that has more."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"))

    def step(a: Column, p: Column) -> Column:
        text = F.array_join(a["cur"], glue)
        fits = (F.size(a["cur"]) == 0) | (F.length(text) + len(glue) + F.length(p) <= most)
        kept = F.when(F.size(a["cur"]) > overlap, F.slice(a["cur"], F.size(a["cur"]) - overlap + 1, F.lit(overlap))).otherwise(F.array().cast("array<string>")) if overlap else F.array().cast("array<string>")
        same = F.struct(a["done"].alias("done"), F.array_append(a["cur"], p).alias("cur"))
        return F.when(fits, same).otherwise(F.struct(F.array_append(a["done"], text).alias("done"), F.array_append(kept, p).alias("cur")))

    return F.aggregate(parts, zero, step, lambda a: F.when(F.size(a["cur"]) == 0, a["done"]).otherwise(F.array_append(a["done"], F.array_join(a["cur"], glue))))


def paragraphs(text: Column, most: int = MOST) -> Column:
    paras = F.transform(_filled(F.split(text, r"\n\s*\n", -1)), lambda p: _strip(p))
    return packed(paras, most, "\n\n", OVERLAP)


def _by_lines(block: Column, most: int) -> Column:
    """A block, or its lines packed if it is too long."""
    lines = F.split(block, r"(?<=\n)", -1)
    cut = F.transform(packed(F.filter(lines, lambda s: s != ""), most, ""), lambda c: F.rtrim(c, F.lit("\n")))
    return F.when(F.length(block) <= most, F.array(block)).otherwise(_filled(cut))


def _blocks(text: Column, boundary: str, most: int) -> Column:
    parts = F.transform(F.split(text, boundary, -1), lambda p: _strip(p, "\n"))
    return F.flatten(F.transform(_filled(parts), lambda p: _by_lines(p, most)))


def _chunk(kind: str, language: Column | None = None):
    return lambda t: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if language is None else language).alias("language"), t.alias("text"))


def _markdown(text: Column, most: int) -> Column:
    fences = F.regexp_extract_all(text, F.lit(FENCE), F.lit(2))
    langs = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))

    def part(p: Column, i: Column) -> Column:
        sections = F.transform(_filled(F.split(p, HEADING, -1)), lambda s: _strip(s))
        prose = F.transform(F.flatten(F.transform(sections, lambda s: paragraphs(s, most))), _chunk("markdown"))
        body = F.get(fences, i)
        code = F.array(F.struct(F.lit("code").alias("kind"), F.nullif(F.get(langs, i), F.lit("")).alias("language"), body.alias("text")))
        return F.when(body.isNull(), prose).otherwise(F.concat(prose, code))

    return F.flatten(F.transform(F.split(text, FENCE, -1), part))


def chunks(text: Column, kind: Column, language: Column | None = None, most: int = MOST) -> Column:
    """[(n, kind, language, text)] of a text of a kind (unknown kinds are prose)."""
    t = F.coalesce(text, F.lit(""))
    k = F.lower(F.coalesce(kind, F.lit("unknown")))
    log = F.when(t.rlike(TRACEBACK), _blocks(t, TRACEBACK, most)).otherwise(_blocks(t, LEVEL_LINE, most))
    out = (
        F.when(k.isin(*KINDS["markdown"]), _markdown(t, most))
        .when(k.isin(*KINDS["code"]), F.transform(_blocks(t, DEFINITION, most), _chunk("code", language)))
        .when(k.isin(*KINDS["log"]), F.transform(log, _chunk("log")))
        .otherwise(F.transform(paragraphs(t, most), _chunk("text")))
    )
    return let(out, lambda c: F.transform(c, lambda x, i: F.struct(i.alias("n"), x["kind"].alias("kind"), x["language"].alias("language"), x["text"].alias("text"))))
