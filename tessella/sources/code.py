"""Source files as chunks and rule files as graph rows; logs of commits and lists of dependencies.

A file is parsed by the task that reads it. Python has its own parser; of other languages the heads of definitions are
found by pattern and their ends by braces or ``end`` lines. A file without a definition is one chunk.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------------------------------

LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "go": "go", "rs": "rust", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "hh": "cpp", "h": "cpp", "java": "java", "rb": "ruby", "cs": "csharp"}
#: Heads of definitions per language: kind and pattern with the name.
_BRACED = (("class", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+|public\s+|private\s+|protected\s+|static\s+|final\s+|sealed\s+)*class\s+(\w+)"), ("interface", r"^[ \t]*(?:export\s+|public\s+)*interface\s+(\w+)"))
HEADS = {
    "javascript": (*_BRACED[:1], ("function", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(\w+)"), ("method", r"^[ \t]+(?:static\s+|async\s+)*(?!if\b|for\b|while\b|switch\b|return\b|catch\b|function\b)(\w+)\s*\([^;{}]*\)\s*\{")),
    "go": (("function", r"^func\s+(\w+)\s*\("), ("method", r"^func\s+\([^)]*\)\s*(\w+)\s*\("), ("type", r"^type\s+(\w+)\s")),
    "rust": (("function", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)"), ("struct", r"^[ \t]*(?:pub\s+)?struct\s+(\w+)"), ("enum", r"^[ \t]*(?:pub\s+)?enum\s+(\w+)"), ("trait", r"^[ \t]*(?:pub\s+)?trait\s+(\w+)"), ("impl", r"^[ \t]*impl(?:<[^>]*>)?\s+(\w+)")),
    "cpp": (("class", r"^[ \t]*class\s+(\w+)[^;]*$"), ("struct", r"^[ \t]*struct\s+(\w+)[^;]*$"), ("function", r"^(?!\s|else\b|if\b|for\b|while\b|switch\b|return\b)[\w:<>*&\s]+?[\s*&](\w+)\s*\([^;{}]*\)\s*(?:const\s*)?\{")),
    "java": (*_BRACED, ("method", r"^[ \t]+(?:public|private|protected|static|final|abstract|synchronized|\s)+[\w<>\[\], ?]+\s+(\w+)\s*\([^;{}]*\)[^;{}]*\{")),
    "ruby": (("class", r"^[ \t]*class\s+(\w+)"), ("module", r"^[ \t]*module\s+(\w+)"), ("method", r"^[ \t]*def\s+(?:self\.)?(\w+[?!]?)")),
}
HEADS["typescript"] = (*HEADS["javascript"], _BRACED[1], ("type", r"^[ \t]*(?:export\s+)?type\s+(\w+)\s*="))
HEADS["tsx"], HEADS["csharp"] = (*HEADS["javascript"], _BRACED[1]), (*HEADS["java"], ("struct", r"^[ \t]*(?:public\s+|internal\s+)?struct\s+(\w+)"))
MAX_BYTES = 2_000_000

TECHNOLOGIES = (
    "go", "golang", "php", "symfony", "python", "javascript", "typescript", "vue", "nuxt", "react", "docker", "postgresql", "postgres", "redis", "rabbitmq", "grpc", "rest", "graphql", "nginx", "git", "linux",
    "kubernetes", "terraform", "aws", "stripe", "telegram", "sqlite", "chromadb", "ollama", "tailwind", "pinia", "laravel", "django", "fastapi", "flask", "celery", "protobuf", "prometheus", "monolog",
    "doctrine", "alembic", "sqlalchemy", "pydantic", "pytest", "phpunit", "phpstan", "eslint", "ruff", "mypy", "slog", "chi", "pgx", "bitrix", "bitrix24", "makefile", "compose",
)
PROHIBITIONS = ("ЗАПРЕЩЕНО", "НИКОГДА", "NEVER", "КАТЕГОРИЧЕСКИ", "FORBIDDEN", "DO NOT", "DON'T", "НЕ ИСПОЛЬЗОВАТЬ", "НЕ ДЕЛАТЬ", "АБСОЛЮТНЫЙ ЗАПРЕТ")
CONVENTIONS = ("ВСЕГДА", "ALWAYS", "ОБЯЗАТЕЛЬНО", "ДОЛЖЕН", "MUST", "ОБЯЗАН", "ПРЕДПОЧТИТЕЛЬНО", "PREFERRED", "RECOMMENDED", "ПО УМОЛЧАНИЮ", "DEFAULT", "CONVENTION")

# --- code --------------------------------------------------------------------------------------------

CHUNK = "path string, language string, kind string, name string, parent string, signature string, docstring string, start_line int, end_line int, content string"
_COLUMNS = [c.split()[0] for c in CHUNK.split(", ")]


def _python_chunks(source: str) -> list[tuple]:
    lines, out = source.splitlines(), []

    def walk(node: ast.AST, parent: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                kind = "class" if isinstance(n, ast.ClassDef) else "function"
                out.append((kind, n.name, parent, lines[n.lineno - 1].strip(), ast.get_docstring(n), first, n.end_lineno))
                walk(n, n.name)
            else:
                walk(n, parent)

    walk(ast.parse(source), None)
    return out


def _end_of(lines: list[str], at: int, language: str) -> int:
    """Last line of the definition that begins at line ``at``: where its braces close, or its ``end`` stands."""
    if language == "ruby":
        margin = len(lines[at]) - len(lines[at].lstrip())
        for i in range(at + 1, len(lines)):
            if lines[i].strip() == "end" and len(lines[i]) - len(lines[i].lstrip()) <= margin:
                return i
        return len(lines) - 1
    depth, opened = 0, False
    for i in range(at, len(lines)):
        code = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]*`|//.*$", "", lines[i])
        depth += code.count("{") - code.count("}")
        opened = opened or "{" in code
        if (opened and depth <= 0) or (not opened and code.rstrip().endswith(";")):
            return i
    return len(lines) - 1


def _pattern_chunks(source: str, language: str) -> list[tuple]:
    lines, out = source.splitlines(), []
    for kind, pattern in HEADS[language]:
        for m in re.finditer(pattern, source, re.M):
            at = source.count("\n", 0, m.start(1))
            out.append((kind, m[1], at, _end_of(lines, at, language)))
    out.sort(key=lambda c: (c[2], -c[3]))
    chunks = []
    for kind, name, a, b in out:
        around = [c for c in out if c[2] < a and c[3] >= b and c[0] in ("class", "struct", "impl", "trait", "module", "interface")]
        chunks.append((kind, name, around[-1][1] if around else None, lines[a].strip(), None, a + 1, b + 1))
    return chunks


def parse_source(path: str, source: str) -> list[tuple]:
    """Rows of CHUNK for one file."""
    language = LANGUAGES.get(path.rpartition(".")[2].lower())
    found: list[tuple] = []
    try:
        found = _python_chunks(source) if language == "python" else _pattern_chunks(source, language) if language in HEADS else []
    except (SyntaxError, ValueError):  # a file that doesn't parse is one chunk
        pass
    lines = source.splitlines()
    if not found:
        name = path.rpartition("/")[2]
        return [(path, language, "file", name, None, None, None, 1, max(1, len(lines)), source)]
    return [(path, language, *c, "\n".join(lines[c[5] - 1 : c[6]])) for c in found]


def code_chunks(files: DataFrame) -> DataFrame:
    """Chunks of files (path, content). Files over MAX_BYTES are left out, as the blueprint says of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, c in zip(b.path, b.content, strict=True) if c is not None for r in parse_source(p, c)]
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({"start_line": "int32", "end_line": "int32"})

    small = files.where(F.octet_length("content") <= MAX_BYTES)
    return small.select("path", "content").mapInPandas(run, CHUNK)


# --- rules -------------------------------------------------------------------------------------------


def _any(text: Column, words) -> Column:
    up, out = F.upper(text), F.lit(False)
    for w in words:
        out = out | F.contains(up, F.lit(w))
    return out


def rule_kind(text: Column) -> Column:
    return F.when(_any(text, PROHIBITIONS), "prohibition").when(_any(text, CONVENTIONS), "convention").otherwise("rule")


def technologies(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.rlike(rf"(?U)\b{t}\b"), t) for t in TECHNOLOGIES)))


def rules(files: DataFrame) -> DataFrame:
    """(path, section, place, text, kind, technologies) of the items under the headings of rule files (path, content): bullets,
    numbered lines and bold lines, with indented lines that go on. Code blocks, tables and rules are left out."""
    body = F.regexp_replace("content", r"(?s)```.*?(?:```|\z)", "")
    body = F.regexp_replace(body, r"(?m)^[ \t]*(?:\||---).*$", "")
    # A line of its own per item: indented lines join the item before them.
    joined = F.regexp_replace(body, r"\n {2,}(?![-*+] |\d+\. )(?=\S)", " ")
    parts = F.split(F.concat(F.lit("\n"), joined), r"\n(?=##{1,2} )", -1)
    sections = files.select("path", F.posexplode(parts).alias("s", "part")).where(F.col("part").rlike("^##"))
    level3 = F.col("part").rlike("^### ")
    title = F.btrim(F.regexp_extract("part", r"^#+\s+(.*)", 1))
    items = F.regexp_extract_all("part", F.lit(r"(?m)^[ \t]*(?:[-*+]\s+|\d+\.\s+|(?=\*\*))(\S.{2,})$"), F.lit(1))
    each = sections.select("path", "s", F.when(~level3, title).alias("own"), title.alias("title"), level3.alias("deep"), F.posexplode_outer(items).alias("place", "text"))
    # The heading above a third-level one is the last second-level one before it.
    from pyspark.sql import Window

    above = F.last("own", ignorenulls=True).over(Window.partitionBy("path").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    named = each.withColumn("above", above).where(F.col("text").isNotNull())
    section = F.when(F.col("deep"), F.concat_ws(" / ", "above", "title")).otherwise(F.col("title"))
    clean = F.btrim(F.regexp_replace("text", r"\*\*([^*]+)\*\*", "$1"))
    out = named.select("path", section.alias("section"), (F.col("s") * 10000 + F.col("place")).alias("place"), clean.alias("text"))
    return out.withColumn("kind", rule_kind(F.col("text"))).withColumn("technologies", technologies(F.col("text")))


def rule_edges(found: DataFrame) -> DataFrame:
    """(source, target, relation, weight): rules to their file, section and technologies."""
    rule = F.concat(F.col("section"), F.lit(": "), F.substring("text", 1, 80))
    edge = lambda target, relation, weight: F.struct(F.lower(target).alias("target"), F.lit(relation).alias("relation"), F.lit(weight).alias("weight"))
    every = F.concat(F.array(edge(F.col("path"), "part_of", 0.8), edge(F.col("section"), "part_of", 0.5)), F.transform("technologies", lambda t: edge(t, "applies_to", 0.7)))
    return found.select(rule.alias("source"), F.explode(every).alias("e")).select("source", "e.*").distinct()


# --- logs and manifests ------------------------------------------------------------------------------


def commits(log: DataFrame, line: str = "value") -> DataFrame:
    """(hash, author, at, subject, kind) of lines ``hash|author|ISO time|subject``; kind by the subject's prefix."""
    p = F.split(line, r"\|", 4)
    kind = F.lower(F.regexp_extract(F.get(p, F.lit(3)), r"^(\w+)(?:\([^)]*\))?!?:", 1))
    rows = log.where(F.size(p) == 4).select(F.get(p, F.lit(0)).alias("hash"), F.get(p, F.lit(1)).alias("author"), F.try_to_timestamp(F.get(p, F.lit(2))).alias("at"), F.get(p, F.lit(3)).alias("subject"), kind.alias("kind"))
    return rows.withColumn("kind", F.when(F.col("kind") == "", "other").otherwise(F.col("kind")))


def requirements(files: DataFrame) -> DataFrame:
    """(path, package, operator, version) of requirement lists (path, content): one package a line, comments left out."""
    lines = files.select("path", F.explode(F.split("content", r"\r?\n", -1)).alias("l")).withColumn("l", F.btrim(F.regexp_replace("l", r"(?:^|\s)#.*$", "")))
    form = r"^([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(?:(==|>=|<=|~=|!=|>|<)\s*([^\s;,]+))?"
    g = lambda n: F.nullif(F.regexp_extract("l", form, n), F.lit(""))
    return lines.where((F.col("l") != "") & ~F.col("l").startswith("-")).select("path", F.lower(g(1)).alias("package"), g(2).alias("operator"), g(3).alias("version")).where(F.col("package").isNotNull())


def feed_items(feeds: DataFrame) -> DataFrame:
    """(feed, title, link, published) of RSS texts (feed, xml)."""
    items = F.regexp_extract_all("xml", F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1))
    tag = lambda n: F.btrim(F.regexp_replace(F.regexp_extract("i", rf"(?s)<{n}\b[^>]*>(.*?)</{n}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    return feeds.select("feed", F.explode(items).alias("i")).select("feed", tag("title").alias("title"), tag("link").alias("link"), tag("pubDate").alias("published"))
