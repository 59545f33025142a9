"""Source files, rule files, logs, lists, feeds, databases, exports."""

from __future__ import annotations

import datetime as dt
import sqlite3

from pyspark.sql import functions as F

from tessella import model
from tessella.sources import code, readers

PY = '''import os

class Store:
    """Keeps things."""

    @property
    def size(self):
        return 1

async def fetch(url: str) -> str:
    "Get it."
    return url
'''
JS = """export class A extends B {
  run(x) {
    if (x) { return "}"; }
    return 1;
  }
}

function plain(a, b) {
  return a + b;
}
"""
GO = "package m\n\ntype T struct {\n\tA int\n}\n\nfunc (t *T) Do(a int) error {\n\treturn nil\n}\n\nfunc main() {}\n"
RB = "module M\n  class C\n    def self.go!\n      1\n    end\n  end\nend\n"


def test_code_chunks(spark):
    files = spark.createDataFrame([("a/x.py", PY), ("b.js", JS), ("c.go", GO), ("d.rb", RB), ("bad.py", "def ("), ("n.txt", "hello\nyou"), ("none.py", None)], "path string, content string").repartition(3)
    got = {(r.path, r.kind, r.name): r for r in code.code_chunks(files).collect()}
    assert set(got) == {("a/x.py", "class", "Store"), ("a/x.py", "function", "size"), ("a/x.py", "function", "fetch"), ("b.js", "class", "A"), ("b.js", "method", "run"), ("b.js", "function", "plain"), ("c.go", "type", "T"), ("c.go", "method", "Do"), ("c.go", "function", "main"), ("d.rb", "module", "M"), ("d.rb", "class", "C"), ("d.rb", "method", "go!"), ("bad.py", "file", "bad.py"), ("n.txt", "file", "n.txt")}
    s = got["a/x.py", "class", "Store"]
    assert (s.docstring, s.signature, s.start_line, s.end_line, s.parent) == ("Keeps things.", "class Store:", 3, 8, None)
    size, fetch = got["a/x.py", "function", "size"], got["a/x.py", "function", "fetch"]
    assert (size.parent, size.start_line, size.content.split("\n")[0].strip()) == ("Store", 6, "@property") and fetch.docstring == "Get it."
    assert (got["b.js", "class", "A"].end_line, got["b.js", "method", "run"].end_line, got["b.js", "method", "run"].parent) == (6, 5, "A")
    assert got["c.go", "method", "Do"].end_line == 9 and got["d.rb", "method", "go!"].parent == "C" and got["d.rb", "method", "go!"].end_line == 5
    assert got["n.txt", "file", "n.txt"].content == "hello\nyou"


RULES = """# Title
intro

## Code style
- ALWAYS use **pytest** for Python
  and keep it small
1. never use Redis for that

```
- not a rule
```
| a | b |
### Names
* short names
**Important** line here
## Empty
"""


def test_rules(spark):
    found = code.rules(spark.createDataFrame([("r.md", RULES), ("e.md", "")], "path string, content string"))
    got = [(r.section, r.text, r.kind, r.technologies) for r in found.orderBy("path", "place").collect()]
    assert got == [
        ("Code style", "ALWAYS use pytest for Python and keep it small", "convention", ["python", "pytest"]),
        ("Code style", "never use Redis for that", "prohibition", ["redis"]),
        ("Code style / Names", "short names", "rule", []),
        ("Code style / Names", "Important line here", "rule", []),
    ]
    edges = {(r.target, r.relation, r.weight) for r in code.rule_edges(found).collect()}
    assert {("r.md", "part_of", 0.8), ("code style", "part_of", 0.5), ("redis", "applies_to", 0.7)} <= edges


def test_logs_lists_feeds(spark):
    log = spark.createDataFrame([("a1|Ann|2024-01-02T03:04:05Z|feat(core)!: new | thing",), ("b2|Bo|2024-01-03T00:00:00Z|words",), ("broken",)], "value string")
    assert [(r.hash, r.kind, r.subject, r["at"]) for r in code.commits(log).collect()] == [("a1", "feat", "feat(core)!: new | thing", dt.datetime(2024, 1, 2, 3, 4, 5)), ("b2", "other", "words", dt.datetime(2024, 1, 3))]
    req = spark.createDataFrame([("r.txt", "# x\nNumpy>=1.2,<3\nrequests[socks] == 2.0 ; python_version > '3'\nplain # why\n-r other\n\n")], "path string, content string")
    assert [tuple(r)[1:] for r in code.requirements(req).collect()] == [("numpy", ">=", "1.2"), ("requests", "==", "2.0"), ("plain", None, None)]
    feed = spark.createDataFrame([("f", "<rss><item><title><![CDATA[A & B]]></title><link>http://x</link><pubDate>Mon</pubDate></item><item><title>C</title></item></rss>")], "feed string, xml string")
    assert [tuple(r)[1:] for r in code.feed_items(feed).collect()] == [("A & B", "http://x", "Mon"), ("C", "", "")]


def test_sqlite_table(spark, tmp_path):
    with sqlite3.connect(tmp_path / "d.db") as c:
        c.execute("CREATE TABLE t (name TEXT, n INTEGER)")
        c.executemany("INSERT INTO t VALUES (?, ?)", [(f"x{i}", i) for i in range(25)])
    got = readers.sqlite_table(spark, str(tmp_path / "d.db"), "SELECT name, n FROM t WHERE rowid >= {low} AND rowid < {high}", "name string, n long", 25, 10)
    assert sorted(map(tuple, got.collect())) == sorted((f"x{i}", i) for i in range(25))


def test_markdown_export(spark, sf_dir, tmp_path):
    r = model.records(spark, sf_dir).where("project in ('src1', 'src2')")
    readers.write_markdown(r, str(tmp_path / "md"))
    back = spark.read.text(str(tmp_path / "md"), recursiveFileLookup=False)
    lines = [x.value for x in back.where(F.col("project") == "src1").collect()]
    types = sorted({x.type for x in r.where("project = 'src1'").collect()})
    assert [x for x in lines if x.startswith("## ")] == [f"## {t}" for t in types]
    assert sum(not x.startswith("## ") for x in lines) == r.where("project = 'src1'").count()
    page = readers.wiki(model.records(spark, sf_dir), 3)
    assert {x.part for x in page.collect()} <= {"decisions", "solutions", "conventions", "changes"} and page.groupBy("project", "part").count().agg(F.max("count")).first()[0] <= 3


def test_inbox_stream(spark, tmp_path):
    box = tmp_path / "inbox"
    box.mkdir()
    for name in ("a.md", "b.PY", "c.pdf", "d.url", "e.xyz"):
        (box / name).write_text("x")
    q = readers.inbox(spark, str(box)).writeStream.format("memory").queryName("inbox").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.kind for r in spark.table("inbox").collect()) == ["code", "other", "pdf", "text", "url"]


def test_event_log(spark, tmp_path):
    e = spark.createDataFrame([(1, "a"), (2, None)], "id long, what string")
    readers.append_log(e, str(tmp_path / "log"))
    readers.append_log(e.where("id = 2").withColumn("id", F.lit(3).cast("long")), str(tmp_path / "log"))
    assert sorted(map(tuple, readers.read_log(spark, str(tmp_path / "log"), "id long, what string").collect())) == [(1, "a"), (2, None), (3, None)]


def test_import_leaves_out_what_is_known(spark):
    base = " ".join(f"w{i}" for i in range(20))
    notes = spark.createDataFrame([("a.md", base + " extra"), ("b.md", "all new words here"), ("c.md", "here all new words"), ("d.md", "")], "path string, body string")
    known = spark.createDataFrame([(base,), ("something else",)], "content string")
    assert [r.path for r in readers.import_notes(notes, known).collect()] == ["b.md"]


def test_chunkers(spark):
    from tessella.functions import chunkers as K

    def cut(text, kind, most=40):
        df = spark.createDataFrame([(text, kind)], "t string, k string").select(F.explode(K.chunks(F.col("t"), F.col("k"), F.lit("go"), most)).alias("c")).select("c.*")
        return [(r.n, r.kind, r.language, r.text) for r in df.collect()]

    md = "intro\n\n# One\ntext a\n\ntext b\n```py\nx = 1\ny = 2\n```\nafter\n## Two\nend"
    assert cut(md, "markdown", 200) == [(0, "markdown", None, "intro"), (1, "markdown", None, "# One\ntext a\n\ntext b"), (2, "code", "py", "x = 1\ny = 2"), (3, "markdown", None, "after"), (4, "markdown", None, "## Two\nend")]
    prose = "aaaaaaaaaaaaaaa\n\nbbbbbbbbbbbbbbb\n \nccccccccccccccc\n\n" + "d" * 60
    assert [c[3] for c in cut(prose, "unknown")] == ["aaaaaaaaaaaaaaa\n\nbbbbbbbbbbbbbbb", "bbbbbbbbbbbbbbb\n\nccccccccccccccc", "ccccccccccccccc\n\n" + "d" * 60]
    code = "package m\n\nfunc a() {\n}\nfunc b() {\n" + "  one()\n" * 6 + "}\n"
    assert [c[1:] for c in cut(code, "code")] == [("code", "go", "package m"), ("code", "go", "func a() {\n}"), ("code", "go", "func b() {\n  one()\n  one()\n  one()"), ("code", "go", "  one()\n  one()\n  one()\n}")]
    log = "start\n2024 INFO a\n more\nWARN b\n"
    assert [c[3] for c in cut(log, "log")] == ["start", "2024 INFO a\n more", "WARN b"]
    trace = "x\nTraceback (most recent call last):\n  File 1\nE\nTraceback (most recent call last):\n  F 2"
    assert [c[3] for c in cut(trace, "stacktrace", 100)] == ["x", "Traceback (most recent call last):\n  File 1\nE", "Traceback (most recent call last):\n  F 2"]
    assert cut("  \n ", "text") == [] and cut(None, None) == []


def test_pdf_text(spark):
    import zlib

    from tessella.sources import documents

    one = b"BT /F1 12 Tf 72 700 Td (Hello \\(big\\) w\\366rld) Tj T* [(sec) -20 (ond) -300 (line)] TJ ET"
    packed = zlib.compress(b"BT <48> Tj (page two) Tj ET BT (more) ' ET")
    pdf = b"%PDF-1.4\n1 0 obj\n<< /Length 9 >>\nstream\n" + one + b"\nendstream\nendobj\n2 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\n3 0 obj << /Filter /DCTDecode >> stream\nBT (no) Tj ET\nendstream"
    got = documents.pdf_texts(spark.createDataFrame([("a.pdf", pdf), ("b.pdf", b"junk"), ("c.pdf", None)], "path string, content binary"))
    assert {r.path: r.text for r in got.collect()} == {"a.pdf": "Hello (big) wörld\nsecond line\n\npage two\nmore", "b.pdf": "", "c.pdf": ""}


def test_lock(spark, tmp_path):
    from tessella.operators import queues

    folder = str(tmp_path)
    with queues.lock(spark, folder, "work") as mine:
        with queues.lock(spark, folder, "work") as other, queues.lock(spark, folder, "else") as third:
            assert (mine, other, third) == (True, False, True)
        with queues.lock(spark, folder, "work", stale_after=-1) as taken:
            assert taken
    with queues.lock(spark, folder, "work") as again:
        assert again


def test_paraphrase(spark):
    from tessella.operators import reports

    rows = [("Short.\nWe fix the error in the parser module today. More", ["parser", "module"]), ("tiny", ["alpha", "beta", "gamma"]), ("Parser module here now", ["parser", "module", "here"])]
    got = [r[0] for r in spark.createDataFrame(rows, "c string, k array<string>").select(reports.paraphrase(F.col("c"), F.col("k"))).collect()]
    assert got == ["we resolve the problem in the today", "alpha beta gamma", "how to parser module"]
