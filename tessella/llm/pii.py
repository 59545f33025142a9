"""Personal data: pattern spans, then information-theoretic sanitisation of what stands around them.

Base spans come from fixed patterns per kind (leftmost, non-overlapping; a match that fails its check is
dropped without another try). The corpus then tells which terms disclose that personal data is near: a
term's disclosure of a kind is its pointwise mutual information with the kind, as a share of all the
information there is in the kind (1: the term never occurs but beside it). Terms over the removal
threshold are removed; those over the lower one are generalised to a broader term of the corpus, one that
stands beside the same data nearly always and is commoner. Both only where they stand beside a base span;
documents without personal data are left alone. A term needs several different values of the kind as
evidence, so copies of one document prove nothing.

Defined results: null texts are empty; equal texts get equal verdicts; an empty table gives an empty
result; columns named as the results are replaced, all others stay. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import let, store

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: The patterns, in forms that never scan a run twice (a match can only begin where a run does).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
TERM_RE = r"\p{L}{3,}"
NEAR = 120
MIN_VALUES, GENERALISE, REMOVE, SUBSUMES = 3, 0.8, 0.95, 0.8


def running(values: Column) -> Column:
    """Sums of an array's elements up to each one, by doubling steps (a linear pass each)."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    step = lambda t, k: F.transform(t, lambda x, i: x + F.coalesce(F.get(t, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0)))
    return F.aggregate(steps, values, step)


def placed(text: Column, pattern: str, ok, near: int = 0) -> Column:
    """[(start, end, m)] of the matches for which ``ok`` holds; with ``near`` also the whole words within so many
    characters ``before`` and ``after`` a match, up to the next match of the pattern."""
    around = ",before:string,after:string" if near else ""
    none = F.array().cast(f"array<struct<start:int,end:int,m:string{around}>>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def head(gap: Column) -> Column:
        n = F.char_length(gap)
        return F.when(n <= near, gap).otherwise(F.regexp_replace(F.substr(gap, n - near + 1), r"^\p{L}+", ""))

    def tail(gap: Column) -> Column:
        return F.when(F.char_length(gap) <= near, gap).otherwise(F.regexp_replace(F.substr(gap, F.lit(1), F.lit(near)), r"\p{L}+$", ""))

    def all_of(m: Column) -> Column:
        good = F.filter(F.transform(m, lambda x, i: F.struct(x.alias("m"), i.alias("i"))), lambda s: ok(s["m"]))

        def positions(g: Column) -> Column:
            def where(gaps: Column) -> Column:
                steps = F.transform(gaps, lambda x, i: F.char_length(x) + F.coalesce(F.char_length(F.get(m, i - 1)), F.lit(0)))

                def one(at: Column):
                    def span(s: Column) -> Column:
                        start = F.get(at, s["i"])
                        more = [head(F.get(gaps, s["i"])).alias("before"), tail(F.get(gaps, s["i"] + 1)).alias("after")] if near else []
                        return F.struct(start.alias("start"), (start + F.char_length(s["m"])).alias("end"), s["m"].alias("m"), *more)

                    return span

                return let(running(steps), lambda at: F.transform(g, one(at)))

            return F.when(F.size(g) == 0, none).otherwise(let(F.split(text, pattern, -1), where))

        return let(good, positions)

    return F.when(text == "", none).otherwise(let(matches, all_of))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    def total(r: Column) -> Column:
        def step(t: Column, i: Column) -> Column:
            d = F.substr(r, i + 1, F.lit(1)).cast("int")
            return t + F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

        return F.aggregate(F.sequence(F.lit(0), F.char_length(r) - 1), F.lit(0), step)

    return let(F.reverse(_digits(m)), total) % 10 == 0


def of_kind(k: int):
    return lambda s: s["k"] == k


def base_spans(text: Column, near: int = 0) -> Column:
    """[(k, start, end, m)] by kind, then start; ``k`` counts in the order of KINDS. ``near`` as in ``placed``."""
    yes = lambda m: F.lit(True)
    n = lambda m: F.char_length(_digits(m))
    rules = (
        (text.contains("@"), EMAIL, yes),
        (text.rlike(r"[0-9]\.[0-9]"), IP, lambda m: F.forall(F.split(m, r"\."), lambda p: p.rlike(OCTET))),
        (text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), CARD, lambda m: n(m).between(16, 19) & _luhn(m)),
        (text.contains("+"), PHONE, lambda m: n(m).between(8, 15)),
    )
    fields = ("start", "end", "m", *(("before", "after") if near else ()))
    none = F.array().cast(f"array<struct<k:int,start:int,end:int,m:string{',before:string,after:string' if near else ''}>>")
    mark = lambda k: lambda s: F.struct(F.lit(k).alias("k"), *(s[f].alias(f) for f in fields))
    parts = [F.when(may, F.transform(placed(text, p, ok, near), mark(k))).otherwise(none) for k, (may, p, ok) in enumerate(rules)]
    return F.concat(*parts)


NEAR_TERMS = "array<struct<k:int,value:bigint,term:string,start:int,end:int>>"


def _near_terms(spans: Column) -> Column:
    """[(k, value, term, start, end)] of the terms beside each span."""

    def around(s: Column) -> Column:
        yes = lambda m: F.lit(True)
        mark = lambda off: lambda t: F.struct(s["k"].alias("k"), F.xxhash64(s["m"]).alias("value"), F.lower(t["m"]).alias("term"), (t["start"] + off).alias("start"), (t["end"] + off).alias("end"))
        left = F.transform(placed(s["before"], TERM_RE, yes), mark(s["start"] - F.char_length(s["before"])))
        return F.concat(left, F.transform(placed(s["after"], TERM_RE, yes), mark(s["end"])))

    return F.flatten(F.transform(spans, around))


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM_RE), F.lit(0)))


def _beside(found: DataFrame) -> DataFrame:
    """(id, k, value, term, start, end) of the terms beside personal data, for each span they stand beside."""
    return found.where(F.size("near") > 0).select("id", F.explode("near").alias("n")).select("id", "n.*")


def disclosure(docs: DataFrame, found: DataFrame, text: str, min_values: int = MIN_VALUES) -> DataFrame:
    """(k, term, share, n_near, n_docs): what part of the kind's information each well-evidenced term gives away.

    ``found`` has id, spans and near (of ``_scan``). Terms are counted in all documents before anything is
    joined, so a shuffle holds a term once per task that met it, however often the term occurs.
    """
    each = _beside(found)
    values = each.groupBy("k", "term", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("k", "term").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= min_values)
    terms = F.array_distinct(F.transform("near", lambda s: F.concat_ws(":", s["k"].cast("string"), s["term"])))
    rows = found.where(F.size("near") > 0).select(F.explode(terms).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_near"))
    rows = rows.select(F.substring_index("t", ":", 1).cast("int").alias("k"), F.substring_index("t", ":", -1).alias("term"), "n_near")
    beside = values.join(rows, ["k", "term"])
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # Outer: for a plain explode the terms would be found twice, to leave documents without any out before.
    within = docs.select(F.explode_outer(terms_of(body)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))
    kinds = found.select(*(F.exists("spans", of_kind(k)).cast("int").alias(f"k{k}") for k in range(len(KINDS))))
    counts = kinds.agg(F.count(F.lit(1)).alias("all"), *(F.sum(f"k{k}").alias(f"k{k}") for k in range(len(KINDS))))
    rates = counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col(f"k{k}") / F.nullif(F.col("all"), F.lit(0))).alias("p")) for k in range(len(KINDS))))).alias("r")).select("r.*")
    rates = rates.where((F.col("p") > 0) & (F.col("p") < 1))
    joined = beside.join(within, "term").join(F.broadcast(rates), "k")  # four rows at most
    given = F.least(F.lit(1.0), F.col("n_near") / F.col("n_docs"))
    return joined.select("k", "term", (F.log2(given / F.col("p")) / -F.log2("p")).alias("share"), "n_near", "n_docs")


def broader(found: DataFrame, shares: DataFrame, generalise: float, remove: float, subsumes: float = SUBSUMES) -> DataFrame:
    """(k, term, by) for terms to generalise: the most common harmless term that stands beside the same
    data in at least ``subsumes`` of the documents and is commoner than the term itself."""
    low = shares.where((F.col("share") >= generalise) & (F.col("share") < remove)).select("k", "term", F.col("n_near").alias("n"), F.col("n_docs").alias("own_docs"))
    harmless = shares.where(F.col("share") < generalise).select("k", F.col("term").alias("by"), F.col("n_docs").alias("by_docs"))
    each = _beside(found).select("id", "k", "value", "term")
    # A window holds few terms, so the pairs of one window are few.
    pairs = each.join(low.select("k", "term"), ["k", "term"]).join(each.withColumnRenamed("term", "by"), ["id", "k", "value"]).where(F.col("by") != F.col("term"))
    both = pairs.select("k", "term", "by", "id").distinct().groupBy("k", "term", "by").agg(F.count(F.lit(1)).alias("both"))
    fit = both.join(low, ["k", "term"]).join(harmless, ["k", "by"]).where((F.col("both") >= F.col("n") * subsumes) & (F.col("by_docs") > F.col("own_docs")))
    best = F.min(F.struct((-F.col("by_docs")).alias("d"), F.col("by").alias("by")))
    return fit.groupBy("k", "term").agg(best.alias("b")).select("k", "term", F.col("b.by").alias("by"))


SPANS, TERMS = "array<struct<k:int,start:int,end:int,m:string>>", "array<struct<start:int,end:int,action:string,by:string>>"


def _judged(docs: DataFrame, own: list[str], text: str, near: int, min_values: int, generalise: float, remove: float) -> DataFrame:
    """(row, base, terms): ``row`` holds the columns ``own``, so no name of theirs meets one of ours."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keep = F.struct(*(F.col(f"`{c}`") for c in own)) if own else F.lit(0)
    plain = F.transform("s", lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m")))
    terms = F.when(F.size("s") == 0, F.array().cast(NEAR_TERMS)).otherwise(_near_terms(F.col("s")))
    spanned = docs.select(keep.alias("row"), base_spans(body, near).alias("s"))
    found = store(spanned.select(F.monotonically_increasing_id().alias("id"), "row", plain.cast(SPANS).alias("spans"), terms.alias("near")), "spans")
    shares = store(disclosure(docs, found, text, min_values), "shares")
    strict = shares.where(F.col("share") >= generalise).select("k", "term", F.when(F.col("share") >= remove, F.lit("remove")).otherwise(F.lit("generalise")).alias("action"))
    strict = store(strict.join(broader(found, shares, generalise, remove), ["k", "term"], "left"), "terms")
    # By row, not by text: copies of one text do not meet in one task.
    marks = _beside(found).select("id", "k", "term", "start", "end").join(strict, ["k", "term"])
    marks = marks.groupBy("id", "start", "end").agg(F.max(F.struct("action", "by")).alias("a"))
    marks = marks.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "a.action", "a.by"))).alias("terms"))
    return found.join(marks, "id", "left").select("row", F.col("spans").alias("base"), F.coalesce("terms", F.array().cast(TERMS)).alias("terms"))


def find(docs: DataFrame, text: str = "text", near: int = NEAR, min_values: int = MIN_VALUES, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` without its text, with ``base`` and ``terms``: arrays of spans sorted by kind and start."""
    own = [c for c in docs.columns if c not in ("base", "terms", text)]
    out = _judged(docs, own, text, near, min_values, generalise, remove)
    return out.select(*(F.col("row")[c].alias(c) for c in own), "base", "terms")


def joined(spans: Column, terms: Column | None = None) -> Column:
    """kind:start:end, comma-joined."""
    kind = F.array(*(F.lit(k) for k in KINDS))
    texts = F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["k"]), s["start"].cast("string"), s["end"].cast("string")))
    if terms is not None:
        texts = F.concat(texts, F.transform(terms, lambda s: F.concat_ws(":", F.lit(TERM), s["start"].cast("string"), s["end"].cast("string"))))
    return F.array_join(texts, ",")


def redact(text: Column, spans: Column, terms: Column) -> Column:
    """The text with spans replaced by their kind, terms by a broader one ([TERM] where there is none) or by nothing;
    of overlapping spans the first counts."""
    kind = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    every = F.concat(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(kind, s["k"]).alias("by"))),
        F.transform(terms, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "remove", "").otherwise(F.coalesce(s["by"], F.lit("[TERM]"))).alias("by"))),
    )
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        more = F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), s["by"])
        return F.when(s["start"] < a["at"], a).otherwise(F.struct(more.alias("out"), s["end"].alias("at")))

    return F.aggregate(F.sort_array(every), zero, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))


def sanitise(docs: DataFrame, text: str = "text", near: int = NEAR, min_values: int = MIN_VALUES, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with the text sanitised."""
    out = _judged(docs, docs.columns, text, near, min_values, generalise, remove)
    clean = redact(F.col("row")[text], F.col("base"), F.col("terms"))
    return out.select(*((clean if c == text else F.col("row")[c]).alias(c) for c in docs.columns))
