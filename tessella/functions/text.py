"""Scalar text functions as Column expressions."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIVATE = r"(?s)<private>.*?</private>"


def let(value: Column, body) -> Column:
    """``body`` of ``value`` evaluated once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"[ \t\n\r\f]+", -1), lambda w: w != "")


def tokens(text: Column, least: int = 1) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"[a-z0-9_]{{{least},}}"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", ""), r"[ \t\n\r\f]+", " ")


def redact_private(text: Column) -> Column:
    return F.regexp_replace(text, PRIVATE, "[REDACTED]")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 if one is less than half as long as the other."""
    long, short = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    return F.when(long == 0, 1.0).when((long - short) * 2 > long, 0.0).otherwise(1.0 - F.levenshtein(a, b) / long)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks; sequential by nature, so a vectorised UDF."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def ratio_over(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """``sequence_ratio`` where it may reach ``least``; elsewhere 0, by its upper bounds."""

    def one(x: str | None, y: str | None, floor: float) -> float:
        m = difflib.SequenceMatcher(None, x or "", y or "")
        return m.ratio() if m.real_quick_ratio() >= floor and m.quick_ratio() >= floor else 0.0

    return pd.Series([one(*r) for r in zip(a, b, least, strict=True)], dtype=float)


@F.pandas_udf(T.BooleanType())
def like_itself(a: pd.Series, least: pd.Series) -> pd.Series:
    """Whether a text's sequence ratio to a copy is over ``least``: long texts of frequent characters only match nothing."""
    return pd.Series([len(x or "") < 200 or difflib.SequenceMatcher(None, x, x).ratio() > f for x, f in zip(a, least, strict=True)], dtype=bool)


@F.pandas_udf(T.StringType())
def folded(a: pd.Series) -> pd.Series:
    """Lower case without accents."""
    return a.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c)))


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and tags go, entities of the five basic kinds are decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(?:script|style|noscript)>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return F.btrim(F.regexp_replace(t, r"[ \t\n\r\f]+", " "))


def verbosity(q: Column) -> Column:
    """full for paths, addresses, symbols and long queries; compact for at most three words; else summary."""
    n = F.size(words(q))
    exact = q.rlike(r"https?://|[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+|:[0-9]+|[A-Za-z_]+\(\)")
    return F.when(exact | (n >= 10), "full").when(n <= 3, "compact").otherwise("summary")


def score_label(x: Column) -> Column:
    """Contradiction score to label."""
    return F.when(x >= 0.60, "hard").when(x >= 0.30, "soft").otherwise("none")
