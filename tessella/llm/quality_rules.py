"""Quality rules as a bitmask ledger.

``ledger`` measures every document once and sets one bit per rule that fails. Policies are
versioned masks over those bits, so a new policy, or the question what a rule alone rejects, reads
the ledger and never the texts. All columns are DataFrame expressions of one row: no shuffle.

Defined results: a null text measures like an empty one; an empty table gives an empty ledger; rows
are judged one by one, so repeated rows get equal results; columns that clash with the ledger's names
are replaced by the ledger's, all others stay.
Windows are compared by 64-bit hashes inside one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD_RE, carried, grams, let, split_words, unpacked

WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``failed`` is SQL over the measurements; ``bit`` never changes its meaning once published."""

    name: str
    bit: int
    failed: str


RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "4 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("word_length", 4, "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a document is kept if none of these rules failed."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        return sum(1 << r.bit for r in rules if r.name in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
V1 = Policy("v1", tuple(r.name for r in RULES))


def _repeat_words(words: Column, window: int) -> Column:
    """Words inside windows that occur twice or more in the same document."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(placed, starts), total))

    return let(grams(words, window), covered)


def measurements(text: Column, window: int = WINDOW) -> Column:
    """One struct of everything the rules look at."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(WORD_RE))
    by_words = let(
        split_words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w, window).cast("long").alias("n_repeat_words"),
        ),
    )
    by_lines = let(lines, lambda s: F.struct(F.size(s).cast("long").alias("n_lines"), (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines")))
    symbols = (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")
    return F.struct(by_words.alias("w"), by_lines.alias("l"), symbols.alias("n_symbols"))


NAMES = ("w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")
LEDGER = (*(n.rpartition(".")[2] for n in NAMES), "fail_bits")


def _measured(docs: DataFrame, row: Column, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, measurements, fail_bits)."""
    measured = docs.select(row, measurements(F.col(f"`{text}`")).alias("m"))
    flat = measured.select("row", *(F.col(f"m.{n}").alias(n.rpartition(".")[2]) for n in NAMES))
    bits = F.lit(0)
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)))
    return flat.withColumn("fail_bits", bits)


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measurements and ``fail_bits``; every rule is evaluated exactly once."""
    names, row = carried(docs, LEDGER)
    return _measured(docs, row, text, rules).select(*unpacked(names), *LEDGER)


def passing(docs: DataFrame, policy: Policy, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, all columns as they were."""
    names, row = carried(docs)
    return apply_policy(_measured(docs, row, text, rules), policy).where("kept").select(*unpacked(names))


def apply_policy(entries: DataFrame, policy: Policy, column: str = "kept", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return entries.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules))) == 0)


def ablate(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents it rejects, those that only it rejects, and what is kept without it.

    The ledger shrinks to one row per bit pattern first, so this costs one small aggregate.
    """
    mask = policy.mask(rules)
    patterns = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask))
    chosen = [r for r in rules if r.name in policy.rules]
    rule = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).alias("bit")) for r in chosen))).alias("r")
    rows = patterns.select("n", hit.alias("hit"), rule).select("n", "hit", "r.rule", "r.bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return rows.groupBy("rule").agg(
        total(F.col("hit").bitwiseAND(F.col("bit")) != 0).alias("rejected"),
        total(F.col("hit") == F.col("bit")).alias("rejected_alone"),
        total(F.col("hit").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
        F.bit_or("hit").alias("seen_bits"),
    )
