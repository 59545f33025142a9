"""What to do with an answer: failure kinds, refusals, verifier decisions, routing, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------------------------------

REFUSALS = (
    r"not (?:mentioned|stated|provided|available|specified|discussed|in the (?:conversation|context|memory))", r"no (?:information|mention|record|details|evidence)", r"cannot (?:be )?(?:determined|answered|inferred)",
    r"unable to (?:determine|answer|find)", r"i (?:don't|do not) (?:know|have)", r"insufficient (?:information|context|evidence)", r"unknown|unclear",
    r"не (?:упомина|сказан|указан|обсужда)", r"нет (?:информации|данных|упоминан)", r"не знаю|неизвестно",
)
NO_ANSWER = r"no information|not (?:mentioned|enough|provided)|cannot|unknown|none"
#: Thresholds by category of question, and the shares of them that still count.
THRESHOLDS = {"single-hop": 0.40, "single": 0.40, "multi-hop": 0.50, "multi": 0.50, "temporal": 0.45, "temp": 0.45, "open-domain": 0.40, "open": 0.40, "adversarial": 0.70, "adv": 0.70}
DEFAULT_THRESHOLD, CAVEAT, HYBRID, VETO = 0.45, 0.7, 0.5, 0.7
#: Verifier: strict and calibrated thresholds.
CONTRADICTS, ENTAILS = 0.6, 0.5
CALIBRATED = {"entail": 0.65, "contradict": 0.40, "margin": 0.0}
MAX_REGRESSION, SLOWER = 0.01, 0.25

# --- expressions -------------------------------------------------------------------------------------


def is_refusal(text: Column) -> Column:
    return (F.coalesce(text, F.lit("")) == "") | F.coalesce(text.rlike(rf"(?iU)\b(?:{'|'.join(REFUSALS)})\b"), F.lit(False))


def expects_no_answer(gold: Column) -> Column:
    return (F.coalesce(gold, F.lit("")) == "") | F.coalesce(gold.rlike(rf"(?iU)\b(?:{NO_ANSWER})\b"), F.lit(False))


def plain(text: Column) -> Column:
    """Lower case, word characters only, single spaces."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def same_content(answer: Column, gold: Column) -> Column:
    """Equal but for the surface, or one inside the other and at least half as long."""
    a, g = plain(answer), plain(gold)
    short, long = F.least(F.length(a), F.length(g)), F.greatest(F.length(a), F.length(g))
    inside = (F.contains(a, g) | F.contains(g, a)) & (short * 2 >= long)
    return (a != "") & (g != "") & ((a == g) | inside)


def failure_kind(answer: Column, gold: Column, retrieved: Column, f1: Column, rouge: Column) -> Column:
    """The first that fits: retrieval_miss, over_cautious, format_drift, judge_disagree, hallucination, unknown."""
    refuses = is_refusal(answer)
    return (
        F.when(~F.coalesce(retrieved > 0, F.lit(False)), "retrieval_miss")
        .when(refuses & ~expects_no_answer(gold), "over_cautious")
        .when(same_content(answer, gold), "format_drift")
        .when((F.coalesce(f1, F.lit(0.0)) >= 0.6) | (F.coalesce(rouge, F.lit(0.0)) >= 0.6), "judge_disagree")
        .when(~refuses, "hallucination")
        .otherwise("unknown")
    )


def run_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(question, gold, change): answers (question, gold, correct) that a run lost or gained against another one."""
    both = before.select("question", "gold", F.col("correct").alias("was")).join(after.select("question", "gold", "correct"), ["question", "gold"])
    return both.where(F.col("was") != F.col("correct")).select("question", "gold", F.when(F.col("correct"), "gain").otherwise("regression").alias("change"))


def verified(entail: Column, neutral: Column, contradict: Column, calibration: dict | None = None) -> Column:
    """entail, neutral or contradict, from aggregated probabilities; with a calibration its thresholds and margin."""
    if calibration is None:
        against, least = contradict > CONTRADICTS, ENTAILS
    else:
        against, least = (contradict >= calibration["contradict"]) & (contradict - entail >= calibration["margin"]), calibration["entail"]
    return F.when(against, "contradict").when((entail >= least) & (entail >= neutral) & (entail >= contradict), "entail").otherwise("neutral")


def route(decision: Column, contradict: Column, contradiction: Column, p: Column, category: Column, answerable: Column, partial: Column, rounds: Column, most: Column) -> Column:
    """What to do: idk, answer, answer_with_caveat, hybrid or search_more, in the order of the rules."""
    low = F.lower(F.btrim(F.coalesce(category, F.lit(""))))
    t = F.lit(DEFAULT_THRESHOLD)
    for name, value in THRESHOLDS.items():
        t = F.when(low == name, value).otherwise(t)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return (
        F.when((decision == "contradict") & (contradict >= VETO), "idk")
        .when(contradiction, "idk")
        .when(answerable & (p >= t), "answer")
        .when(partial & (p >= t * CAVEAT), "answer_with_caveat")
        .when(low.isin("open-domain", "open") & answerable & (p >= t * HYBRID) & (p < t), "hybrid")
        .when(rounds < most, "search_more")
        .otherwise("idk")
    )


def gate(baseline: Column, current: Column, slow: Column, now: Column) -> Column:
    """(verdict, warning): whether recall held, and whether latency grew by a quarter."""
    return F.struct(F.when(current - baseline >= -MAX_REGRESSION, "PASS").otherwise("FAIL").alias("verdict"), ((slow > 0) & (now - slow >= slow * SLOWER)).alias("warning"))
