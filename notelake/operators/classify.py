"""The candidate gate: two of four criteria or a shorthand signal, with pluggable scorers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_ws

CRITERIA = ("specific", "atomic", "clear", "timed")
Scorer = Callable[[Column], Column]

#: Default rules for the four criteria; callers may pass their own.
RULES: dict[str, Scorer] = {
    "specific": lambda t: t.rlike(r"(?i)\b(draft|send|write|review|fix|ship|book|call|prepare|update|schedule|publish|merge|submit)\b.*\S+"),
    "atomic": lambda t: ~t.rlike(r"(?i)\b(and|then|also)\b|;|&") & (F.size(F.split(trim_ws(t), r"\s+")) <= 14),
    "clear": lambda t: (F.size(F.split(trim_ws(t), r"\s+")) >= 3) & ~t.rlike(r"(?i)^\s*(it|this|that|stuff|things?)\b|\bws\d+\b"),
    "timed": lambda t: t.rlike(r"(?i)\b(today|tomorrow|eod|eow|by|before|until|mon|tue|wed|thu|fri|sat|sun)[a-z]*\b|\d{4}-\d{2}-\d{2}"),
}


def truncated(text: Column) -> Column:
    """Ends in a dash or comma: to be read again at its source."""
    return text.rlike(r"[-,–—]\s*$")


def score(df: DataFrame, text: str = "text", rules: dict[str, Scorer] | None = None) -> DataFrame:
    rules = RULES | (rules or {})
    return df.withColumns({c: rules[c](F.col(text)) for c in CRITERIA})


def gate(df: DataFrame, shorthand: Column | None = None, owner: Column | None = None, from_meeting: Column | None = None) -> DataFrame:
    """Adds n_criteria and kept. A meeting's candidate also needs an owner."""
    met = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in CRITERIA), F.lit(0))
    keep = (met >= 2) | F.coalesce(shorthand if shorthand is not None else F.lit(False), F.lit(False))
    if from_meeting is not None:
        keep = keep & (~F.coalesce(from_meeting, F.lit(False)) | (owner.isNotNull() if owner is not None else F.lit(False)))
    return df.withColumns({"n_criteria": met, "kept": keep})


def screened(gated: DataFrame, source: str = "source") -> DataFrame:
    """Per source: candidates and how many were kept."""
    return gated.groupBy(source).agg(F.count("*").alias("n_candidates"), F.count_if("kept").alias("n_kept"))


def all_of(*tests: Column) -> Column:
    """A gate all of whose questions must be answered yes; an unanswered one is no."""
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out
