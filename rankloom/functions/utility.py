"""Utility of judged items from six labels of 1 to 7, grades and quantised labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the labels in the two formulas, and the cap of unsafe items.
WEIGHTS = {"label_relevance": 0.25, "label_usefulness": 0.30, "label_actionability": 0.15, "label_novelty": 0.10, "label_resonance": 0.10, "label_safety": 0.10}
WEIGHTS_FIVE = {"label_relevance": 0.30, "label_usefulness": 0.30, "label_actionability": 0.15, "label_novelty": 0.15, "label_resonance": 0.10}
CAP, UNSAFE = 2.0, 2


def linear(weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum of the labels; null if one is missing."""
    return sum((F.col(c).cast("double") * w for c, w in list(weights.items())[1:]), F.col(next(iter(weights))).cast("double") * next(iter(weights.values())))


def utility(weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted sum, no more than CAP where safety is at most UNSAFE."""
    value = linear(weights)
    return F.when(value.isNotNull() & (F.col("label_safety") <= UNSAFE), F.least(value, F.lit(CAP))).otherwise(value)


def clamp_score(c: Column) -> Column:
    """Rounded half to even and cut to 1 to 7; 1 where it is no number."""
    d = c.cast("string").try_cast("double")
    return F.when(d.isNull() | F.isnan(d), 1).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(7.0), F.rint(d))).cast("int"))


def grade(c: Column) -> Column:
    """A utility as a grade of 0 to 6; null for null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(6.0), F.rint(c) - 1)).cast("int"))


def graded(c: Column, scale: float = 1.0) -> Column:
    return F.rint((c - 1) * scale).cast("int")


def parse_judgment(text: Column, labels: list[str]) -> Column:
    """A struct of the labels from a judge's answer: JSON, JSON inside other text, or bare "name": number pairs; null
    where nothing is found."""
    schema = ", ".join(f"{x} double" for x in labels)
    whole = F.from_json(text, schema)
    inner = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)
    bare = F.struct(*[F.nullif(F.regexp_extract(text, rf'"?{x}"?\s*:\s*"?(-?\d+(?:\.\d+)?)', 1), F.lit("")).cast("double").alias(x) for x in labels])
    some = lambda s: F.coalesce(*[s[x] for x in labels]).isNotNull()
    return F.when(some(whole), whole).when(some(inner), inner).when(some(bare), bare)
