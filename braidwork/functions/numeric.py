"""Scalar numeric functions, as Column expressions that hold under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def midpoint(start: Column, stop: Column) -> Column:
    return F.least(start, stop) + 0.5 * F.abs(start - stop)


def evalue_score(evalue: Column, default: float = 1.0) -> Column:
    """-ln of a positive E-value; the default for none and for zero or less."""
    return F.when(evalue > 0, -F.ln(evalue)).otherwise(F.lit(default))


def parsed_evalue(text: Column) -> Column:
    """-1 for what is no number."""
    return F.coalesce(text.try_cast("double"), F.lit(-1.0))


def smoothed_cost(probability: Column, prior: Column, gamma: float = 0.8, nothing: float = 1e13) -> Column:
    """-ln of a probability smoothed by a prior; ``nothing`` where that is zero."""
    p = gamma * probability + (1 - gamma) * prior
    return F.when(p > 0, -F.ln(p)).otherwise(F.lit(nothing))


def decay(distance: Column, largest: Column, gamma: float = 1.0) -> Column:
    """exp(-gamma * distance / largest); 1 where nothing is apart."""
    return F.when(largest > 0, F.exp(-gamma * F.try_divide(distance, largest))).otherwise(F.lit(1.0))


def entropy(counts: Column, epsilon: float = 1e-10) -> Column:
    """Shannon entropy (nats) of an array of counts, each smoothed by ``epsilon``; tiny values are 0."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x + epsilon)
    h = F.aggregate(counts, F.lit(0.0), lambda a, x: a - ((x + epsilon) / total) * F.ln((x + epsilon) / total))
    return F.when(F.abs(h) < epsilon, F.lit(0.0)).otherwise(h)
