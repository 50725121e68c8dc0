"""Column expressions for scores in [0, 1] and outcomes of 0 or 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def units(score: Column, per_one: int) -> Column:
    """A score as a whole number of parts, so that sums are exact."""
    return F.round(score * per_one).cast("long")


def outcome(condition: Column) -> Column:
    """1 where true, 0 where false, null where unknown."""
    return condition.cast("int").cast("long")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Both ends of Wilson's interval for a rate of hits in n; null without rows."""
    k, m = hits.cast("double"), n.cast("double")
    rate = F.try_divide(k, m)
    middle = F.try_divide(rate + F.lit(z * z) / (2 * m), 1 + F.lit(z * z) / m)
    half = F.try_divide(F.lit(z) * F.sqrt(rate * (1 - rate) / m + F.lit(z * z) / (4 * m * m)), 1 + F.lit(z * z) / m)
    low, high = middle - half, middle + half
    return F.when(n > 0, F.greatest(F.lit(0.0), low)), F.when(n > 0, F.least(F.lit(1.0), high))


def payoff(p: Column, y: Column) -> Column:
    """What a stake of one at price p returns on average when it pays y, less the stake."""
    return F.try_divide(y - p, p)
