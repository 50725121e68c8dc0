"""Interval join: points in time with all intervals of their key that hold them.

Time is cut into buckets, coarser ones for longer intervals: an interval is
laid out in the finest buckets of which it touches no more than a few, and a
point in one bucket of every fineness that occurs. So a short interval never
meets points far away, a long one is a few rows and not thousands, and each
pair meets in exactly one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds of the finest bucket, how many times coarser the next is, and how many
#: buckets an interval touches (one more where it doesn't begin at a bucket's start).
FINEST, COARSER, TOUCHED = 3600, 4, 4
#: Microseconds at which an interval without end ends: the year 10000.
OPEN_END = 253_402_300_800_000_000
#: Finenesses: the coarsest bucket holds all of time.
LEVELS = 16


def micros(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str, finest: int = FINEST, touched: int = TOUCHED) -> DataFrame:
    """points' columns and then intervals' without key, a row for each point and each
    interval of its key with start <= time < end.

    An interval with a null end is valid without end, one with a null start or that ends no
    later than it starts holds nothing, and a null key or time matches nothing. Repeated
    points and intervals are rows each. The two sides' other columns must differ in name.
    Empty tables give none. Rows meet by key and bucket, so a hot key is spread over its time.
    """
    width = F.lit(finest * 1_000_000) * F.pow(F.lit(COARSER), F.col("level")).cast("long")
    first, last = micros(start), F.coalesce(micros(end), F.lit(OPEN_END)) - 1
    known = intervals.where(F.col(key).isNotNull() & (first <= last))
    length = last - first
    coarse = lambda k: F.lit(finest * 1_000_000 * touched * COARSER**k)
    # The first level whose buckets are wide enough; comparisons, as logarithms round.
    level = F.coalesce(*[F.when(length <= coarse(k), F.lit(k)) for k in range(LEVELS - 1)], F.lit(LEVELS - 1))
    rest = [c for c in intervals.columns if c != key]
    laid = known.select(F.col(key).alias("__key"), F.struct(*[F.col(f"`{c}`").alias(c) for c in rest]).alias("__interval"), first.alias("__first"), last.alias("__last"), level.alias("level"))
    levels = sorted(r["level"] for r in laid.select("level").distinct().collect())  # a few numbers
    laid = laid.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__first") / width), F.floor(F.col("__last") / width)))).withColumnRenamed("level", "__level")
    asked = points.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.struct("*").alias("__point"), F.col(key).alias("__own"), micros(time).alias("__at"))
    asked = asked.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    asked = asked.withColumn("__in", F.floor(F.col("__at") / width)).withColumnRenamed("level", "__of")
    meets = (F.col("__own") == F.col("__key")) & (F.col("__of") == F.col("__level")) & (F.col("__in") == F.col("__bucket")) & F.col("__at").between(F.col("__first"), F.col("__last"))
    return asked.join(laid, meets).select("__point.*", *[F.col("__interval").getField(c).alias(c) for c in rest])
