"""How long scores stay unsettled: Kaplan and Meier's curve.

At each duration, those at risk are the rows with that duration or a longer
one. That is a sum from behind: inside ranges of durations by a window, and
between ranges by a window over one row a range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Durations of a range.
WIDTH = 65_536


def survival_curve(rows: DataFrame, by: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """(by, duration, at_risk, ended, censored, survival, error): a row for each duration of each
    group of the columns by, that occurs. survival is the share that outlasts it, error its standard
    error by Greenwood's formula, null where nothing survives.

    Rows have duration (a whole number) and ended (1, or 0 where the row was last seen unended at that
    duration: it is at risk up to there). Rows with a null in either are left out; a null in by
    is a value like others. Rows of a duration are summed before they are shuffled, so neither a hot
    duration nor a hot group is a hot task. An empty table gives none.
    """
    keys = [f"g{i}" for i in range(len(by))]
    known = rows.where("duration is not null and ended is not null").select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col("duration").cast("long").alias("t"), F.col("ended").cast("long").alias("d"))
    per = known.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d")).withColumn("range", F.floor(F.col("t") / width))
    behind = Window.partitionBy(*keys, "range").orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    later = Window.partitionBy(*keys).orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    ranges = apart(per.groupBy(*keys, "range").agg(F.sum("n").alias("own")).withColumn("later", F.coalesce(F.sum("own").over(later), F.lit(0))).drop("own"), keys)
    per = per.withColumn("risk", F.sum("n").over(behind))
    per = per.join(ranges, same(keys)).withColumn("r", F.col("risk") + F.col("later")).drop(*ranges.columns)
    # The product of shares as a sum of logarithms; all that is left ends at most once, at the very end.
    r, d = F.col("r").cast("double"), F.col("d").cast("double")
    per = per.withColumn("gone", (F.col("r") == F.col("d")).cast("int"))
    per = per.withColumn("log", F.when(F.col("gone") == 0, F.log1p(-d / r)).otherwise(0.0)).withColumn("part", F.when(F.col("gone") == 0, d / (r * (r - d))).otherwise(0.0))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    sums = per.groupBy(*keys, "range").agg(F.sum("log").alias("log"), F.sum("part").alias("part")).select(*keys, "range", F.coalesce(F.sum("log").over(before), none).alias("log_before"), F.coalesce(F.sum("part").over(before), none).alias("part_before"))
    so_far = Window.partitionBy(*keys, "range").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    scans = per.withColumn("log", F.sum("log").over(so_far)).withColumn("part", F.sum("part").over(so_far))
    told = scans.join(apart(sums, keys), same(keys))
    survival = F.when(F.col("gone") == 1, 0.0).otherwise(F.exp(F.col("log") + F.col("log_before")))
    error = F.when(F.col("gone") == 0, survival * F.sqrt(F.col("part") + F.col("part_before")))
    named = [F.col(k).alias(c) for c, k in zip(by, keys, strict=True)]
    return told.select(*named, F.col("t").alias("duration"), F.col("r").alias("at_risk"), F.col("d").alias("ended"), (F.col("n") - F.col("d")).alias("censored"), survival.alias("survival"), error.alias("error"))


def apart(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of ranges with other names for what they are joined by."""
    return ranges.withColumnsRenamed({c: f"of_{c}" for c in [*keys, "range"]})


def same(keys: list[str]) -> Column:
    return reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"of_{k}")), keys, F.col("range") == F.col("of_range"))
