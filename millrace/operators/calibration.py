"""How well scores match observed outcomes.

Rows have units (a score as a whole number of 1/per_one) and y (0, 1, or null
where unsettled). Rows with a null in either are left out. All sums are sums of
whole numbers, taken per partition before the shuffle, so results don't depend
on the order of rows and a hot score is no hot task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import payoff, wilson


def settled(rows: DataFrame) -> DataFrame:
    return rows.where("units is not null and y is not null")


def bin_sums(rows: DataFrame, width: int = 1, by: Sequence[Column] = ()) -> DataFrame:
    """(by, bin, n, hits, sum_units) for each bin of width units: sums that merge."""
    bins = settled(rows).groupBy(*by, F.floor(F.col("units") / width).cast("int").alias("bin"))
    return bins.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"), F.sum("units").alias("sum_units"))


def rates_of(sums: DataFrame, per_one: int = 100, z: float = 1.96) -> DataFrame:
    """The measures of bin_rates of bin_sums' rows."""
    n = F.col("n").cast("double")
    low, high = wilson(F.col("hits"), F.col("n"), z)
    sums = sums.withColumn("mean_score", F.col("sum_units") / (n * per_one)).withColumn("rate", F.col("hits") / n)
    return sums.select("bin", "n", "hits", "mean_score", "rate", low.alias("low"), high.alias("high"), payoff(F.col("mean_score"), F.col("rate")).alias("mean_payoff"))


def bin_rates(rows: DataFrame, per_one: int = 100, width: int = 1, z: float = 1.96) -> DataFrame:
    """A row for each bin of width units: n, hits, mean score, rate, Wilson's
    interval of the rate, and the mean payoff of a unit stake at the mean score."""
    return rates_of(bin_sums(rows, width), per_one, z)


def line_fit(rows: DataFrame, per_one: int = 100) -> DataFrame:
    """One row: the least-squares line of y on the score, its r2 and the slope's
    standard error; null where scores don't differ."""
    # Sums and their products are exact: differences of large ones keep their digits.
    s = settled(rows).agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("decimal(38,0)").alias(k) for k, x in (("n", F.lit(1)), ("x", F.col("units")), ("y", F.col("y")), ("xx", F.col("units") * F.col("units")), ("xy", F.col("units") * F.col("y")))])
    sxx, sxy, syy = "(n * xx - x * x)", "(n * xy - x * y)", "(n * y - y * y)"
    s = s.selectExpr(*[f"cast({x} as double) as {k}" for k, x in (("n", "n"), ("x", "x"), ("y", "y"), ("sxx", sxx), ("sxy", sxy), ("syy", syy))])
    slope = F.expr(f"try_divide(sxy, sxx) * {per_one}")
    return s.select(
        F.col("n").cast("long").alias("n"),
        slope.alias("slope"),
        F.expr("try_divide(y, n) - try_divide(sxy, sxx) * try_divide(x, n)").alias("intercept"),
        F.expr("try_divide(sxy * sxy, sxx * syy)").alias("r2"),
        F.expr(f"case when n > 2 then sqrt(greatest(0D, try_divide(syy - try_divide(sxy * sxy, sxx), (n - 2) * sxx))) * {per_one} end").alias("slope_error"),
    )


def brier_parts(rows: DataFrame, per_one: int = 100) -> DataFrame:
    """One row: the Brier score and its parts by distinct score, so that
    brier = reliability - resolution + uncertainty."""
    per = settled(rows).groupBy("units").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"))
    u, n, k = F.col("units").cast("double") / per_one, F.col("n").cast("double"), F.col("hits").cast("double")
    sums = per.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum(k * (1 - u) * (1 - u) + (n - k) * u * u).alias("loss"), F.sum(n * (u - k / n) * (u - k / n)).alias("off"), F.sum(k * k / n).alias("kk"))
    m, h = F.col("n").cast("double"), F.col("hits").cast("double")
    base = F.try_divide(h, m)
    return sums.select(F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(F.col("loss"), m).alias("brier"), F.try_divide(F.col("off"), m).alias("reliability"), (F.try_divide(F.col("kk"), m) - base * base).alias("resolution"), (base * (1 - base)).alias("uncertainty"))


def cluster_error(rows: DataFrame, per_one: int = 100) -> DataFrame:
    """One row: the mean of y less the score, with its standard error if rows are
    independent and if only clusters are. Rows of a null cluster are one."""
    rows = settled(rows).withColumn("e", F.col("y") * per_one - F.col("units"))
    per = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("e"), F.sum(F.col("e") * F.col("e")).alias("ee"))
    # Sums of whole numbers: no rounding before the last step.
    big = lambda c: F.col(c).cast("decimal(38,0)")
    s = per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("clusters"), F.sum("e").alias("e"), F.sum("ee").alias("ee"), F.sum(big("e") * big("e")).alias("c0"), F.sum(big("e") * big("n")).alias("c1"), F.sum(big("n") * big("n")).alias("c2"))
    s = s.select("clusters", *[F.col(c).cast("double").alias(c) for c in ("n", "e", "ee", "c0", "c1", "c2")])
    mean = F.try_divide(F.col("e"), F.col("n"))
    return s.select(
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        "clusters",
        (mean / per_one).alias("mean_error"),
        (F.try_divide(F.sqrt(F.col("ee") - F.col("n") * mean * mean), F.col("n")) / per_one).alias("plain_error"),
        (F.try_divide(F.sqrt(F.col("c0") - 2 * mean * F.col("c1") + mean * mean * F.col("c2")), F.col("n")) / per_one).alias("robust_error"),
    )
