"""Bins of equal mass: exact quantiles of scores without sorting them.

Where a bin ends is found by refining histograms: rows are counted by coarse
ranges of scores, then, inside the ranges where a bound lies, by finer ones,
until a range is one score. Each step is a scan with a partial count, and
brings as many rows to the driver as there are bounds times cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import wilson
from millrace.operators.calibration import settled

#: Cells that a range is cut into.
CELLS = 1024


def mass_bounds(rows: DataFrame, bins: int = 10, cells: int = CELLS) -> list[int]:
    """The exact bounds of bins of equal mass of units: the k-th is the least score that,
    with those below it, has k of bins parts of the rows. Null scores are left out; rows of
    one score are never parted, so bounds may be equal. No rows, no bounds."""
    scores = rows.where("units is not null").select(F.col("units").cast("long").alias("u"))
    least, most, n = scores.agg(F.min("u"), F.max("u"), F.count("u")).first()
    if not n:
        return []
    # Each bound: how many rows the score looked for has at least, counted from the start of its range.
    want = {k: -(-k * n // bins) for k in range(1, bins)}
    start = dict.fromkeys(want, least)
    size = 1
    while size < most - least + 1:
        size *= cells
    while size > 1:
        finer = size // cells
        cell = F.floor((F.col("u") - least) / finer)
        inside = sorted({(s - least) // size for s in start.values()})
        counts = {r["cell"]: r["n"] for r in scores.where(F.floor((F.col("u") - least) / size).isin(inside)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for k in want:
            at = (start[k] - least) // finer
            while counts.get(at, 0) < want[k]:
                want[k] -= counts.get(at, 0)
                at += 1
            start[k] = least + at * finer
        size = finer
    return [start[k] for k in sorted(start)]


def mass_bin(units: Column, bounds: list[int]) -> Column:
    """The bin of a score, from 0: how many bounds lie below it. Bounds are few."""
    if not bounds:
        return F.when(units.isNotNull(), F.lit(0))
    return F.when(units.isNotNull(), F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < units)))


def equal_mass_bins(rows: DataFrame, bins: int = 10, per_one: int = 100, z: float = 1.96, cells: int = CELLS) -> DataFrame:
    """(bin, lowest, highest, n, hits, mean_score, rate, low, high): bins of as equal mass as
    scores allow, with Wilson's interval of the rate.

    Rows (units, y) with a null in either are left out, and repeated rows count each. Rows of
    one score are in one bin; where a score has more than a bin's share, bins are missing. An
    empty table has none.
    """
    known = settled(rows)
    per = known.groupBy(mass_bin(F.col("units"), mass_bounds(known, bins, cells)).alias("bin"))
    sums = per.agg(F.min("units").alias("lowest"), F.max("units").alias("highest"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"), F.sum("units").alias("sum_units"))
    n = F.col("n").cast("double")
    low, high = wilson(F.col("hits"), F.col("n"), z)
    return sums.select("bin", "lowest", "highest", "n", "hits", (F.col("sum_units") / (n * per_one)).alias("mean_score"), (F.col("hits") / n).alias("rate"), low.alias("low"), high.alias("high"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """One row for bins with n, mean_score and rate: n, the mean distance of rate and score
    over rows, and the largest over bins; null without bins."""
    off = F.abs(F.col("rate") - F.col("mean_score"))
    sums = bins.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(off * F.col("n")).alias("off"), F.max(off).alias("largest_error"))
    return sums.select("n", F.try_divide("off", F.col("n").cast("double")).alias("expected_error"), "largest_error")
