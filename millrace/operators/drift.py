"""Drift of scores along time: cumulative sums of what they miss.

A sum that starts again at zero whenever it would fall below it is the running
total less its least value so far. Totals and least values of slices of time
combine, so a key's history is scanned slice by slice: inside each slice by a
window, and between slices by a window over one row a slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.calibration import settled


def drift(rows: DataFrame, key: str, time: str, per_one: int = 100, allowance: int = 0, limit: int | None = None, slice_seconds: int = 86_400 * 30) -> DataFrame:
    """(key, time, n, missed, up, down, alarm): a row for each time of each key, in units.

    missed is the sum of y less the score over the rows of that time, up the sum of missed less
    n times the allowance, started again at zero whenever it falls below, and down the same
    of what is missed to the other side. alarm says whether either is above the limit (null: false).
    Rows (units, y) with a null in either, or in time, are left out; a null key is a key. All rows
    of one time are one step, so ties and the order of rows don't matter, and they are summed before
    they are shuffled. Sums are of whole numbers. An empty table gives none.
    """
    own = settled(rows).where(F.col(time).isNotNull()).select(F.col(key).alias("k"), F.col(time).alias("t"), (F.col("y") * per_one - F.col("units")).alias("e"))
    steps = own.groupBy("k", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("missed"))
    steps = steps.withColumn("slice", F.floor(F.unix_seconds(F.col("t").cast("timestamp")) / slice_seconds))
    sides = {"up": F.col("missed") - F.col("n") * allowance, "down": -F.col("missed") - F.col("n") * allowance}
    so_far = Window.partitionBy("k", "slice").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    totals = steps.withColumns(sides).withColumns({f"{s}_total": F.sum(s).over(so_far) for s in sides})
    scans = totals.withColumns({f"{s}_least": F.min(f"{s}_total").over(so_far) for s in sides})
    per = [x for s in sides for x in (F.sum(s).alias(f"{s}_sum"), F.min(f"{s}_least").alias(f"{s}_low"))]
    slices = scans.groupBy(F.col("k").alias("of"), F.col("slice").alias("at")).agg(*per)
    before = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumns({f"{s}_base": F.coalesce(F.sum(f"{s}_sum").over(before), F.lit(0)) for s in sides})
    slices = slices.withColumns({f"{s}_floor": F.least(F.lit(0), F.min(F.col(f"{s}_base") + F.col(f"{s}_low")).over(before)) for s in sides})
    told = scans.join(slices, F.col("k").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at")))
    value = {s: F.col(f"{s}_base") + F.col(f"{s}_total") - F.least(f"{s}_floor", F.col(f"{s}_base") + F.col(f"{s}_least")) for s in sides}
    alarm = F.greatest("up", "down") > limit if limit is not None else F.lit(False)
    return told.withColumns(value).select(F.col("k").alias(key), F.col("t").alias(time), "n", "missed", "up", "down", alarm.alias("alarm"))

