"""How well scores rank outcomes: the exact area under the ROC curve.

The area is the share of pairs of a row with y = 1 and one with y = 0 in which
the former scores higher, ties counting half. Pairs aren't formed: rows are
summed by score, and how many negatives lie below a score is a running sum
inside a range of scores plus the sums of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.calibration import settled

#: Scores of a range.
WIDTH = 65_536


def whole(c: str | Column) -> Column:
    """A whole number of up to 38 digits: sums of products stay exact."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def exact_auc(rows: DataFrame, by: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """(by, n_pos, n_neg, auc, auc_error): a row for each group of the columns by, or one
    for all rows. auc_error is DeLong's standard error. auc is null where a group has only
    one outcome, auc_error where it has fewer than two of either.

    Rows (units, y) with a null in either are left out; a null in by is a value like others.
    All sums are of whole numbers, so results don't depend on order. Rows of a score are summed
    before they are shuffled: a hot score, or a hot group, is as many rows as it has scores. A
    window holds the scores of one range, or a row for each range of a group. An empty table
    gives one row without by, none with.
    """
    keys = [f"g{i}" for i in range(len(by))]
    own = settled(rows).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], "units", "y")
    scores = own.groupBy(*keys, "units").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).withColumn("range", F.floor(F.col("units") / width))
    up = Window.partitionBy(*keys, "range").orderBy("units").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys, "range").orderBy("units").rowsBetween(1, Window.unboundedFollowing)
    # Of a score: twice the negatives below it and those that tie, twice the positives above and those that tie.
    scores = scores.withColumn("a", whole(2 * F.coalesce(F.sum("neg").over(up), F.lit(0)) + F.col("neg"))).withColumn("b", whole(2 * F.coalesce(F.sum("pos").over(down), F.lit(0)) + F.col("pos")))
    p, q = whole("pos"), whole("neg")
    sums = {"p": p, "q": q, "pa": p * F.col("a"), "paa": whole(p * F.col("a")) * F.col("a"), "qb": q * F.col("b"), "qbb": whole(q * F.col("b")) * F.col("b")}
    ranges = scores.groupBy(*keys, "range").agg(*[whole(F.sum(whole(x))).alias(k) for k, x in sums.items()])
    ahead = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    none = F.lit(0).cast("decimal(38,0)")
    ranges = ranges.withColumn("u", whole(2 * F.coalesce(F.sum("q").over(ahead), none))).withColumn("v", whole(2 * F.coalesce(F.sum("p").over(behind), none)))
    c = F.col
    moved = {
        "p": c("p"),
        "q": c("q"),
        "pa": c("pa") + whole(c("u") * c("p")),
        "paa": c("paa") + 2 * whole(c("u") * c("pa")) + whole(whole(c("u") * c("u")) * c("p")),
        "qbb": c("qbb") + 2 * whole(c("v") * c("qb")) + whole(whole(c("v") * c("v")) * c("q")),
    }
    per = ranges.groupBy(*keys).agg(*[F.coalesce(F.sum(whole(x)), none).alias(k) for k, x in moved.items()])
    per = per.select(*keys, *[c(k).cast("double").alias(k) for k in moved])
    # pa counts each pair twice.
    auc = F.try_divide(c("pa"), 2 * c("p") * c("q"))
    over_pos = F.try_divide(c("paa") / (4 * F.nullif(c("q"), F.lit(0.0)) * c("q")) - c("p") * auc * auc, c("p") - 1)
    over_neg = F.try_divide(c("qbb") / (4 * F.nullif(c("p"), F.lit(0.0)) * c("p")) - c("q") * auc * auc, c("q") - 1)
    error = F.sqrt(F.greatest(F.lit(0.0), over_pos / F.nullif(c("p"), F.lit(0.0)) + over_neg / F.nullif(c("q"), F.lit(0.0))))
    named = [c(k).alias(n) for n, k in zip(by, keys, strict=True)]
    return per.select(*named, c("p").cast("long").alias("n_pos"), c("q").cast("long").alias("n_neg"), auc.alias("auc"), F.when((c("p") > 1) & (c("q") > 1), error).alias("auc_error"))
