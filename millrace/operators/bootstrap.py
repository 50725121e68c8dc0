"""Bootstrap intervals for rows that depend on each other within clusters.

Whole clusters are drawn again. Instead of drawing them in turn, each cluster
has in each replicate a number of copies with Poisson's distribution of mean
one, by a digest of seed and cluster: all replicates come of one pass, a row
needs nothing of other clusters, and reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.calibration import settled


def poisson_steps(bits: int = 32) -> list[int]:
    """Of 2^bits equally likely draws, those below the k-th step stand for k copies at most."""
    steps, share, total = [], math.exp(-1), 0.0
    for k in range(1, 64):
        total += share
        share /= k
        step = math.floor(total * 2**bits)
        if steps and step == steps[-1]:
            break
        steps.append(step)
    return steps


def copies(name: Column, replicates: int, seed: int) -> Column:
    """How often a cluster is drawn in each replicate: an array. One digest has four draws."""
    digests = [F.md5(F.concat(F.lit(f"{seed}:{k}:"), name)) for k in range(-(-replicates // 4))]
    draws = F.flatten(F.transform(F.array(*digests), lambda d: F.array(*[F.conv(F.substring(d, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])))
    steps = F.array(*[F.lit(s).cast("long") for s in poisson_steps()])
    return F.transform(F.slice(draws, 1, replicates), lambda x: F.size(F.filter(steps, lambda s: s <= x)))


def bootstrap_intervals(rows: DataFrame, per_one: int = 100, replicates: int = 200, level: float = 0.95, seed: int = 7) -> DataFrame:
    """(statistic, estimate, low, high, replicates): mean_error (of y less the score), rate
    (of y) and brier, each with the percentiles of its replicates that hold level between them.

    Rows (units, y, cluster) with null units or y are left out; those of a null cluster are one
    cluster. A cluster is summed to one row first, before the shuffle where that is possible,
    so a hot one is no hot task; each row then makes a row a replicate, which are summed where
    they arise. Replicates that draw no cluster at all have no value and aren't counted. Empty
    tables give nulls.
    """
    known = settled(rows).withColumn("e", F.col("y") * per_one - F.col("units"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    sums = {"n": F.lit(1).cast("long"), "e": F.col("e"), "y": F.col("y"), "ee": F.col("e") * F.col("e")}
    clusters = known.groupBy("cluster").agg(*[F.sum(x).cast("decimal(38,0)").alias(k) for k, x in sums.items()])
    name = F.coalesce(F.concat(F.lit("="), F.col("cluster").cast("string")), F.lit("null"))
    drawn = clusters.select(*sums, F.posexplode(copies(name, replicates, seed)).alias("replicate", "w")).where("w > 0")
    per = drawn.groupBy("replicate").agg(*[F.sum(big("w") * big(k)).alias(k) for k in sums])
    whole = clusters.agg(*[F.sum(k).alias(k) for k in sums]).withColumn("replicate", F.lit(-1))
    n = F.col("n").cast("double")
    values = {"mean_error": F.col("e").cast("double") / (n * per_one), "rate": F.col("y").cast("double") / n, "brier": F.col("ee").cast("double") / (n * per_one * per_one)}
    each = per.select("replicate", *sums).unionByName(whole).select("replicate", F.explode(F.array(*[F.struct(F.lit(k).alias("statistic"), x.alias("value")) for k, x in values.items()])).alias("s")).select("replicate", "s.*")
    # A group has a row a replicate.
    group = each.groupBy("statistic").agg(F.max(F.when(F.col("replicate") < 0, F.col("value"))).alias("estimate"), F.sort_array(F.collect_list(F.when(F.col("replicate") >= 0, F.col("value")))).alias("v"))
    tail = (1 - level) / 2
    # Rounded, as 0.05 / 2 of 200 is a little more than 5 in doubles.
    at = lambda p: F.get("v", F.greatest(F.lit(0), F.ceil(F.round(F.size("v") * F.lit(p), 6)) - 1).cast("int"))
    return group.select("statistic", "estimate", at(tail).alias("low"), at(1 - tail).alias("high"), F.size("v").cast("long").alias("replicates"))
