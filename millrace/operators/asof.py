"""As-of join: each left row with the last right row of its key up to its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], slice_seconds: int = 86_400) -> DataFrame:
    """left's columns with values of the last right row of the same key whose time
    isn't later, and its time as <time>_right; nulls where there is none.

    Of right rows of one time the largest (by values, in their order) counts. A
    null key or time matches nothing, and such rows are in no group. A key's history is cut into slices of time,
    so a key with very many rows is many groups; what a slice inherits is the
    last row of the slices before it, found over one row a slice.
    """
    at = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / slice_seconds)
    kept = F.struct(F.col(time).alias("t"), *[F.col(v).alias(v) for v in values])
    known = F.col(key).isNotNull() & F.col(time).isNotNull()
    right, apart, left = right.where(known), left.where(~known), left.where(known)
    quotes = right.select(F.col(key).alias("k"), at.alias("slice"), F.col(time).alias("t"), F.lit(0).alias("side"), kept.alias("quote"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("row"))
    asks = left.select(F.col(key).alias("k"), at.alias("slice"), F.col(time).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(quotes.schema["quote"].dataType).alias("quote"), F.struct("*").alias("row"))
    last = quotes.groupBy("k", "slice").agg(F.max("quote").alias("last"))
    slices = last.unionByName(asks.groupBy("k", "slice").agg(F.max("quote").alias("last"))).groupBy("k", "slice").agg(F.max("last").alias("last"))
    before = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    inherited = slices.select("k", "slice", F.last("last", ignorenulls=True).over(before).alias("inherited"))
    within = Window.partitionBy("k", "slice").orderBy("t", "side", "quote").rowsBetween(Window.unboundedPreceding, 0)
    seen = quotes.unionByName(asks).withColumn("seen", F.last("quote", ignorenulls=True).over(within)).where("side = 1")
    joined = seen.join(inherited, ["k", "slice"], "left").withColumn("q", F.coalesce("seen", "inherited"))
    found = joined.select("row.*", F.col("q.t").alias(f"{time}_right"), *[F.col(f"q.{v}").alias(v) for v in values])
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields[len(left.columns) :]]
    return found.unionAll(apart.select("*", *none))
