"""A calibration table that is kept up to date: sums by period and bin.

Sums of counts merge, so a period's rows are summed once and stored in a folder
of their own. When rows of a period arrive late, the period's sums are made anew
and replace its folder; no other period is read or written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.calibration import bin_sums, rates_of

KIND = "bin int, n long, hits long, sum_units long, period string"


def store_periods(rows: DataFrame, period: str, folder: str, width: int = 1) -> None:
    """Stores the sums of whole periods: rows (units, y) with a column that names the period.

    Each period that occurs in rows replaces what is stored of it, so rows must have all of a
    period's rows, the late ones with the others; storing the same again changes nothing. A period
    whose rows are all unsettled has no bins from then on. Periods without a name (null or
    empty) are one. Other periods stay as they are. No rows, no change.
    """
    name = F.nullif(F.col(period).cast("string"), F.lit("")).alias("period")
    sums = bin_sums(rows, width, [name])
    # A row without a bin stands for the period itself, so that it is replaced in any case.
    none = rows.select(name).distinct().selectExpr("period", "cast(null as int) as bin", "0L as n", "0L as hits", "0L as sum_units")
    # A period's bins are few: one file each.
    sums.unionByName(none).repartition("period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(folder)


def stored_rates(spark: SparkSession, folder: str, per_one: int = 100, z: float = 1.96, since: str | None = None, until: str | None = None) -> DataFrame:
    """bin_rates of all rows stored, or of the periods from since to until (by name, both
    included, which leaves out the null one): only those folders are read."""
    stored = spark.read.schema(KIND).parquet(folder).where("bin is not null")
    if since is not None:
        stored = stored.where(F.col("period") >= since)
    if until is not None:
        stored = stored.where(F.col("period") <= until)
    return rates_of(stored.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "sum_units")]), per_one, z)
