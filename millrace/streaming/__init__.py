"""Running measures over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_rates(stream: DataFrame, time: str, y: F.Column, window: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """(start, n, hits) by window of a stream's time: rows, and those with y = 1.

    Rows later than the watermark allows are dropped in append and update mode,
    where a window is emitted, or is final, once the watermark passes its end.
    The same call on a batch gives the same windows.
    """
    watched = stream.withWatermark(time, late) if stream.isStreaming else stream
    windows = watched.groupBy(F.window(time, window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(y), F.lit(0)).alias("hits"))
    return windows.select(F.col("w.start").alias("start"), "n", "hits")


def latest_windows(rates: DataFrame, folder: str) -> DataFrame:
    """The windows of running_rates over a stream, read to the end of what is there now:
    the last that each batch said of them.

    Batches are written in update mode to a folder that all executors share, each to a
    place of its own, so that a repeated batch replaces itself, and the watermark
    evicts windows that are final.
    """
    spark = rates.sparkSession
    spark.createDataFrame([], rates.schema).write.parquet(f"{folder}/windows/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/windows/batch={number}")

    rates.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    said = spark.read.option("basePath", f"{folder}/windows").parquet(f"{folder}/windows")
    return said.groupBy("start").agg(F.max_by(F.struct("n", "hits"), "batch").alias("w")).select("start", "w.*")
