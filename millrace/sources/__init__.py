"""Tables as the rest of the library reads them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import outcome, units


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (units of 1/100, y, cluster): a mechanical stand-in for scored
    outcomes, made of lineitem. It exercises the operators and means nothing."""
    lines = table(spark, folder, "lineitem")
    return lines.select(units(F.col("l_discount"), 100).alias("units"), outcome(F.col("l_returnflag") == "R").alias("y"), F.col("l_suppkey").alias("cluster"))


#: Characters beyond which documents count as equally long.
TOP_LENGTH = 20_000


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (units of 1/TOP_LENGTH, y, cluster): lengths of labelled documents as scores of their
    quality, by source. A crude score, of which the outcomes are real labels."""
    documents = table(spark, folder, "documents").select("doc_id", F.least(F.col("n_chars"), F.lit(TOP_LENGTH)).alias("units"), F.col("source").alias("cluster"))
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("long").alias("y"))
    return documents.join(labels, "doc_id").select("units", "y", "cluster")


#: A price of lineitem that none reaches.
TOP_PRICE = 105_000


def priced_lines(spark: SparkSession, folder: str, step: int = 1) -> DataFrame:
    """Rows (units of step/TOP_PRICE, y, cluster): prices as scores, so that there are
    many distinct ones. As mechanical as scored_lines."""
    lines = table(spark, folder, "lineitem")
    return lines.select(F.floor(F.col("l_extendedprice") / step).cast("long").alias("units"), outcome(F.col("l_returnflag") == "R").alias("y"), F.col("l_suppkey").alias("cluster"))


def valid_views(spark: SparkSession, folder: str) -> DataFrame:
    """Views (view_id, user_id, valid_from, valid_to): a mechanical stand-in for quotes that are
    valid for a while, here for as long as their value says, some for ten days or without end."""
    views = table(spark, folder, "events").where("event_type = 'view'").select("event_id", "user_id", "ts", "value")
    seconds = F.expr("case when event_id % 250 < 5 then null when event_id % 100 < 5 then 864000 else floor(value * 360) end")
    return views.select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("valid_from"), (F.col("ts") + F.make_dt_interval(secs=seconds)).alias("valid_to"))


def of_kind(events: DataFrame, kind: str, *columns: Column) -> DataFrame:
    return events.where(F.col("event_type") == kind).select(*columns)


def viewed(events: DataFrame) -> DataFrame:
    """Views (view_id, user_id, viewed): a stand-in for scores that are settled later."""
    return of_kind(events, "view", F.col("event_id").alias("view_id"), F.col("user_id"), F.col("ts").cast("timestamp").alias("viewed"))


def bought(events: DataFrame) -> DataFrame:
    """Purchases (user_id, bought, amount): a stand-in for settlements."""
    return of_kind(events, "purchase", F.col("user_id"), F.col("ts").cast("timestamp").alias("bought"), F.col("value").alias("amount"))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    batch = table(spark, folder, "events")
    return spark.readStream.schema(batch.schema).parquet(f"{folder}/events.parquet*")


def event_times(spark: SparkSession, folder: str) -> DataFrame:
    """events with ts as an instant, which watermarks need."""
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/millrace-{uuid.uuid4().hex}"
