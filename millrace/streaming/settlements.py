"""Scores and their late settlements: a join of two streams, and an as-of join on one."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType


def settle(scores: DataFrame, settlements: DataFrame, key: str, scored: str, settled: str, within: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """scores' columns and settlements' (but its key): a row for each score and each settlement of
    its key from the score's time (column scored) to `within` later, both ends included, and one with
    nulls for a score that is never settled.

    The same call on batches gives all of these. On streams both sides have a watermark that is `late`
    behind the latest time seen; the earlier of the two counts. Rows later than that are dropped, the state
    holds rows only as long as something may still match them, and a score counts as never settled once
    the watermark is past its time by `within`, so the last ones of a stream are not told yet. Null times
    are left out on both sides, null keys match nothing. Repeated rows are rows each. Other columns of the
    two must differ in name. Empty tables give none, or scores without settlements.
    """
    own = scores.where(F.col(scored).isNotNull())
    other = settlements.where(F.col(settled).isNotNull() & F.col(key).isNotNull()).withColumnRenamed(key, "__key")
    if own.isStreaming:
        own = own.withWatermark(scored, late)
    if other.isStreaming:
        other = other.withWatermark(settled, late)
    time = F.col(settled)
    near = (F.col(key) == F.col("__key")) & (time >= F.col(scored)) & (time <= F.col(scored) + F.expr(f"interval {within}"))
    return own.join(other, near, "left").drop("__key")


def appended(stream: DataFrame, folder: str) -> DataFrame:
    """The rows of a stream in append mode, read to the end of what is there now. Batches
    are written to a folder that all executors share, each to a place of its own, so that a
    repeated batch replaces itself."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", f"{folder}/rows").schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)


#: State of a group of keys: asks whose time the watermark hasn't passed, and quotes that may
#: still be asked for; keys and rows in JSON, times in microseconds.
WAITING = "asks array<struct<t:long,k:string,row:string>>, quotes array<struct<t:long,k:string,row:string>>"


def last_quotes(values: list[str]):
    """Answers a group's asks that the watermark has passed; its state comes and goes with the rows."""

    def order(row: str) -> list[tuple]:
        own = json.loads(row)
        return [(True, own[v]) if own.get(v) is not None else (False,) for v in values]

    def run(group, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asks, quotes = state.get if state.exists else ([], [])
        waiting, last = [tuple(a) for a in asks], {}
        for t, k, row in quotes:
            last.setdefault(k, {})[t] = row
        if not state.hasTimedOut:
            for part in parts:
                for side, t, k, row in zip(*(part[c].tolist() for c in ("side", "t", "k", "row")), strict=True):
                    if side:
                        waiting.append((t, k, row))
                        continue
                    own = last.setdefault(k, {})
                    if t not in own or (row != own[t] and order(row) > order(own[t])):
                        own[t] = row
        until = max(state.getCurrentWatermarkMs(), 0) * 1000
        waiting.sort()
        due = bisect_left(waiting, (until,))
        times, out, first = {k: sorted(own) for k, own in last.items()}, [], {}
        for t, k, row in waiting[:due]:
            known = times.get(k, [])
            at = bisect_right(known, t)
            out.append((row, known[at - 1], last[k][known[at - 1]]) if at else (row, None, None))
        waiting = waiting[due:]
        for t, k, _ in waiting:
            first.setdefault(k, t)
        kept = []
        for k, known in times.items():
            # Asks to come are later than the watermark.
            seen = bisect_right(known, min(until, first.get(k, until)))
            kept += [(t, k, last[k][t]) for t in known[max(0, seen - 1) :]]
        if waiting or kept:
            state.update((waiting, kept))
        elif state.exists:
            state.remove()
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, 1))
        if out:
            yield pd.DataFrame(out, columns=["ask", "quote_t", "quote"], dtype=object)

    return run


#: JSON's times with all their digits.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def asof_stream(asks: DataFrame, quotes: DataFrame, key: str, time: str, values: list[str], late: str = "10 minutes", groups: int = 1024) -> DataFrame:
    """asks' columns with values of the last of quotes of the same key whose time isn't later, and its
    time as <time>_right; nulls where there is none. As operators.asof_join, but asks and quotes are streams.

    An ask is answered once the watermark (`late` behind the latest time of both) has passed its time, so
    quotes may come later than asks by that much; rows later than the watermark are dropped, and the last asks
    of a stream wait. Of quotes of one time the largest counts, by values in their order. Rows with a null key or time
    are left out. A key's state has its waiting asks and the quotes since the last before the watermark. Keys are dealt
    by hash into groups, each with one state, which goes to Python with the group's rows and is written again with
    each batch that has some: choose as many groups as leave some hundred keys to each. A stream keeps its number of
    groups. Any state store will do; RocksDB's keeps states off the heap (spark.sql.streaming.stateStore.providerClass).
    """
    known = lambda df: df.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    own_key = lambda df: F.col(key) + F.lit(0).cast(df.schema[key].dataType) if df.schema[key].dataType.typeName() in ("float", "double") else F.col(key)  # noqa: E731  # one zero
    side = lambda df, cols, n: known(df).select(F.to_json(F.struct(own_key(df).alias("k")), TIMES).alias("k"), F.lit(n).alias("side"), F.col(time).cast("timestamp").alias("at"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.to_json(F.struct(*cols), TIMES).alias("row"))
    both = side(quotes, values, 0).unionAll(side(asks, asks.columns, 1)).withWatermark("at", late)
    answered = both.withColumn("group", F.pmod(F.xxhash64("k"), F.lit(groups))).groupBy("group").applyInPandasWithState(last_quotes(values), "ask string, quote_t long, quote string", WAITING, "append", "EventTimeTimeout")
    kinds = {f.name: f.dataType for f in quotes.schema.fields}
    quote = F.from_json("quote", StructType([quotes.schema[v] for v in values]), TIMES)
    own = F.from_json("ask", asks.schema, TIMES)
    stamp = F.timestamp_micros("quote_t").cast(kinds[time])
    return answered.select(*[own.getField(c).alias(c) for c in asks.columns], stamp.alias(f"{time}_right"), *[quote.getField(v).alias(v) for v in values])
