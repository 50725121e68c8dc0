"""Joins of streams against their batch forms and plain versions."""

import datetime
import random

import pytest

from millrace.operators import asof_join
from millrace.streaming.settlements import appended, asof_stream, settle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def tables(spark, seed, n=240):
    """Scores and settlements in the order of their times, more or less; some without key or time."""
    rng = random.Random(seed)
    times = sorted(rng.sample(range(20_000), 2 * n))
    left = [(i, rng.choice(["a", "b", "c", None]), at(t + rng.choice([0, 0, 3])) if i % 17 else None) for i, t in enumerate(times[::2])]
    right = [(rng.choice(["a", "b", "c", None]), at(t + rng.choice([0, 0, -4])) if i % 13 else None, rng.choice([None, 1.5, float(i)])) for i, t in enumerate(times[1::2])]
    return spark.createDataFrame(left, "id int, k string, scored timestamp"), spark.createDataFrame(right, "k string, settled timestamp, v double")


def written(df, order, folder, parts):
    """df in files that hold its rows in order, the first the oldest."""
    rows = sorted(df.collect(), key=lambda r: (r[order] is not None, r[order]))
    size = -(-len(rows) // parts)
    for i in range(parts):
        df.sparkSession.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_settle_batch_by_hand(spark):
    scores, settlements = tables(spark, 1)
    left, right = scores.collect(), settlements.collect()
    want = []
    for s in left:
        if s["scored"] is not None:
            own = [(*s, r["settled"], r["v"]) for r in right if r["settled"] is not None and r["k"] == s["k"] is not None and s["scored"] <= r["settled"] <= s["scored"] + datetime.timedelta(hours=9)]
            want += own or [(*s, None, None)]
    got = settle(scores, settlements, "k", "scored", "settled", "9 hours")
    assert got.columns == ["id", "k", "scored", "settled", "v"]
    assert rows(got) == sorted(want, key=str)
    assert settle(scores.limit(0), settlements, "k", "scored", "settled").count() == 0
    assert settle(scores, settlements.limit(0), "k", "scored", "settled").where("settled is not null").count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_settle_streams(spark, tmp_path, parts):
    scores, settlements = tables(spark, 2)
    left, right = written(scores, "scored", str(tmp_path / "l"), parts), written(settlements, "settled", str(tmp_path / "r"), parts)
    got = rows(appended(settle(left, right, "k", "scored", "settled", "9 hours"), str(tmp_path / "out")))
    batch = rows(settle(scores, settlements, "k", "scored", "settled", "9 hours"))
    watermark = min(max(r["scored"] for r in scores.collect() if r["scored"]), max(r["settled"] for r in settlements.collect() if r["settled"])) - datetime.timedelta(minutes=10)
    closed = [r for r in batch if r[3] is not None or r[2] + datetime.timedelta(hours=9) < watermark]
    assert got == closed and 0 < len(closed) < len(batch)


def test_settle_empty_streams(spark, tmp_path):
    scores, settlements = tables(spark, 3)
    left = spark.readStream.schema(scores.schema).parquet(str(tmp_path / "none*"))
    right = spark.readStream.schema(settlements.schema).parquet(str(tmp_path / "none*"))
    assert appended(settle(left, right, "k", "scored", "settled"), str(tmp_path / "out")).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_asof_of_streams(spark, tmp_path, parts):
    scores, settlements = tables(spark, 4)
    scores, settlements = scores.withColumnRenamed("scored", "ts"), settlements.withColumnRenamed("settled", "ts")
    settlements = settlements.unionAll(settlements.selectExpr("k", "ts", "v + 100"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        asks, quotes = written(scores, "ts", str(tmp_path / "l"), parts), written(settlements, "ts", str(tmp_path / "r"), parts)
        got = rows(appended(asof_stream(asks, quotes, "k", "ts", ["v"]), str(tmp_path / "out")))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    batch = [r for r in rows(asof_join(scores, settlements, "k", "ts", ["v"])) if r[1] is not None and r[2] is not None]
    watermark = max(r["ts"] for r in scores.select("ts").unionAll(settlements.select("ts")).collect() if r["ts"]) - datetime.timedelta(minutes=10)
    assert got == [r for r in batch if r[2] < watermark]
    assert any(r[3] is None for r in got) or parts == 1


def test_asof_of_streams_whose_keys_share_a_state(spark, tmp_path):
    """In any state store: a group's state goes with its rows."""
    scores, settlements = tables(spark, 6)
    scores, settlements = scores.withColumnRenamed("scored", "ts"), settlements.withColumnRenamed("settled", "ts")
    asks, quotes = written(scores, "ts", str(tmp_path / "l"), 3), written(settlements, "ts", str(tmp_path / "r"), 3)
    got = rows(appended(asof_stream(asks, quotes, "k", "ts", ["v"], groups=1), str(tmp_path / "out")))
    batch = [r for r in rows(asof_join(scores, settlements, "k", "ts", ["v"])) if r[1] is not None and r[2] is not None]
    watermark = max(r["ts"] for r in scores.select("ts").unionAll(settlements.select("ts")).collect() if r["ts"]) - datetime.timedelta(minutes=10)
    assert got == [r for r in batch if r[2] < watermark] and got
