import datetime
import math
import random

import pytest

from millrace import plans
from millrace.catalog import QUERIES, SQL
from millrace.functions import outcome
from millrace.operators import asof_join, bin_rates, brier_parts, cluster_error, line_fit
from millrace.streaming import latest_windows, running_rates


def scored(spark, rows):
    return spark.createDataFrame(rows, "units long, y long, cluster long")


def cases(seed=1, n=400):
    rng = random.Random(seed)
    return [(rng.choice([0, 5, 50, 93, 100]), rng.randint(0, 1), rng.randint(0, 9)) for _ in range(n)]


UNSETTLED = [(None, 1, 1), (40, None, 1)]


def test_bins(spark):
    rows = cases()
    got = {r["bin"]: r for r in bin_rates(scored(spark, rows + UNSETTLED), width=10).collect()}
    assert set(got) == {u // 10 for u, _, _ in rows}
    for b, r in got.items():
        own = [(u, y) for u, y, _ in rows if u // 10 == b]
        n, k = len(own), sum(y for _, y in own)
        p = k / n
        half = 1.96 * math.sqrt(p * (1 - p) / n + 1.96**2 / (4 * n * n)) / (1 + 1.96**2 / n)
        middle = (p + 1.96**2 / (2 * n)) / (1 + 1.96**2 / n)
        mean = sum(u for u, _ in own) / n / 100
        assert (r["n"], r["hits"]) == (n, k)
        assert r["low"] == pytest.approx(max(0, middle - half)) and r["high"] == pytest.approx(min(1, middle + half))
        assert r["mean_payoff"] == (pytest.approx((p - mean) / mean) if mean else None)


def test_line_and_brier_and_clusters(spark):
    rows = cases(2)
    table = scored(spark, rows + UNSETTLED)
    x, y = [u / 100 for u, _, _ in rows], [y for _, y, _ in rows]
    n, mx, my = len(x), sum(x) / len(x), sum(y) / len(y)
    sxx, sxy = sum((a - mx) ** 2 for a in x), sum((a - mx) * (b - my) for a, b in zip(x, y))
    line = line_fit(table).first()
    assert line["slope"] == pytest.approx(sxy / sxx) and line["intercept"] == pytest.approx(my - sxy / sxx * mx)
    brier = brier_parts(table).first()
    assert brier["brier"] == pytest.approx(sum((a - b) ** 2 for a, b in zip(x, y)) / n)
    assert brier["brier"] == pytest.approx(brier["reliability"] - brier["resolution"] + brier["uncertainty"])
    e = [b - a for a, b in zip(x, y)]
    m = sum(e) / n
    per = {}
    for d, (_, _, g) in zip(e, rows):
        per[g] = per.get(g, 0) + d - m
    error = cluster_error(table).first()
    assert error["mean_error"] == pytest.approx(m)
    assert error["plain_error"] == pytest.approx(math.sqrt(sum((d - m) ** 2 for d in e)) / n)
    assert error["robust_error"] == pytest.approx(math.sqrt(sum(d * d for d in per.values())) / n)


def test_empty_tables(spark):
    none = scored(spark, [])
    assert bin_rates(none).count() == 0
    assert line_fit(none).first()["slope"] is None
    assert brier_parts(none).first()["brier"] is None
    assert cluster_error(none).first()["n"] == 0


def at(hours):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def test_asof(spark):
    rng = random.Random(3)
    left = [(i, rng.choice([1, 2, None]), at(rng.randint(0, 200)) if i % 9 else None) for i in range(150)]
    right = [(rng.choice([1, 2, None]), at(rng.randint(0, 200)) if i % 9 else None, i) for i in range(60)] + [(1, at(50), 7), (1, at(50), 99)]
    got = asof_join(spark.createDataFrame(left, "id int, k int, ts timestamp"), spark.createDataFrame(right, "k int, ts timestamp, v int"), "k", "ts", ["v"]).collect()
    assert len(got) == len(left)
    for r in got:
        fit = [(t, v) for k, t, v in right if k is not None and t is not None and k == r["k"] and r["ts"] is not None and t <= r["ts"]]
        assert (r["ts_right"], r["v"]) == (max(fit) if fit else (None, None))


def test_stream_gives_the_batch_windows(spark, tmp_path):
    rows = [(at(h), h % 3 == 0) for h in range(0, 100, 5)]
    rows.reverse()
    spark.createDataFrame(rows, "ts timestamp, hit boolean").write.parquet(str(tmp_path / "in"))
    from pyspark.sql import functions as F

    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for part in range(1, 3):
        rates = running_rates(stream, "ts", outcome(F.col("hit")))
        got = latest_windows(rates, str(tmp_path / f"out{part}"))
        assert sorted(got.collect()) == sorted(running_rates(batch, "ts", outcome(F.col("hit"))).collect())
    none = running_rates(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "none*")), "ts", outcome(F.col("hit")))
    assert latest_windows(none, str(tmp_path / "empty")).count() == 0


def test_line_of_large_counts_keeps_its_digits(spark):
    """Scores that differ by one part in a hundred million."""
    rows = spark.range(500).selectExpr("100000000 + id % 2 as units", "id % 2 as y", "id as cluster")
    got = line_fit(rows, per_one=1).first()
    assert got["slope"] == pytest.approx(1.0) and got["r2"] == pytest.approx(1.0)


def test_plans_read_only_what_they_need(spark):
    plan = QUERIES["calibration_table"](spark, "/root/testdata/sf0.001")
    assert plans.read_columns(plan) == {"l_discount", "l_returnflag"}
    assert plans.node_counts(plan)["Exchange"] == 1


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
