"""Drift, survival and the maintained table against plain versions."""

import datetime
import math
import random

import pytest

from millrace.operators import bin_rates, drift, store_periods, stored_rates, survival_curve


def day(k):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=k)


@pytest.mark.parametrize("slice_days", [1, 7, 10_000])
def test_drift_by_hand(spark, slice_days):
    rng = random.Random(slice_days)
    rows = [(rng.choice(["a", "b", None]), day(rng.randint(0, 60)) if i % 31 else None, rng.choice([10, 50, 90]), rng.randint(0, 1)) for i in range(500)]
    rows += [("a", day(3), None, 1), ("a", day(3), 50, None), ("once", day(5), 0, 1)] + rows[:10]
    table = spark.createDataFrame(rows, "k string, d date, units long, y long").repartition(4)
    got = drift(table, "k", "d", allowance=5, limit=300, slice_seconds=86_400 * slice_days)
    assert got.columns == ["k", "d", "n", "missed", "up", "down", "alarm"]
    want = []
    for k in {r[0] for r in rows}:
        up = down = 0
        own = [r for r in rows if r[0] == k and None not in r[1:]]
        for d in sorted({r[1] for r in own}):
            e = [100 * y - u for _, t, u, y in own if t == d]
            up, down = max(0, up + sum(e) - 5 * len(e)), max(0, down - sum(e) - 5 * len(e))
            want.append((k, d, len(e), sum(e), up, down, max(up, down) > 300))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {w[6] for w in want} == {True, False}
    assert drift(table.limit(0), "k", "d").count() == 0
    assert drift(table, "k", "d").where("alarm").count() == 0


def kaplan_meier(rows):
    out, left, s, g = [], len(rows), 1.0, 0.0
    for t in sorted({t for t, _ in rows}):
        n, d = sum(x == t for x, _ in rows), sum(x == t and e for x, e in rows)
        s *= 1 - d / left
        g = math.nan if left == d else g + d / (left * (left - d))
        out.append((t, left, d, n - d, s, None if left == d else s * math.sqrt(g)))
        left -= n
    return out


def same(a, b):
    return len(a) == len(b) and all(x == y if y is None or isinstance(y, int) else x == pytest.approx(y, abs=1e-12) for r, w in zip(a, b) for x, y in zip(r, w))


@pytest.mark.parametrize("width", [1, 9, 65_536])
def test_survival_by_hand(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["a", None]), rng.choice([0, 5, rng.randint(0, 90)]), int(rng.random() < 0.7)) for _ in range(300)]
    rows += [("all end", 4, 1), ("all end", 4, 1), ("all end", 2, 1), ("none end", 3, 0), ("none end", 200, 0)] + rows[:9]
    table = spark.createDataFrame([*rows, ("a", None, 1), ("a", 7, None)], "g string, duration long, ended int").repartition(3)
    got = sorted(map(tuple, survival_curve(table, width=width).collect()))
    assert same(got, kaplan_meier([r[1:] for r in rows]))
    per = {}
    for r in survival_curve(table, ["g"], width).collect():
        per.setdefault(r["g"], []).append(tuple(r)[1:])
    assert set(per) == {r[0] for r in rows}
    for g, own in per.items():
        assert same(sorted(own, key=lambda r: r[0]), kaplan_meier([r[1:] for r in rows if r[0] == g]))
    assert survival_curve(table.limit(0)).count() == 0


def test_maintained_table_is_the_table_of_all_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([0, 30, 31, 99]), rng.randint(0, 1), rng.choice(["d1", "d2", "d3", "", None])) for _ in range(400)] + [(None, 1, "d1"), (5, None, "d9")]
    kind, folder = "units long, y long, day string", str(tmp_path / "kept")
    table = lambda own: spark.createDataFrame(own, kind)
    told = lambda **o: sorted(map(tuple, stored_rates(spark, folder, **o).collect()))
    want = lambda own: sorted(map(tuple, bin_rates(table(own), width=10).collect()))
    early = [r for i, r in enumerate(rows) if r[2] != "d2" or i % 2]
    store_periods(table(early), "day", folder, 10)
    assert told() == want(early)
    store_periods(table([r for r in rows if r[2] == "d2"]), "day", folder, 10)
    store_periods(table([]), "day", folder, 10)
    assert told() == want(rows)
    store_periods(table(rows), "day", folder, 10)
    assert told() == want(rows)
    assert told(since="d2", until="d3") == want([r for r in rows if r[2] in ("d2", "d3")])
    # A period that turns out to be unsettled loses what was stored of it.
    store_periods(table([(50, None, "d3")]), "day", folder, 10)
    assert told() == want([r for r in rows if r[2] != "d3"])
    assert told(since="d3") == []


def test_only_the_periods_asked_for_are_read(spark, tmp_path):
    folder = str(tmp_path / "kept")
    store_periods(spark.createDataFrame([(i % 100, i % 2, f"d{i % 9}") for i in range(900)], "units long, y long, day string"), "day", folder)
    plan = stored_rates(spark, folder, since="d3", until="d4")
    assert plan._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [isnotnull(period") == 1
    assert len(stored_rates(spark, folder, since="d3", until="d4").inputFiles()) >= 2
