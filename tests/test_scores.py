"""Curves, ranks, bins and intervals of scores against plain versions."""

import datetime
import hashlib
import math
import random
from fractions import Fraction

import pytest

from millrace import plans
from millrace.catalog import QUERIES
from millrace.operators import bootstrap_intervals, calibration_error, equal_mass_bins, exact_auc, interval_join, isotonic_blocks, with_curve
from millrace.operators.bootstrap import poisson_steps
from millrace.operators.isotonic import pooled
from millrace.operators.mass import mass_bounds

KIND = "units long, y long, cluster long"
UNSETTLED = [(None, 1, 1), (40, None, 1), (None, None, None)]


def rising(seed, n=600, top=1000):
    """Scores with ties and outcomes that mostly rise with them."""
    rng = random.Random(seed)
    rows = [(u, int(rng.random() < (u / top) ** rng.choice([1, 0.2, 3])), rng.choice([None, *range(9)])) for u in (rng.choice([rng.randint(0, top), 500, top]) for _ in range(n))]
    return rows + rows[:20]


def fitted_by_formula(rows):
    """{score: rate} by the max-min formula."""
    scores = sorted({u for u, _, _ in rows})
    n = {u: sum(1 for x, _, _ in rows if x == u) for u in scores}
    k = {u: sum(y for x, y, _ in rows if x == u) for u in scores}
    cn, ck = [0], [0]
    for u in scores:
        cn.append(cn[-1] + n[u])
        ck.append(ck[-1] + k[u])
    mean = lambda a, b: Fraction(ck[b + 1] - ck[a], cn[b + 1] - cn[a])
    size = len(scores)
    least = [[None] * size for _ in range(size)]
    for a in range(size):
        low = None
        for b in range(size - 1, a - 1, -1):
            low = mean(a, b) if low is None else min(low, mean(a, b))
            least[a][b] = low
    return {u: max(least[a][i] for a in range(i + 1)) for i, u in enumerate(scores)}


@pytest.mark.parametrize("seed, width, fan", [(1, 65_536, 16), (2, 10, 2), (3, 1, 3), (4, 37, 4)])
def test_isotonic_curve_is_the_max_min_formula(spark, seed, width, fan):
    rows = rising(seed, 300) + [(-7, 1, 1), (2500, 0, 1)]
    table = spark.createDataFrame(rows + UNSETTLED, KIND).repartition(5)
    want = fitted_by_formula(rows)
    curve = isotonic_blocks(table, 1000, width, fan)
    blocks = sorted(map(tuple, curve.collect()))
    assert [b[4] for b in blocks] == sorted({b[4] for b in blocks})
    assert sum(b[2] for b in blocks) == len(rows) and sum(b[3] for b in blocks) == sum(y for _, y, _ in rows)
    got = {r["units"]: r["fitted"] for r in with_curve(table, curve, width).collect()}
    assert got.pop(None) is None
    assert {u: r for u, r in got.items() if u in want} == {u: float(r) for u, r in want.items()}


def test_curve_at_other_scores(spark):
    curve = isotonic_blocks(spark.createDataFrame([(10, 0, 1), (20, 1, 1), (30, 0, 1), (40, 1, 1)], KIND), 100, 8, 2)
    asked = spark.createDataFrame([(u, "x", 5) for u in (5, 10, 15, 20, 29, 39, 40, 99, None)], "units long, rate string, fitted int")
    got = with_curve(asked, curve, 8)
    assert got.columns == ["units", "rate", "fitted"]
    assert {r["units"]: r["fitted"] for r in got.collect()} == {5: 0.0, 10: 0.0, 15: 0.0, 20: 0.5, 29: 0.5, 39: 0.5, 40: 1.0, 99: 1.0, None: None}
    none = isotonic_blocks(spark.createDataFrame([], KIND), 100)
    assert none.count() == 0
    assert {r["fitted"] for r in with_curve(asked, none).collect()} == {None}


def test_pooling_is_associative():
    rng = random.Random(9)
    for _ in range(200):
        blocks = [(i, i, (n := rng.randint(1, 9)), rng.randint(0, n)) for i in range(rng.randint(0, 40))]
        cut = sorted(rng.randint(0, len(blocks)) for _ in range(3))
        parts = [blocks[a:b] for a, b in zip([0, *cut], [*cut, len(blocks)])]
        assert pooled([x for p in parts for x in pooled(p)]) == pooled(blocks)


def auc_by_pairs(rows):
    pos, neg = [u for u, y, _ in rows if y], [u for u, y, _ in rows if not y]
    win = lambda a, b: 1 if a > b else 0.5 if a == b else 0
    if not pos or not neg:
        return len(pos), len(neg), None, None
    v = [sum(win(a, b) for b in neg) / len(neg) for a in pos]
    w = [sum(win(a, b) for a in pos) / len(pos) for b in neg]
    m = sum(v) / len(v)
    if len(pos) < 2 or len(neg) < 2:
        return len(pos), len(neg), m, None
    s = lambda x: sum((a - m) ** 2 for a in x) / (len(x) - 1)
    return len(pos), len(neg), m, math.sqrt(s(v) / len(pos) + s(w) / len(neg))


def close(a, b):
    return len(a) == len(b) and all(x == y if y is None or isinstance(y, int) else x == pytest.approx(y, abs=1e-12) for x, y in zip(a, b))


@pytest.mark.parametrize("width", [1, 40, 65_536])
def test_auc_is_the_share_of_pairs(spark, width):
    rows = rising(5, 400) + [(-3, 0, 77), (1200, 1, 78), (5, 1, 79), (6, 0, 79), (6, 0, 79)]
    table = spark.createDataFrame(rows + UNSETTLED, KIND).repartition(4)
    assert close(tuple(exact_auc(table, width=width).first()), auc_by_pairs(rows))
    got = {r["cluster"]: tuple(r)[1:] for r in exact_auc(table, ["cluster"], width).collect()}
    assert set(got) == {c for _, _, c in rows}
    for c, r in got.items():
        assert close(r, auc_by_pairs([x for x in rows if x[2] == c]))
    assert close(tuple(exact_auc(table.where("y = 1")).first()), (sum(y for _, y, _ in rows), 0, None, None))


def test_auc_of_large_counts_is_exact(spark):
    """Fifty thousand rows of each of 40 scores."""
    table = spark.range(2_000_000).selectExpr("id % 40 as units", "cast((id * 7919) % 1000 < 10 * (id % 40) as int) as y", "1 as cluster")
    one = exact_auc(table).first()
    per = table.groupBy("units").agg({"y": "sum", "cluster": "sum"}).collect()
    p = {r["units"]: r["sum(y)"] for r in per}
    q = {r["units"]: r["sum(cluster)"] - r["sum(y)"] for r in per}
    wins = sum(p[a] * q[b] * (2 if a > b else 1 if a == b else 0) for a in p for b in q)
    assert one["auc"] == pytest.approx(wins / 2 / sum(p.values()) / sum(q.values()), abs=1e-15)


def test_empty_tables(spark):
    none = spark.createDataFrame([], KIND)
    assert tuple(exact_auc(none).first()) == (0, 0, None, None)
    assert exact_auc(none, ["cluster"]).count() == 0
    assert mass_bounds(none) == [] and equal_mass_bins(none).count() == 0
    assert tuple(calibration_error(equal_mass_bins(none)).first()) == (0, None, None)
    assert {(r["estimate"], r["low"], r["replicates"]) for r in bootstrap_intervals(none).collect()} == {(None, None, 0)}


@pytest.mark.parametrize("bins, cells", [(1, 1024), (7, 2), (10, 3), (20, 1024), (700, 10)])
def test_mass_bins_by_sorting(spark, bins, cells):
    rows = rising(bins, 300, 5000) + [(-40, 1, 1), (123_456, 0, 1)]
    table = spark.createDataFrame(rows + UNSETTLED, KIND).repartition(3)
    ordered = sorted(u for u, _, _ in rows)
    bounds = [ordered[-(-k * len(rows) // bins) - 1] for k in range(1, bins)]
    assert mass_bounds(table.where("y is not null"), bins, cells) == bounds
    got = {r["bin"]: r for r in equal_mass_bins(table, bins, 5000, cells=cells).collect()}
    own = {}
    for u, y, _ in rows:
        own.setdefault(sum(b < u for b in bounds), []).append((u, y))
    assert set(got) == set(own)
    for b, r in got.items():
        us, ys = zip(*own[b])
        assert (r["lowest"], r["highest"], r["n"], r["hits"]) == (min(us), max(us), len(us), sum(ys))
        assert r["rate"] == pytest.approx(sum(ys) / len(ys)) and r["mean_score"] == pytest.approx(sum(us) / len(us) / 5000)
        assert r["low"] <= r["rate"] <= r["high"]
    error = calibration_error(equal_mass_bins(table, bins, 5000, cells=cells)).first()
    off = [abs(r["rate"] - r["mean_score"]) for r in got.values()]
    assert error["largest_error"] == pytest.approx(max(off))
    assert error["expected_error"] == pytest.approx(sum(o * r["n"] for o, r in zip(off, got.values())) / len(rows))


def test_one_score_has_one_bin(spark):
    table = spark.createDataFrame([(7, i % 2, 1) for i in range(50)], KIND)
    assert mass_bounds(table, 5) == [7, 7, 7, 7]
    assert [(r["bin"], r["n"]) for r in equal_mass_bins(table, 5).collect()] == [(0, 50)]


def test_bootstrap_by_hand(spark):
    rows = rising(6, 200, 100)
    got = {r["statistic"]: r for r in bootstrap_intervals(spark.createDataFrame(rows + UNSETTLED, KIND).repartition(4), replicates=37, level=0.8, seed=3).collect()}
    steps, values = poisson_steps(), {"mean_error": [], "rate": [], "brier": []}
    for b in [-1, *range(37)]:
        weight = {}
        for c in {c for _, _, c in rows}:
            name = "null" if c is None else f"={c}"
            draw = int(hashlib.md5(f"3:{b // 4}:{name}".encode()).hexdigest()[b % 4 * 8 : b % 4 * 8 + 8], 16)
            weight[c] = 1 if b < 0 else sum(s <= draw for s in steps)
        n = sum(weight[c] for _, _, c in rows)
        values["mean_error"].append(sum(weight[c] * (100 * y - u) for u, y, c in rows) / n / 100)
        values["rate"].append(sum(weight[c] * y for _, y, c in rows) / n)
        values["brier"].append(sum(weight[c] * (100 * y - u) ** 2 for u, y, c in rows) / n / 10_000)
    for k, v in values.items():
        ordered = sorted(v[1:])
        assert got[k]["estimate"] == pytest.approx(v[0]) and got[k]["replicates"] == 37
        assert got[k]["low"] == pytest.approx(ordered[math.ceil(3.7) - 1]) and got[k]["high"] == pytest.approx(ordered[math.ceil(33.3) - 1])


def test_copies_have_poisson_s_distribution(spark):
    from pyspark.sql import functions as F

    from millrace.operators.bootstrap import copies

    drawn = spark.range(2000).select(F.explode(copies(F.col("id").cast("string"), 10, 1)).alias("w")).groupBy("w").count().collect()
    share = {r["w"]: r["count"] / 20_000 for r in drawn}
    for k in range(4):
        assert share[k] == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.015)


def test_bootstrap_interval_is_about_the_cluster_error(spark):
    """Clusters that go together: the interval is as wide as robust errors say, not plain ones."""
    from millrace.operators import cluster_error

    rng = random.Random(8)
    rows = [(50, int(rng.random() < p), c) for c in range(150) for p in [rng.random()] for _ in range(20)]
    table = spark.createDataFrame(rows, KIND)
    wide = {r["statistic"]: r["high"] - r["low"] for r in bootstrap_intervals(table, replicates=400).collect()}["mean_error"]
    error = cluster_error(table).first()
    assert wide / (2 * 1.96) == pytest.approx(error["robust_error"], rel=0.2) and wide / (2 * 1.96) > 1.5 * error["plain_error"]


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


@pytest.mark.parametrize("finest, touched", [(3600, 4), (60, 1), (1, 16)])
def test_intervals_hold_their_points_once(spark, finest, touched):
    rng = random.Random(finest)
    points = [(i, rng.choice(["a", "b", None]), at(rng.randint(0, 5000)) if i % 9 else None) for i in range(200)]
    points += [(300, "a", at(70)), (300, "a", at(70))]
    quotes = [(k, rng.choice(["a", "b", "c", None]), (s := rng.randint(0, 5000)), s + rng.choice([0, -5, 1, 7, 60, 500, 4000, 10**7])) for k in range(80)]
    quotes = [(k, key, at(s) if k % 11 else None, at(e) if k % 7 else None) for k, key, s, e in quotes] + [(90, "a", at(70), at(71)), (90, "a", at(70), at(71)), (91, "a", at(69), at(70))]
    got = interval_join(spark.createDataFrame(points, "id int, k string, `t.s` timestamp").withColumnRenamed("t.s", "ts"), spark.createDataFrame(quotes, "quote int, k string, since timestamp, until timestamp"), "k", "ts", "since", "until", finest, touched)
    assert got.columns == ["id", "k", "ts", "quote", "since", "until"]
    want = [(i, k, t, q, s, e) for i, k, t in points for q, key, s, e in quotes if None not in (k, t, s) and k == key and s <= t and (e is None or t < e)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(e is None for *_, e in want) and len(want) > 200


def test_interval_join_of_empty_tables(spark):
    points, quotes = spark.createDataFrame([(1, at(0))], "k int, ts timestamp"), spark.createDataFrame([(1, at(0), None)], "k int, since timestamp, until timestamp")
    assert interval_join(points, quotes, "k", "ts", "since", "until").count() == 1
    assert interval_join(points, quotes.limit(0), "k", "ts", "since", "until").count() == 0
    assert interval_join(points.limit(0), quotes, "k", "ts", "since", "until").count() == 0


@pytest.mark.parametrize("name", ["isotonic_curve", "auc", "mass_bins", "cluster_bootstrap"])
def test_plans_read_two_or_three_columns_and_join_nothing(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert plans.read_columns(plan) <= {"l_extendedprice", "l_discount", "l_returnflag", "l_suppkey"}
    nodes = plans.node_counts(plan)
    assert not [n for n in nodes if "Join" in n or "Cartesian" in n]
