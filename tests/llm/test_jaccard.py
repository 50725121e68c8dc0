import random

import numpy as np
import pytest

from millrace.llm import jaccard
from millrace.llm.common import Scratch
from millrace.llm.components import components


def groups(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    tops = groups({i for i, _ in rows}, links)
    return sorted((i, len(s), tops[i]) for i, s in sets)


def texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnop")
    common = " ".join(word() for _ in range(40))
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.5:
            base = rng.choice(out).split()
            for _ in range(rng.randint(0, 3)):
                if base:
                    base[rng.randrange(len(base))] = word()
            out.append(" ".join(base))
        elif kind < 0.7:
            out.append(common + " " + " ".join(word() for _ in range(rng.randint(0, 30))))
        else:
            out.append(" ".join(word() for _ in range(rng.randint(0, 60))))
    return out


@pytest.mark.parametrize("block", [1000, 5])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HUBS", 2)
    own = texts(4) + ["", None, " \x0b\t", "A b", "a B", "a b c", "É x y z w", "é x y z w", "q " * 3000, "Q " * 2500]
    rows = [(i * 3 + 1, t) for i, t in enumerate(own)]
    random.Random(1).shuffle(rows)
    source = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, component_id string, n int")
    got = sorted(tuple(r) for r in jaccard.jaccard_join(source).collect())
    assert got == brute(rows)


def test_edge_rows(spark):
    same = "one two three four five six"
    source = spark.createDataFrame([(7, same), (7, same), (9, same), (None, same), (None, "alone in the world it is"), (3, "")], "doc_id long, text string")
    got = [tuple(r) for r in jaccard.jaccard_join(source).collect()]
    assert sorted(got, key=str) == sorted([(7, 2, 7), (7, 2, 7), (9, 2, 7), (None, 2, 7), (None, 2, None), (3, 0, 3)], key=str)
    assert jaccard.jaccard_join(source.limit(0)).count() == 0


def test_rows_without_id_hold_others_together(spark):
    """1 and 2 are linked only through a text whose row has no id."""
    base = [f"w{i}" for i in range(100)]
    one, middle, two = base[:88] + [f"a{i}" for i in range(12)], base, [f"b{i}" for i in range(12)] + base[12:]
    assert brute([(1, " ".join(one)), (2, " ".join(two))]) == [(1, 96, 1), (2, 96, 2)]
    rows = [(1, " ".join(one)), (2, " ".join(two)), (None, " ".join(middle)), (5, "x " * 9), (5, " ".join(two))]
    assert sorted((a or 0, b, c) for a, b, c in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [(0, 96, 1), (1, 96, 1), (2, 96, 1), (5, 1, 5), (5, 96, 1)]


def test_one_of_each(spark):
    same = "one two three four five six"
    rows = [(7, same, 1), (9, same, 1), (9, "another text of its own words", 1), (None, same, 2), (None, "alone in the world it is", 3), (None, "alone in the world it is", 3), (None, "ALONE in the world it is", 3), (3, "", 1), (3, "", 1), (4, None, 1)]
    source = spark.createDataFrame(rows, "doc_id long, text string, NODE int")
    got = jaccard.one_of_each(source)
    assert got.columns == source.columns
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert len(got) == 6 and (7, same, 1) in got and (9, "another text of its own words", 1) in got
    assert [r for r in got if r[0] in (3, 4)] == [(3, "", 1), (3, "", 1), (4, None, 1)]
    assert len([r for r in got if r[0] is None]) == 1
    assert jaccard.one_of_each(source.limit(0)).count() == 0


def template_rows(spark, monkeypatch, n):
    """Rows of the second join over documents of 10 of 400 sentences."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    sentences = [" ".join(word() for _ in range(30)) for _ in range(400)]
    docs = spark.createDataFrame([(i, " ".join(rng.sample(sentences, 10))) for i in range(n)], "doc_id long, text string").repartition(8)
    seen, own = [], jaccard.joined
    monkeypatch.setattr(jaccard, "joined", lambda rows, *a: seen.append(rows.count()) or own(rows, *a))
    assert jaccard.jaccard_join(docs).where("doc_id <> component_id").count() == 0
    monkeypatch.setattr(jaccard, "joined", own)
    return seen


def test_sets_of_common_passages_move_few_rows(spark, monkeypatch):
    """Only signatures are compared where sets share passages and nothing more."""
    assert template_rows(spark, monkeypatch, 1000)[1] <= 100


def test_tree_loses_no_connection():
    rng = np.random.default_rng(3)
    for _ in range(40):
        k = int(rng.integers(2, 120))
        base = [rng.integers(0, 2**63, size=int(rng.integers(3, 200))).astype(np.uint64) for _ in range(4)]
        sets = []
        for _ in range(k):
            b = base[rng.integers(0, 4)]
            kept = b[rng.random(len(b)) < rng.choice([0.8, 0.9, 0.97])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**63, size=int(rng.integers(1, 12))).astype(np.uint64)])))
        n = np.array([len(s) for s in sets]) + rng.integers(0, 3, k)
        found = jaccard.tree_links(n, sets, np.arange(k), 75)
        true = {(i, j) for i in range(k) for j in range(i) if 175 * len(np.intersect1d(sets[i], sets[j])) >= 75 * (n[i] + n[j])}
        assert all((max(x), min(x)) in true for x in found)
        assert groups(range(k), found) == groups(range(k), true)


@pytest.mark.parametrize("most", [1 << 20, 60])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr("millrace.llm.components.TASK_EDGES", most)
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    want = groups({n for e in edges for n in e}, edges)
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(4), Scratch(spark)).collect()
    assert {r["node"]: r["component"] for r in got} == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_low_bytes_round_trip():
    h = np.random.default_rng(1).integers(0, 2**63, 100, dtype=np.uint64)
    assert (jaccard.from_low(jaccard.low_bytes(h), (h >> np.uint64(56)).astype(np.uint8)) == h).all()
