"""Groups of many small sets, compared by the shingles that are rare in them."""

import random

import numpy as np
import pytest
from test_jaccard import brute, groups

from millrace.llm import jaccard


def true_links(n, sets):
    return {(i, j) for i in range(len(sets)) for j in range(i) if 175 * len(np.intersect1d(sets[i], sets[j])) >= 75 * (n[i] + n[j])}


@pytest.mark.parametrize("block", [1, 5, 40])
def test_rare_links_lose_no_connection(monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(block)
    for _ in range(25):
        k = int(rng.integers(2, 130))
        base = [rng.integers(0, 2**32, size=int(rng.integers(3, 60))).astype(np.uint32) for _ in range(5)]
        sets = []
        for _ in range(k):
            b = base[rng.integers(0, 5)]
            kept = b[rng.random(len(b)) < rng.choice([0.5, 0.8, 0.9, 0.97])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**32, size=int(rng.integers(1, 8))).astype(np.uint32)])))
        n = np.array([len(s) for s in sets]) + rng.integers(0, 2, k)
        labels = np.where(rng.random(k) < 0.2, 0, np.arange(k))
        found = jaccard.rare_links(n, sets, labels, 75)
        before = {(i, j) for i in range(k) for j in range(i) if labels[i] == labels[j]}
        assert all((max(x), min(x)) in true_links(n, sets) for x in found)
        assert groups(range(k), [*found, *before]) == groups(range(k), true_links(n, sets) | before)


def small_groups(spark, monkeypatch, n):
    """Rows that the second join moves for n texts of one passage and words of their own, no two of which link."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    common = " ".join(word() for _ in range(14))
    rows = [(i, f"{common} {' '.join(word() for _ in range(12))}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, own = [], jaccard.joined
    monkeypatch.setattr(jaccard, "joined", lambda members, *a: seen.append(members.count()) or own(members, *a))
    got = jaccard.links_of(candidates(spark, docs), 75, jaccard.Scratch(spark))
    monkeypatch.setattr(jaccard, "joined", own)
    assert got.count() == 0
    return sum(seen)


def candidates(spark, docs):
    """All sets as candidates of one band, as op2's are."""
    rows = [(r["doc_id"], jaccard.shingle_set(r["text"])) for r in docs.collect()]
    return spark.createDataFrame([(i, len(s), [1], 1, s.tobytes()) for i, s in rows], "id long, n long, prefix array<long>, index int, shared binary")


def test_rows_of_a_group_grow_with_its_sets(spark, monkeypatch):
    short, long = small_groups(spark, monkeypatch, 600), small_groups(spark, monkeypatch, 2400)
    assert long <= 4.5 * short


@pytest.mark.parametrize("small, size", [(0, 1 << 20), (1 << 20, 1 << 20), (1 << 20, 300)])
def test_join_by_any_way_matches_brute_force(spark, monkeypatch, small, size):
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    monkeypatch.setattr(jaccard, "HUBS", 1)
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "SMALL_BYTES", size)
    rng = random.Random(3)
    passages = [" ".join(rng.choice("abcdefgh") + rng.choice("aeiou") + str(k) for k in range(12)) for _ in range(4)]
    rows = [(i, " ".join([rng.choice(passages), *(f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 14)))])) for i in range(120)]
    rows += [(200 + i, f"{passages[i % 4]} {i}") for i in range(20)]
    got = sorted(tuple(r) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
