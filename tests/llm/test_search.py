import math
import random
import re
from collections import Counter

import pytest

from millrace.llm import search

TERM = re.compile("[0-9a-z\x80-\U0010ffff]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=50):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    wanted = {}
    for name, text in items:
        wanted.setdefault(name, set()).update(terms(text))
    out = []
    for name, words in wanted.items():
        found = []
        for i, c, n in own:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(name, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:best])]
    return sorted(out, key=str)


def case(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "ÉA", "éa", "x1", "9", "ſ", "日本", "\xa0", *[f"w{k}" for k in range(60)]]
    phrase = lambda a, b: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(a, b)))
    docs = [(i, phrase(0, 40)) for i in rng.sample(range(-1000, 1000), n)]
    docs += [(5000 + i, docs[3][1]) for i in range(70)] + [(None, docs[3][1]), (None, None), (7, ""), (8, None), (9, "-- !"), (10, "rare " * 20_000), (10, "rare"), (10, "rare")]
    items = [(i, phrase(1, 8)) for i in range(20)] + [(20, docs[3][1]), (21, None), (22, ""), (23, "nowhere"), (None, "w1 w2"), (3, "w5"), (24, "the the THE"), (25, "rare")]
    return docs, items


@pytest.mark.parametrize("window, postings, passes, best", [(8192, 1 << 20, 1 << 20, 50), (64, 1 << 20, 60, 50), (7, 40, 25, 3), (1, 1, 1 << 20, 1)])
def test_search_matches_brute_force(spark, monkeypatch, window, postings, passes, best):
    monkeypatch.setattr(search, "WINDOW", window)
    monkeypatch.setattr(search, "POSTINGS", postings)
    docs, items = case(window)
    source = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, SCORE string, `a.b` int").repartition(3)
    queries = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, term int")
    got = search.search(source, queries, best=best, pass_bytes=passes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, best)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items, nothing = spark.createDataFrame([("q", "a")], "item_id string, text string"), spark.createDataFrame([], "item_id string, text string")
    assert search.search(none, items).count() == 0
    assert search.search(docs, nothing).count() == 0
    assert search.search(docs, items).dtypes == search.search(docs, nothing).dtypes == [("item_id", "string"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert search.search(docs, items).collect()[0]["doc_id"] == 1
