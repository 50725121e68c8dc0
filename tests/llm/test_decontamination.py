import random
import re

import numpy as np

from millrace.llm import decontamination as d
from millrace.plans import node_counts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc in docs:
        ws, hit, found = words(doc), set(), set()
        for name, text in items:
            iw = words(text)
            m = min(10, len(iw))
            for k in range(len(iw) - m + 1 if m else 0):
                for i in range(len(ws) - m + 1):
                    if ws[i : i + m] == iw[k : k + m]:
                        hit |= set(range(i, i + m))
                        found.add("" if name is None else str(name))
        out.append((len(ws), sorted(hit), sorted(found)))
    return out


def positions(spans):
    return [p for s in spans for p in range(s["start"], s["end"])]


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["Ab", "c1", "é", "ÉA", "x", "yy", "zz9"]
    phrase = lambda a, b: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(a, b)))
    items = [(i % 7, phrase(0, 14)) for i in range(12)] + [(None, "..."), (8, None), (9, "zz9")]
    docs = [phrase(0, 60) for _ in range(25)]
    docs += [f"{phrase(3, 9)}. {t}! {phrase(2, 300)}" for _, t in items if t] + [None, "", " \x0b-", "x" * 5000]
    return docs, items


def test_search_matches_brute_force():
    for seed in range(12):
        docs, items = case(seed)
        searcher = d.Searcher([("" if n is None else str(n), t or "") for n, t in sorted(items, key=str)], 10)
        got = searcher.search([t or "" for t in docs])
        assert [(n, [p for a, b in s for p in range(a, b)], i) for n, s, i in got] == brute(docs, items)


def test_shifts_skip_nothing():
    rng = np.random.default_rng(1)
    patterns = d.Patterns(rng.integers(1, 5, (40, 4)))
    text = rng.integers(0, 6, 3000)
    want = {(e, p) for e in range(3, 3000) for p in range(40) if (text[e - 3 : e + 1] == patterns.rows[p]).all()}
    ends, which = patterns.find(text)
    assert set(zip(ends.tolist(), which.tolist())) == want


def test_spark_passes(spark):
    docs, items = case(99)
    rows = [(i, t, "clash", 5) for i, t in enumerate(docs)]
    source = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, HITS string, other int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for limit in (1 << 20, 60):
        got = d.find_benchmark(source, bench, pass_bytes=limit)
        assert got.columns == ["doc_id", "text", "other", "n_words", "hits", "items"]
        got = got.collect()
        assert len(got) == len(rows) + 3
        for r in got:
            assert (r["n_words"], positions(r["hits"]), r["items"]) == want[r["doc_id"]]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.find_benchmark(none, bench).count() == 0
    got = d.find_benchmark(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), bench).first()
    assert got["hits"] == [] and got["n_words"] == 2


def test_passes_run_one_after_another(spark):
    """Ten passes leave written tables and a join: no task has a searcher of two."""
    docs, items = case(5)
    source = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    total = bench.selectExpr("sum(octet_length(text))").first()[0]
    got = d.find_benchmark(source, bench, pass_bytes=total // 10, carry=["doc_id"])
    assert node_counts(got)["MapInArrow"] == 0 and node_counts(d.find_benchmark(source, bench, carry=["doc_id"]))["MapInArrow"] == 1
    want = brute(docs, items)
    for r in got.collect():
        assert (r["n_words"], positions(r["hits"]), r["items"]) == want[r["doc_id"]]
