"""What views hand over: limits by sorting, labels by id, and the same under other partitionings."""

import math
import random

import numpy as np

from millrace.llm import cotraining
from millrace.llm.common import Scratch


def by_sorting(rows, view, share):
    """The limits of a view over (p, given) of all rows."""
    out = list(map(float, (1, 1)))
    for good in (0, 1):
        own = sorted(max(p, 1 - p) for p, given in rows if given is None and (p > 0.5) == good)
        if own:
            out[good] = own[math.ceil(round((1 - cotraining.SHARE) * len(own), 6)) - 1]
    return [max(a, b) for a, b in zip(cotraining.floors(share), out)]


def test_limits_by_sorting(spark):
    rng = random.Random(4)
    for n in (0, 1, 7, 40, 3000):
        rows = [(i, rng.choice([rng.random(), 1 / (1 + math.exp(-rng.gauss(0, 9))), 1.0, 0.0, 0.5]), rng.choice([None, None, 1.0]), rng.random() * 0.4, None) for i in range(n)]
        scores = spark.createDataFrame(rows, "doc_id long, text_p double, text_given double, page_p double, page_given double")
        got = [cotraining.limits_of(s, 0.7) for s in (scores.repartition(1), scores.repartition(5))]
        assert got[0] == got[1]
        for v, k in (("text", 1), ("page", 3)):
            want = by_sorting([(r[k], r[k + 1]) for r in rows], v, 0.7)
            for good, limit in enumerate(want):
                sure = [max(r[k], 1 - r[k]) for r in rows if r[k + 1] is None and (r[k] > 0.5) == good]
                # As many as by sorting, but for those that are as sure to a millionth of their log odds.
                assert got[0][v][good] <= limit and abs(math.log(got[0][v][good] / max(1e-16, 1 - got[0][v][good])) - math.log(limit / max(1e-16, 1 - limit))) < 2e-6 or limit == 1.0
                assert sum(x >= got[0][v][good] for x in sure) >= sum(x >= limit for x in sure)


def corpus(spark, parts):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows, labels = [], []
    for i in range(400):
        bad = rng.random() < 0.4
        words = [word() for _ in range(rng.randint(10, 40))] + (["vile"] * rng.randint(0, 2) if bad else [])
        rows.append((i, " ".join(words), "spam" if bad and rng.random() < 0.9 else rng.choice(["s1", "s2"]), "en", len(words)))
        if i < 150:
            labels.append((i, int(not bad), 0))
    rows += rows[200:220]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(parts)
    return rows, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i for i, _, _ in labels}


def test_labels_of_a_round_by_id(spark, monkeypatch):
    """The labels that the first round hands over are those of the documents whose scores, taken
    from the models one by one, reach the limits found by sorting."""
    rows, docs, labels, known = corpus(spark, 3)
    seen, own = [], cotraining.limits_of
    monkeypatch.setattr(cotraining, "limits_of", lambda scores, share: seen.append((scores.collect(), own(scores, share), share)) or seen[-1][1])
    models, fits = [], cotraining.handing
    monkeypatch.setattr(cotraining, "handing", lambda every, k, rounds: models.append([m for m, _ in rounds]) or fits(every, k, rounds))
    judge = cotraining.train(docs, labels, scratch=Scratch(spark), rounds=1)
    scores, limits, share = seen[0]
    assert {r["doc_id"] for r in scores} == {r[0] for r in rows} - known
    handed = 0
    for v, features in (("text", lambda r: cotraining.text_features(r[1])), ("page", lambda r: cotraining.page_features(*r[2:]))):
        p = {r[0]: float(1 / (1 + np.exp(-models[0][0][v].logits([features(r)])[0]))) for r in rows if r[0] not in known}
        for r in scores:
            assert abs(r[f"{v}_p"] - p[r["doc_id"]]) < 1e-6
        want = by_sorting([(r[f"{v}_p"], None) for r in scores], v, share)
        ids = {r["doc_id"]: r[f"{v}_p"] > 0.5 for r in scores if max(r[f"{v}_p"], 1 - r[f"{v}_p"]) >= want[r[f"{v}_p"] > 0.5] * (1 - 1e-12)}
        told = {r["doc_id"]: r[f"{v}_p"] > 0.5 for r in scores if max(r[f"{v}_p"], 1 - r[f"{v}_p"]) >= limits[v][r[f"{v}_p"] > 0.5]}
        assert told == ids and judge.handed[v] == [len(ids)]
        handed += len(ids)
    assert handed > 5


def test_reruns_agree_under_other_partitionings(spark):
    got = []
    for parts in (1, 6):
        _, docs, labels, _ = corpus(spark, parts)
        got.append(sorted((r["doc_id"], r["text_score"], r["page_score"], r["score"], r["kept"]) for r in cotraining.classify(docs, labels, ["doc_id"]).collect()))
    assert got[0] == got[1]


def test_samples_are_bounded_by_their_features(spark, monkeypatch):
    monkeypatch.setattr(cotraining, "FEATURES", 900)
    taken, own = [], cotraining.fetched
    monkeypatch.setattr(cotraining, "fetched", lambda *a: taken.append(own(*a)) or taken[-1])
    _, docs, labels, _ = corpus(spark, 3)
    cotraining.train(docs, labels, rounds=2)
    assert len(taken) == 5 and taken[0]
    for k, sample in enumerate(taken):
        assert sum(len(r[0]) for r in sample) <= 900 * (2 if k == 0 else 1)  # words bound a text's features but for its ratios' ten
