"""Cutoffs that are certified: by hand with exact binomials, and in the pipeline with shards that split."""

import functools
import math
import random
from fractions import Fraction

import corpus_pipeline
from test_decontamination import brute as search
from test_jaccard import brute as join
from test_text_operators import measured_by_hand

from millrace.llm import mixing, quality, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rng, n):
    return [rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnop") + rng.choice("xyz") for _ in range(n)]


def ratios(text):
    n, chars, symbols, dup, repeats = measured_by_hand(text)
    lines = sum(bool(line.strip(" \t\n\v\f\r")) for line in text.split("\n"))
    return {"symbols": symbols / max(chars, 1), "dup_lines": dup / max(lines, 1), "repeats": repeats / max(n, 1), "long_words": chars / max(n, 1) / 40}, n < 50 or 100 * repeats > 50 * n


def certain(lost, n, most, error):
    """Whether a binomial of n with probability most is at most lost with a chance of at most error, exactly."""
    p, q = most.numerator, most.denominator - most.numerator
    return n > 0 and lost < n * most and sum(math.comb(n, k) * p**k * q ** (n - k) for k in range(lost + 1)) * error.denominator <= error.numerator * most.denominator**n


def cutoffs_by_hand(docs, good):
    """{stratum: {rule: cutoff}} of docs (id, text, stratum)."""
    own = {}
    for i, text, stratum in docs:
        r, failed = ratios(text)
        if i in good and not failed:
            own.setdefault(stratum, []).append(r)
    share = Fraction(5, 100) / (len(quality.RULES) * len(own))
    out = {}
    for stratum, rows in own.items():
        for rule in quality.RULES:
            for k in range(39, 0, -1):
                if not certain(sum(r[rule] > k / 40 for r in rows), len(rows), Fraction(2, 100) / len(quality.RULES), share):
                    break
                out.setdefault(stratum, {})[rule] = k / 40
    return out


def kept_by_hand(docs, good):
    cut = cutoffs_by_hand(docs, good)
    out = {}
    for i, text, stratum in docs:
        r, failed = ratios(text)
        out[i] = not failed and not any(r[rule] > c for rule, c in cut.get(stratum, {}).items())
    return out, cut


def test_cutoffs_and_verdicts_by_exact_binomials(spark):
    rng = random.Random(31)

    def text(most):
        words = plain(rng, 60)
        if rng.random() < 0.3:
            words = [w + "#" * rng.randint(0, most) for w in words]
        if rng.random() < 0.02:
            words = [w + "####" for w in words]
        lines = [" ".join(words[k : k + 10]) for k in range(0, 60, 10)]
        return "\n".join(lines + lines[: rng.choice([0, 0, 0, 1, 2])])

    docs, good = [], set()
    for stratum, n in (("en", 1700), ("fr", 1250), (None, 2100), ("de", 200)):
        for _ in range(n):
            docs.append((len(docs), text({"fr": 1, None: 4}.get(stratum, 2)), stratum))
            if rng.random() < 0.97:
                good.add(docs[-1][0])
            elif rng.random() < 0.7:
                docs[-1] = (docs[-1][0], docs[-1][1].replace(" ", "#" * 25 + " "), stratum)
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i in good), 0) for i, _, _ in docs], "doc_id long, quality int, toxic int")
    want, cut = kept_by_hand(docs, good)
    assert set(cut) == {"en", "fr", None} and min(map(len, cut.values())) >= 3  # of 200 labels nothing can be certified
    assert len({cut[s]["symbols"] for s in cut}) > 1
    got = {r["doc_id"]: r["kept"] for r in quality.judge(table, labels, ["doc_id"]).collect()}
    assert got == want and 0 < sum(not k for k in got.values()) < 200


def test_pipeline_with_a_certified_cutoff_and_shards_that_split(spark, tmp_path, monkeypatch):
    rng = random.Random(33)
    items = [(i, " ".join(plain(rng, 14))) for i in range(4)]
    rows = []
    for i in range(1500):
        words = plain(rng, rng.randint(55, 75))
        if i % 40 == 3:
            words = rows[-1][1].split()[:-1] + ["changed"]
        if i % 60 == 5:
            words[7:7] = items[i % 4][1].split()
        if i % 50 == 9:
            words = [w + "%%%%" for w in words]  # rejected by a certified cutoff alone
        rows.append((i, " ".join(words), "en", rng.choice(["s", "t", None]), 5))
    good = {i for i in range(1500) if i % 50 != 9}
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i in good), 0) for i in range(1500)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    limit = 20_000
    monkeypatch.setattr(corpus_pipeline.sharding, "shard", functools.partial(sharding.shard, limit=limit))

    verdict, cut = kept_by_hand([r[:3] for r in rows], good)
    assert "symbols" in cut["en"] and not any(ratios(r[1])[1] for r in rows)
    kept = [r for r in rows if verdict[r[0]]]
    assert len(kept) == 1470
    tops = {i: top for i, _, top in join([(r[0], r[1]) for r in kept])}
    kept = [r for r in kept if tops[r[0]] == r[0]]
    kept = [r for r, (_, h, _) in zip(kept, search([r[1] for r in kept], items), strict=True) if not h]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(spark.createDataFrame(kept, DOCS)).collect()}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in kept for _ in range(copies[r[0]]))
    shards = {}
    for r in got:
        assert r["bytes"] == len(r["text"].encode())
        shards.setdefault(r["shard"], []).append(r)
    total = lambda bits: sum(r["bytes"] for s, own in shards.items() if s.startswith(bits) for r in own)
    assert len(shards) > 8
    for s, own in shards.items():
        assert {r["shard_bytes"] for r in own} == {total(s)} and total(s) <= limit < total(s[:-1])
        assert not any(o != s and o.startswith(s) for o in shards)
