"""The pipeline against a plain version of its stages on a small table."""

import corpus_pipeline
from test_decontamination import brute as search
from test_jaccard import brute as join
from test_text_operators import measured_by_hand

from millrace.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_small_corpus(spark, tmp_path):
    import random

    rng = random.Random(21)
    plain = lambda n: [rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnop") + rng.choice("xyz") for _ in range(n)]
    rows, items = [], [(i, " ".join(plain(14))) for i in range(4)] + [(9, None)]
    for i in range(60):
        words = plain(rng.randint(30, 130))
        if i % 10 == 3:
            words = rows[-1][1].split()[:-1] + ["changed"]
        if i % 12 == 5:
            words[7:7] = items[i % 4][1].upper().split()
        if i % 15 == 7:
            words = words[:3] * 40
        rows.append((i, " ".join(words), rng.choice(["en", None]), rng.choice(["s", "t", None]), 5))
    rows += [(60, None, "en", "s", 0), (61, "", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = []
    for r in rows:
        n, _, _, _, repeats = measured_by_hand(r[1])
        if not (n < 50 or 100 * repeats > 50 * n):
            kept.append(r)  # thirty labels certify no cutoff
    tops = {i: top for i, _, top in join([(r[0], r[1]) for r in kept])}
    assert any(i != top for i, top in tops.items())
    kept = [r for r in kept if tops[r[0]] == r[0]]
    hits = search([r[1] for r in kept], items)
    assert any(h for _, h, _ in hits)
    kept = [r for r, (_, h, _) in zip(kept, hits, strict=True) if not h]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(spark.createDataFrame(kept, DOCS)).collect()}
    want = sorted(r[0] for r in kept for _ in range(copies[r[0]]))

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == want
    texts = {r[0]: r for r in rows}
    assert all(tuple(r)[:5] == texts[r["doc_id"]] for r in got)
    assert {r["shard"] for r in got} == {""}


def test_stages():
    assert len(corpus_pipeline.STAGES) == 5
