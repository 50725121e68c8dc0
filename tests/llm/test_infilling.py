import hashlib
import random

import pytest

from millrace.llm import infilling

TEXTS = [None, "", "\n", "a", "a\n", "a\nb", "\n\n\n", "é\nü\n👍\n日本", "x<P>y\nz", "<S>", "a<M", "<P\n>S\n<", "<\nS>\n<M\n>", "line\r\nwith\x0b marks\n", "z" * 300_000 + "\n" + "y\n" * 50_000]


def lines(text):
    """The units by hand."""
    out = text.split("\n")
    return [x + "\n" for x in out[:-1]] + ([out[-1]] if out[-1] else [])


def by_hand(name, text, seed=7):
    units, h = lines(text), hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = min(h1 % (len(units) + 1), h2 % (len(units) + 1)), max(h1 % (len(units) + 1), h2 % (len(units) + 1))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return len(units), "spm", len(prefix), len(middle), "<S>" + suffix + "<P>" + prefix + "<M>" + middle
    return len(units), "psm", len(prefix), len(middle), "<P>" + prefix + "<S>" + suffix + "<M>" + middle


def test_on_spark(spark):
    rng = random.Random(1)
    made = TEXTS + ["".join(rng.choice("ab\n<>PSM ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    rows = [(i, t, i, "clash") for i, t in enumerate(made)] + [(2, "a\nb\nc", -1, "x"), (2, "a\nb\nc", -1, "x"), (None, "p\nq\nr", -2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, FORM string")
    out = infilling.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "a.b", *infilling.MADE]
    back = out.withColumn("back", infilling.rebuilt(out["output"], out["form"])).collect()
    assert len(back) == len(rows)
    for r in back:
        text = r["text"] or ""
        n, form, prefix, middle, output = by_hand("" if r["doc_id"] is None else r["doc_id"], text)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == (n, form, prefix, middle, output)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["back"] == text
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}


def test_rates(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(2000)], "doc_id long, text string")
    some = infilling.fill_in_middle(docs, rate=30, suffix_first=20).groupBy("form").count().collect()
    share = {r["form"]: r["count"] / 2000 for r in some}
    assert share["plain"] == pytest.approx(0.7, abs=0.05) and share["spm"] == pytest.approx(0.06, abs=0.03)


def test_empty_table(spark):
    assert infilling.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
