"""Extra columns named like anything that an operator makes, and names with dots."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, cotraining, decontamination, jaccard, mixing, quality, scoring, secrets, sharding, substrings

NAMES = sorted({
    "a.b", "with`tick", "two words", "row", "c0", "c1", "f0", "key", "name", "at", "part", "content", "k", "n", "good", "depth", "hash", "look", "cell", "bits",
    "page", "shard", "bytes", "shard_bytes", "size", "copies", "target", "source_size", "whole", "fraction", "stratum", "of", "cut_symbols", "n_words", "kept",
    "base", "spans", "hits", "items", "had_hits", "text_features", "page_features", "score", "x", "node", "component", "set", "several", "range", "slice", "cluster", "keeper",
})
BASE = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def table(spark, names):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{words} {i} of its own" if i % 3 else None, "en", "s", 9, *range(len(names))) for i in range(9)]
    return spark.createDataFrame(rows, ", ".join([f"{n} {k}" for n, k in BASE.items()] + ["`" + n.replace("`", "``") + "` int" for n in names]))


def labels(spark):
    return spark.createDataFrame([(i, int(i % 2), 0, "x") for i in range(9)], "doc_id long, quality int, toxic int, good string")


def benchmark(spark):
    return spark.createDataFrame([(1, "of its own", "x")], "item_id long, text string, item string")


OPERATORS = {
    "find_secrets": lambda s, d: secrets.find_secrets(d),
    "judge": lambda s, d: quality.judge(d, labels(s), d.columns),
    "find_benchmark": lambda s, d: decontamination.find_benchmark(d, benchmark(s), pass_bytes=5),
    "classify": lambda s, d: cotraining.classify(d, labels(s)),
    "mix_plan": lambda s, d: mixing.mix_plan(d),
    "mix": lambda s, d: mixing.mix(d),
    "shard": lambda s, d: sharding.shard(d, 100),
    "one_of_each": lambda s, d: jaccard.one_of_each(d),
    "jaccard_join": lambda s, d: jaccard.jaccard_join(d),
    "dedup_substrings": lambda s, d: substrings.dedup_substrings(d),
    "score": lambda s, d: scoring.score(d),
}


@pytest.mark.parametrize("operator", OPERATORS)
@pytest.mark.parametrize("upper", [False, True])
def test_operators(spark, operator, upper):
    docs = table(spark, [n.upper() if upper else n for n in NAMES])
    own = docs.collect()
    out = OPERATORS[operator](spark, docs)
    rows = out.collect()
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    if operator in ("jaccard_join", "dedup_substrings", "score"):
        return
    # What is carried is what was there.
    whole = {r["doc_id"]: r.asDict() for r in own}
    made = {"find_secrets": {"base", "spans"}, "judge": {*quality.MEASURES, "n_lines", "base_failed", "kept"}, "find_benchmark": {"n_words", "hits", "items"}, "classify": {"text_score", "page_score", "score", "kept"}, "mix_plan": set(mixing.MADE), "shard": set(sharding.MADE)}.get(operator, set())
    for r in rows:
        assert all(r[c] == whole[r["doc_id"]][c] for c in docs.columns if c.lower() not in made)


def test_conversations(spark):
    names = [n for n in NAMES if n not in ("a.b",)] + ["A.B"]
    source = spark.createDataFrame([(1, 0, "user", "hi", *range(len(names)))], "conv_id long, turn long, role string, text string, " + ", ".join("`" + n.replace("`", "``") + "` int" for n in names))
    nodes, paths = chat.pack(source)
    assert nodes.count() == paths.count() == 1


@pytest.mark.parametrize("upper", [False, True])
def test_pipeline_stages(spark, upper, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark, [n.upper() if upper else n for n in NAMES])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        assert stage(spark, docs.where(F.lit(True)), str(tmp_path)).count() >= 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 9
