import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, sharding
from millrace.llm.sharding import shard


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, SHARD int")


ROWS = [(1, "a b c", "x", "s", 1), (2, "", "x", "s", 1), (3, None, "y", "s", 1), (4, "w " * 100, None, "s", 1), (4, "w " * 100, None, "s", 1), (5, "q r\ts", "B", None, None), (None, "n n", "B", None, None)]


def filled(sizes, weights, share):
    """Targets by resharing round after round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            break
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > 2 * sizes[s]]
        if not over:
            return {s: 2 * sizes[s] if s in full else unit * weight[s] for s in names}
        for s in over:
            full.add(s)
            left -= 2 * sizes[s]
    return {s: 2 * sizes[s] for s in names}


def test_targets_match_resharing(spark):
    for sizes in ({"a": 10, "b": 100, "c": 3, None: 7}, {"a": 5}, {"a": 0, "b": 9}, {"é": 50, "z": 1, "A": 2, "b": 1000, "c": 4}):
        table = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
        want = filled(sizes, (3, 1, 2), 1.5)
        assert got == pytest.approx(want)


def test_mix_plan(spark):
    got = mixing.mix_plan(docs(spark, ROWS))
    assert [c for c in got.columns if c.lower() == "size"] == ["size"]
    rows = got.collect()
    assert len(rows) == len(ROWS)
    by = {(r["doc_id"], r["source"]): r for r in rows}
    assert by[(5, "B")]["size"] == 2 and by[(3, "y")]["size"] == 0

    # Both rows of id 4 are equal: they draw by their text and number.
    content = spark.range(1).select(F.xxhash64(F.lit("w " * 100))).first()[0]
    names, numbers = {}, iter((1, 2))
    for r in rows:
        names[id(r)] = "null" if r["doc_id"] is None else f"4:{content}:{next(numbers)}" if r["doc_id"] == 4 else str(r["doc_id"])

    def copies(r, k):
        rate = r["target"] / r["source_size"] if r["source_size"] else 0.0
        digest = hashlib.md5(f"mix:{k // 4}:{names[id(r)]}".encode()).hexdigest()
        return int(rate) + (int(digest[k % 4 * 8 :][:8], 16) / 2**32 < rate - int(rate))

    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        best = min(range(mixing.SEEDS), key=lambda k: (abs(sum(r["size"] * copies(r, k) for r in own) - own[0]["target"]), k))
        assert sorted(r["copies"] for r in own) == sorted(copies(r, best) for r in own)
        assert all(r["copies"] <= 2 for r in own)


def test_mix_repeats_whole_rows(spark):
    source = docs(spark, ROWS)
    plan = {}
    for r in mixing.mix_plan(source).collect():
        plan[(r["doc_id"], r["text"])] = plan.get((r["doc_id"], r["text"]), 0) + r["copies"]
    got = mixing.mix(source)
    assert got.columns == source.columns
    counts = {}
    for r in got.collect():
        counts[(r["doc_id"], r["text"])] = counts.get((r["doc_id"], r["text"]), 0) + 1
    for (i, text), copies in plan.items():
        assert counts.get((i, text), 0) == copies


def test_rows_of_one_id_come_near_their_target(spark):
    rows = [(7, "a b c d e", "s", "", 1)] * 50 + [(None, f"a b c d {i}", "t", "", 1) for i in range(50)] + [(i, "w " * 400, "u", "", 1) for i in range(100, 110)]
    plans = [sorted((str(r["doc_id"]), r["text"], r["copies"]) for r in mixing.mix_plan(docs(spark, rows).repartition(n)).collect()) for n in (1, 3)]
    assert plans[0] == plans[1]
    for r in mixing.mix_plan(docs(spark, rows)).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= max(0.05 * r["target"], 400)


def test_empty(spark):
    assert mixing.mix_plan(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [])).count() == 0
    assert shard(docs(spark, []), 100).count() == 0


def splits(hashes, limit):
    """Shards by splitting, one bit after the other: (depth, bits) to rows."""
    done, todo = {}, [(0, 0, hashes)]
    while todo:
        depth, bits, rows = todo.pop()
        if sum(b for _, b in rows) <= limit or depth == sharding.BITS:
            if rows:
                done[(depth, bits)] = rows
            continue
        for bit in (0, 1):
            todo.append((depth + 1, bits * 2 + bit, [(h, b) for h, b in rows if (h >> (sharding.BITS - 1 - depth)) & 1 == bit]))
    return done


def test_shards_are_those_of_splitting(spark):
    rows = [(i, "t" * (i * 37 % 90), "s", None, None) for i in range(400)]
    source = docs(spark, rows)
    hashes = [(r["h"], r["b"]) for r in source.select(sharding.row_hash(F.col("doc_id"), F.col("text")).alias("h"), F.octet_length("text").alias("b")).collect()]
    for limit in (100, 1500, 10**6):
        want = {(format(bits, f"0{depth}b") if depth else "", sum(b for _, b in own)) for (depth, bits), own in splits(hashes, limit).items()}
        got = shard(source, limit)
        assert {(r["shard"], r["shard_bytes"]) for r in got.collect()} == want
        assert got.count() == 400
        assert got.groupBy("shard").agg(F.sum("bytes").alias("b"), F.first("shard_bytes").alias("s")).where("b <> s").count() == 0


def test_equal_rows_overflow_into_pages(spark):
    got = shard(docs(spark, [(1, "x" * 40, "s", None, None)] * 50 + ROWS + [(9, "y" * 500, "s", None, None)]), 100)
    assert got.count() == 58
    pages = got.groupBy("shard", "page").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] <= 100 or r["n"] == 1 for r in pages)


def test_write_shards(spark, tmp_path):
    sharding.write_shards(docs(spark, [(i, "t" * 50, "s", None, None) for i in range(40)]), str(tmp_path / "out"), 600)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40
    assert back.groupBy("shard").agg(F.sum("bytes").alias("b")).where("b > 600").count() == 0
