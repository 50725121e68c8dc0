"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target and so a repetition
rate, and each document is emitted floor(rate) times plus one more time with
the rate's fraction as probability, decided by a hash of its id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import Scratch, chosen, restored, table, without, word_count


#: Draws of a document among which its source chooses.
SEEDS = 16


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) of (source, size).

    Sources stand by code point, null last, and weigh as weights say, over and
    over. They share `share` times all sizes by weight; none gets more than
    `most` times its own size, and what it can't take goes to the others by
    weight. That level is found by sorting sources by the level at which each
    is full: the first source that isn't full at the level that is left to it
    and those behind it fixes the level for all. The table has one row a
    source, so its windows are small whatever the documents are.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    kinds = F.array(*[F.lit(int(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(kinds, ((rank - 1) % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("full_at", F.col("source_size") * F.lit(float(most)) / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, behind, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(most))) / F.sum("weight").over(behind))
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(whole)["level"])
    return per.select("source", "source_size", F.least(F.col("source_size") * F.lit(float(most)), F.coalesce(F.col("level") * F.col("weight"), F.lit(float("inf")))).alias("target"))


def draw(name: Column, k: int, seed: str) -> Column:
    """The k-th of the draws of what is so named, uniform in [0, 1): 32 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{k // 4}:"), name))
    return F.conv(F.substring(digest, k % 4 * 8 + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def named(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Written rows (doc_id, content, part, at) with the name that they draw by: the
    id, and where several rows have it, their content and a number among the equal ones,
    so that they don't share a draw. Numbers count inside the parts that rows were
    written in, and sums tell where each part begins: no task has all rows of an id."""
    rows = rows.withColumn("name", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    several = scratch.keep(rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"))
    if several.isEmpty():
        return rows
    rest = rows.select("name", "content", "part", "at").join(several, "name", "left_semi")
    counts = rest.groupBy("name", "content", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("name", "content", "part", (F.sum("n").over(Window.partitionBy("name", "content").orderBy("part")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("name", "content", "part").orderBy("at")) + F.col("before")
    longer = rest.join(before, ["name", "content", "part"]).select("at", F.concat_ws(":", "name", F.col("content").cast("string"), number.cast("string")).alias("longer"))
    return rows.join(scratch.keep(longer), "at", "left").withColumn("name", F.coalesce("longer", "name")).drop("longer")


def with_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """sizes with its source's columns of targets, and the rate's whole part and fraction."""
    of = targets.withColumnRenamed("source", "of")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    joined = sizes.join(of, sizes["source"].eqNullSafe(of["of"])).drop("of")
    return joined.withColumn("whole", F.floor(rate)).withColumn("fraction", rate - F.floor(rate))


def source_seeds(sizes: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """targets with k: which of SEEDS draws brings the source's taken words
    nearest to its target. One long document else moves a small source far."""
    drawn = with_rates(sizes, targets)
    taken = [F.sum(F.col("size") * (F.col("whole") + (draw(F.col("name"), k, seed) < F.col("fraction")).cast("long"))) for k in range(SEEDS)]
    sums = drawn.groupBy("source", "source_size", "target").agg(*[t.alias(f"t{k}") for k, t in enumerate(taken)])
    off = [F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(SEEDS)]
    return sums.select("source", "source_size", "target", F.least(*off)["k"].alias("k"))


MADE = ("size", "source_size", "target", "copies")


def planned(docs: DataFrame, carry: list[str], weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix", scratch: Scratch | None = None) -> DataFrame:
    """(row: columns carry of docs, and MADE)."""
    scratch = scratch or Scratch(docs.sparkSession)
    source = chosen(docs, carry, doc_id="doc_id", text="text", source="source")
    rows = source.select("row", "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("content"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    # Written once: texts are counted once, and rows keep their places.
    rows = named(scratch.keep(rows), scratch).drop("doc_id", "content", "part", "at")
    targets = scratch.keep(source_targets(rows, weights, share, most))
    # A written table has a known size: if it is small, the rows aren't shuffled to meet it.
    seeds = scratch.keep(source_seeds(rows.drop("row"), targets, seed))
    best = F.coalesce(*[F.when(F.col("k") == k, draw(F.col("name"), k, seed)) for k in range(SEEDS)])
    return with_rates(rows, seeds).withColumn("copies", (F.col("whole") + (best < F.col("fraction")).cast("long")).cast("long")).select("row", *MADE)


def mix_plan(docs: DataFrame, carry: list[str] | None = None, **options) -> DataFrame:
    """docs (or its columns carry) with size, source_size, target and copies.

    Options are weights, share, most, seed and scratch, see source_targets and draw. A
    null or empty text has size 0 and is copied like others of its source; a very long
    one counts whole. A null source is a source. Reruns agree, as draws are digests of
    seed and doc_id; rows that share an id, or have none, draw by their texts too, and
    equal rows by their number. Each source uses the one of SEEDS draws whose total is
    nearest to its target. Columns of docs named like these four are replaced. An empty
    table gives none.
    """
    carry = without(docs, *MADE) if carry is None else carry
    return restored(planned(docs, carry, **options), carry, *MADE)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: docs' rows, each as often as mix_plan says."""
    copies = planned(docs, docs.columns, **options).where("copies > 0")
    return restored(copies.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))), docs.columns)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM docs GROUP BY source
), weighed AS (
  SELECT *, CASE r % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS weight FROM per
), capped AS (
  SELECT *, source_size * 2.0::DOUBLE / weight AS full_at FROM weighed
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
     - coalesce(sum(source_size) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0::DOUBLE)
     / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM capped
), targets AS (
  SELECT source, source_size,
    least(source_size * 2.0::DOUBLE, (SELECT arg_min(level, full_at) FROM levels WHERE level <= full_at) * weight) AS target
  FROM levels
), rated AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0.0::DOUBLE) AS rate
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), drawn AS (
  SELECT *, CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix:' || (k // 4) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), k % 4 * 8 + 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM rated, (SELECT unnest(range(16)) AS k)
), sums AS (
  SELECT source, k, abs(sum(size * copies)::DOUBLE - any_value(target)) AS off FROM drawn GROUP BY source, k
), seeds AS (
  SELECT source, arg_min(k, (off, k)) AS k FROM sums GROUP BY source
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies
FROM drawn d JOIN seeds s ON d.source IS NOT DISTINCT FROM s.source AND d.k = s.k
"""
