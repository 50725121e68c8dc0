"""Sharding by extendible hashing, with DataFrame functions only.

The directory is indexed by the leading bits of a row's hash. A bucket whose
bytes exceed the limit is split on one more bit, and no other bucket is, until
every shard fits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import Scratch, chosen, restored, table, without

#: Bits of a hash, all of which the directory may use.
BITS = 60
#: Bits that one look at the table resolves beyond those that even buckets need.
AHEAD = 6
#: Bytes of text a shard may hold.
LIMIT = 16 << 20


def row_hash(doc_id: Column, text: Column) -> Column:
    """BITS bits of a digest of id and text; nulls are empty."""
    parts = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(parts), 1, BITS // 4), 16, 10).cast("long")


def prefix(depth: int) -> Column:
    """The leading bits of column hash as a number."""
    return F.shiftrightunsigned("hash", BITS - depth)


def directory(hashed: DataFrame, limit: int, scratch: Scratch) -> list[tuple[int, DataFrame]]:
    """The directory over (hash, bytes): by depth of look, (cell, depth, bits,
    shard_bytes) with the shard of each cell, a cell being a prefix of that depth.

    Bytes are summed once for cells of some bits more than even buckets need;
    their sums give those of all shorter prefixes, and a cell's shard is its
    shortest prefix that fits. Cells that don't fit as a whole are looked at
    again with more bits, those of BITS bits stay. There are about 2**AHEAD
    cells for each shard, and the driver sees none of them.
    """
    total = hashed.agg(F.sum("bytes")).first()[0] or 0
    looks, todo, least, deep = [], hashed, 0, math.ceil(math.log2(max(1, total / limit)))
    while True:
        deep = min(BITS, deep + AHEAD)
        cells = todo.groupBy(prefix(deep).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        paths = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(least), F.lit(deep))).alias("depth")).withColumn("bits", F.expr(f"shiftrightunsigned(cell, {deep} - depth)"))
        sums = paths.groupBy("depth", "bits").agg(F.sum("bytes").alias("shard_bytes"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.lit(deep == BITS) & (F.col("depth") == deep)))
        found = paths.drop("bytes").join(fits, ["depth", "bits"]).groupBy("cell").agg(F.min(F.struct("depth", "bits", "shard_bytes")).alias("s")).select("cell", "s.*")
        found = scratch.keep(found)
        looks.append((deep, found))
        if total <= limit or deep == BITS:
            return looks
        over = cells.where(F.col("bytes") > limit).select("cell")
        if over.isEmpty():
            return looks
        todo, least = scratch.keep(todo.join(over, prefix(deep) == over["cell"], "left_semi")), deep + 1


def shard(docs: DataFrame, limit: int = LIMIT, carry: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """docs (or its columns carry) with bytes, shard (its bits as a string; of an
    undivided table, ''), page and shard_bytes.

    bytes are those of the text in UTF-8; of a null or empty text, 0. A row's hash is of
    doc_id and text, so repeated ids with other texts part. Equal rows can't be
    parted by bits: where they alone exceed the limit, their shard has overflow
    pages, each within the limit unless one text exceeds it. Elsewhere page is
    0. A text longer than the limit is whole, in a shard or page of its own. Columns
    of docs named like these are replaced; an empty table gives none.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    carry = without(docs, *MADE) if carry is None else carry
    source = chosen(docs, carry, doc_id="doc_id", text="text")
    rows = source.select("row", row_hash(F.col("doc_id"), F.col("text")).alias("hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return restored(place(rows, directory(scratch.keep(rows.select("hash", "bytes")), limit, scratch), limit, scratch), carry, *MADE)


MADE = ("bytes", "shard", "page", "shard_bytes")


def place(rows: DataFrame, looks: list[tuple[int, DataFrame]], limit: int, scratch: Scratch) -> DataFrame:
    """rows (row, hash, bytes) in their shards. Each look has other cells."""
    if len(looks) > 1:
        keyed = rows.withColumn("key", F.explode(F.array(*[F.struct(F.lit(d).alias("look"), prefix(d).alias("cell")) for d, _ in looks])))
        keyed = keyed.select("row", "hash", "bytes", "key.look", "key.cell")
    else:
        keyed = rows.select("*", F.lit(looks[0][0]).alias("look"), prefix(looks[0][0]).alias("cell"))
    entries = None
    for d, found in looks:
        one = found.select(F.lit(d).alias("look"), "cell", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(bits), depth, '0')")).alias("shard"), "shard_bytes", "depth")
        entries = one if entries is None else entries.unionByName(one)
    out = keyed.join(entries, ["look", "cell"]).withColumn("page", F.lit(0).cast("long"))
    stuck = (F.col("depth") == BITS) & (F.col("shard_bytes") > limit)
    if looks[-1][0] == BITS and not entries.where(stuck).isEmpty():
        out = out.where(~stuck).unionByName(paged(out.where(stuck), limit, scratch))
    return out.select("row", *MADE)


def paged(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """rows of hashes that exceed the limit alone, with their pages. They are written
    and numbered inside the parts that they are written in, of which sums tell where
    each part begins, so that no task has all rows of a hash."""
    rows = scratch.keep(rows.drop("page").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1))))
    counts = rows.groupBy("hash", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("hash", "part", (F.sum("n").over(Window.partitionBy("hash").orderBy("part")) - F.col("n")).alias("before"))
    row = F.row_number().over(Window.partitionBy("hash", "part").orderBy("at")) + F.col("before")
    return rows.join(before, ["hash", "part"]).withColumn("page", F.floor((row - 1) / each).cast("long")).drop("part", "at", "before")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes each shard of docs as one Parquet file (a page of an overflowing
    shard as one), in a folder named b and its bits."""
    placed = shard(docs, limit).withColumn("shard", F.concat(F.lit("b"), "shard"))
    placed.repartition("shard", "page").sortWithinPartitions("shard", "page").write.partitionBy("shard", "page").parquet(path)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), carry=["doc_id"])


#: For tables where no row exceeds the limit: then no shard has pages.
SQL = f"""
WITH h AS (
  SELECT doc_id, row_number() OVER () AS r, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {BITS // 4}) AS BIGINT) AS hash,
    CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes FROM documents
), cells AS (
  SELECT doc_id, r, bytes, d, hash >> ({BITS} - d) AS bits FROM (SELECT *, unnest(range(0, {BITS} + 1)) AS d FROM h)
), sums AS (
  SELECT *, CAST(sum(bytes) OVER (PARTITION BY d, bits) AS BIGINT) AS shard_bytes FROM cells
), fit AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY d) AS k FROM sums WHERE shard_bytes <= {LIMIT} OR d = {BITS}
)
SELECT doc_id, bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(bits), CAST(d AS INTEGER), '0') END AS shard, CAST(0 AS BIGINT) AS page, shard_bytes FROM fit WHERE k = 1
"""
