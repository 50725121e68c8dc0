"""Isotonic calibration: the rates that rise with the score and fit outcomes best.

Scores are whole numbers, so ranges of equal width hold a bounded number of
distinct ones. Adjacent violators are pooled inside each range, and the blocks
that are left are pooled again where ranges meet, several ranges at a time:
pooling is associative, so the curve is that of all scores together. Blocks
have strictly rising rates of whole numbers; n rows leave at most about
2.1 n^(2/3) of them, however many scores there are, which bounds the last group.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.calibration import settled

#: Distinct scores of a range, and ranges whose blocks are pooled in one task.
WIDTH, FAN = 65_536, 16

Block = tuple[int, int, int, int]


def pooled(blocks: Iterable[Block]) -> list[Block]:
    """Blocks (low, high, n, hits), sorted, with those pooled whose rates don't rise."""
    out: list[Block] = []
    for block in blocks:
        low, high, n, hits = block
        while out and out[-1][3] * n >= hits * out[-1][2]:
            first, _, m, k = out.pop()
            low, n, hits = first, n + m, hits + k
        out.append((low, high, n, hits))
    return out


def pool(part: pa.Table) -> pa.Table:
    """The blocks of one group of ranges."""
    names = ("low", "high", "n", "hits")
    part = part.sort_by("low")
    blocks = pooled(zip(*[part.column(c).to_pylist() for c in names], strict=True))
    made = [pa.array([b[i] for b in blocks], pa.int64()) for i in range(4)]
    group = part.column("range")[0].as_py() if part.num_rows else 0
    return pa.table([pa.array([group] * len(blocks), pa.int64()), *made], names=["range", *names])


def isotonic_blocks(rows: DataFrame, per_one: int = 100, width: int = WIDTH, fan: int = FAN) -> DataFrame:
    """(low, high, n, hits, rate): the steps of the isotonic curve, each with the lowest
    and highest score (in units) that it holds. rate rises strictly with low.

    Rows (units, y) with a null in either are left out. Rows of a score are summed before
    anything is sorted, so a hot score is no hot task, and repeated rows count each. An empty
    table has no steps.
    """
    scores = settled(rows).groupBy("units").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"))
    kind = "range long, low long, high long, n long, hits long"
    blocks = scores.select(F.floor(F.col("units") / width).alias("range"), F.col("units").cast("long").alias("low"), F.col("units").cast("long").alias("high"), "n", F.col("hits").cast("long").alias("hits"))
    blocks = blocks.groupBy("range").applyInArrow(pool, kind)
    ranges, more = per_one // width + 1, True
    while more:
        # The last round takes what lies outside [0, 1] too.
        more = ranges > fan
        group = F.floor(F.col("range") / fan) if more else F.lit(0).cast("long")
        blocks, ranges = blocks.withColumn("range", group).groupBy("range").applyInArrow(pool, kind), -(-ranges // fan)
    return blocks.select("low", "high", "n", "hits", (F.col("hits").cast("double") / F.col("n")).alias("rate"))


def with_curve(rows: DataFrame, curve: DataFrame, width: int = WIDTH) -> DataFrame:
    """rows with fitted: the rate of isotonic_blocks' step at a row's units. A score between
    two steps has the lower one's rate, one below all steps the first's, and a null score
    null; so has every row where the curve is empty. A column named fitted is replaced.

    Each distinct score is looked up once, among the steps of its range and the last step
    of the ranges before; the window over ranges has a row each.
    """
    rows = rows.drop("fitted")
    steps = curve.select(F.floor(F.col("low") / width).alias("range"), F.col("low").alias("at"), F.lit(0).alias("side"), F.struct("low", "rate").alias("step"))
    scores = rows.where("units is not null").select(F.col("units").cast("long").alias("at")).distinct()
    scores = scores.select(F.floor(F.col("at") / width).alias("range"), "at", F.lit(1).alias("side"), F.lit(None).cast(steps.schema["step"].dataType).alias("step"))
    both = steps.unionByName(scores)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = both.groupBy("range").agg(F.max("step").alias("last")).select("range", F.last("last", ignorenulls=True).over(before).alias("inherited"))
    within = Window.partitionBy("range").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("step", F.last("step", ignorenulls=True).over(within)).where("side = 1").join(ranges, "range")
    first = F.broadcast(curve.agg(F.min(F.struct("low", "rate")).alias("first")))
    fitted = seen.join(first, F.lit(True)).select(F.col("at").alias("score"), F.coalesce("step", "inherited", "first")["rate"].alias("fitted"))
    return rows.join(fitted, rows["units"] == fitted["score"], "left").select(rows["*"], "fitted")
