"""Stupid-backoff scores of documents under the corpus that they are part of.

Documents are gathered in slices of bounded size, kept as the places of their words
in the slice's vocabulary. A slice's distinct n-grams with their counts are dealt
into ranges of their hash, where the counts of all slices meet; each slice gets back
how often the other slices have its n-grams, takes off each document's own, and sums
the scores per document. Rows of this exchange are packed, as one row an n-gram would
be several times the input: a row has what one slice and one range share, as
differences of sorted hashes, so its bytes follow from the n-grams and hardly from
the number of ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, chosen, spread, squeezed, table, window_hashes, word_hashes

#: What a step to a shorter n-gram costs.
BACKOFF = 0.4
#: Words of the longest n-gram.
ORDER = 3
#: Bits of a word's hash.
WORD_BITS = 56
#: Bits of an n-gram's hash: at least so many, and SPARE more than number the words.
LEAST_BITS, SPARE = 52, 24
#: Words after which a slice is full. A longer text is a slice of its own, never cut.
SLICE_WORDS = 1 << 19


def words(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


def packed_slice(ids: list, hashes: list[np.ndarray]) -> tuple:
    """(ids, lengths, vocabulary, places, n_words) of some documents' word hashes.
    Frequent words have low places, and the many of one count ascend: both compress well."""
    flat = np.concatenate(hashes)
    vocabulary, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    lengths = np.array([len(h) for h in hashes], np.uint32)
    return ids, squeezed(lengths), squeezed(np.diff(vocabulary[order], prepend=np.uint64(0))), squeezed(rank[inverse]), len(flat)


def sliced(docs: DataFrame, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(ids, lengths, vocabulary, places, n_words): slices of docs (doc_id, text)."""
    names = ["ids", "lengths", "vocabulary", "places", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def row(ids: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
            values = packed_slice(ids, hashes)
            kinds = [pa.list_(kind), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        ids, hashes, size = [], [], 0
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                hashes.append(word_hashes(words(text.as_py() or "")) >> np.uint64(64 - WORD_BITS))
                size += len(hashes[-1])
                if size >= slice_words:
                    yield row(ids, hashes)
                    ids, hashes, size = [], [], 0
        if ids:
            yield row(ids, hashes)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"ids array<{kind}>, lengths binary, vocabulary binary, places binary, n_words long")


class Slice:
    """A slice's word hashes and, for each position, its document and the place in it."""

    def __init__(self, lengths: bytes, vocabulary: bytes, places: bytes):
        self.lengths = spread(lengths, "u4").astype(np.int64)
        self.flat = np.cumsum(spread(vocabulary, "u8"), dtype=np.uint64)[spread(places, "u4")]
        self.of = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.at = np.arange(len(self.flat)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def grams(self, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams, none over the end of a document, and where they end."""
        ends = np.flatnonzero(self.at >= order - 1)
        mixed = window_hashes(self.flat, order)[ends - order + 1]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
        return mixed >> np.uint64(64 - bits), ends


def bounds(ranges: int, bits: int) -> np.ndarray:
    """The first hash of each range."""
    return np.array([-(-(r << bits) // ranges) for r in range(ranges)], np.uint64)


def dealt(slices: DataFrame, orders: int, ranges: int, bits: int) -> DataFrame:
    """(range, slice, and for each order the differences of the sorted distinct hashes
    and their counts) of slices (slice, lengths, vocabulary, places)."""
    names = ["range", "slice", *[f"{p}{n}" for n in range(1, orders + 1) for p in ("hashes", "counts")]]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * (2 * orders)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = bounds(ranges, bits)
        for batch in batches:
            for number, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, parts = Slice(*packed), []
                for order in range(1, orders + 1):
                    kinds_of, counts = np.unique(own.grams(order, bits)[0], return_counts=True)
                    parts.append((kinds_of, counts.astype(np.uint32), np.append(np.searchsorted(kinds_of, first), len(kinds_of))))
                rows = []
                for r in np.flatnonzero(sum(np.diff(edges) for _, _, edges in parts)).tolist():
                    row = [r, number]
                    for kinds_of, counts, edges in parts:
                        part = slice(edges[r], edges[r + 1])
                        row += [squeezed(np.diff(kinds_of[part], prepend=first[r])), squeezed(counts[part])]
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=names)

    return slices.mapInArrow(run, "range int, slice long, " + ", ".join(f"{n} binary" for n in names[2:]))


def others_counts(orders: int, ranges: int, bits: int):
    """For each slice that has n-grams of a range, how often the others have them."""
    names = ["slice", "range", *[f"rest{n}" for n in range(1, orders + 1)]]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * orders]

    def run(rows: pa.Table) -> pa.Table:
        number = rows["range"][0].as_py()
        first, columns = bounds(ranges, bits)[number], [rows["slice"], rows["range"]]
        for n in range(1, orders + 1):
            hashes = [np.cumsum(spread(x.as_py(), "u8"), dtype=np.uint64) + first for x in rows[f"hashes{n}"]]
            counts = np.concatenate([spread(x.as_py(), "u4") for x in rows[f"counts{n}"]]).astype(np.int64)
            edges = np.cumsum([len(h) for h in hashes])[:-1]
            flat = np.concatenate(hashes)
            del hashes
            order = np.argsort(flat, kind="stable")
            ranked = flat[order]
            starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(flat) else np.zeros(0, np.int64)
            rest = np.empty(len(flat), np.int64)
            if len(flat):
                rest[order] = np.repeat(np.add.reduceat(counts[order], starts), np.diff(np.append(starts, len(flat))))
            rest -= counts
            columns.append(pa.array([squeezed(x.astype(np.uint32)) for x in np.split(rest, edges)], pa.binary()))
        return pa.table([pa.chunked_array(c) if isinstance(c, list) else c for c in columns], names=names).cast(pa.schema(list(zip(names, kinds, strict=True))))

    return run


def backed_off(own: Slice, rests: list[np.ndarray], total: int, backoff: float, bits: int) -> np.ndarray:
    """The documents' log scores. rests: for each order how often other slices have
    the slice's distinct n-grams, by hash."""
    n = len(own.flat)
    # At each position the count in other documents of the n-gram that ends there; 0 where none does.
    counts = []
    for order, rest in enumerate(rests, 1):
        grams, ends = own.grams(order, bits)
        kinds, kind, here = np.unique(grams, return_inverse=True, return_counts=True)
        _, pair, mine = np.unique(own.of[ends] * max(1, len(kinds)) + kind, return_inverse=True, return_counts=True)
        at = np.zeros(n, np.int64)
        at[ends] = (rest.astype(np.int64) + here)[kind] - mine[pair]
        counts.append(at)
    others = (total - own.lengths)[own.of]
    score = np.where(counts[0] > 0, np.log(np.maximum(counts[0], 1)) - np.log(np.maximum(others, 1)), math.log(backoff) - np.log(others + 1))
    for k in range(1, len(rests)):
        context = np.append(0, counts[k - 1][:-1]) if n else counts[k - 1]
        longer = np.log(np.maximum(counts[k], 1)) - np.log(np.maximum(context, 1))
        # A context longer than what stands before the word doesn't exist, and costs nothing.
        score = np.where(counts[k] > 0, longer, np.where(own.at >= k, math.log(backoff) + score, score))
    return np.bincount(own.of, score, len(own.lengths))


def scored(orders: int, total: int, backoff: float, bits: int):
    """The documents of a slice with the rows of its counts."""

    def run(slices: pa.Table, rows: pa.Table) -> pa.Table:
        ids, lengths, scores = slices["ids"].type.value_type, [], []
        rows = rows.sort_by("range")
        for packed in zip(*(slices[c].to_pylist() for c in ("lengths", "vocabulary", "places")), strict=True):
            own = Slice(*packed)
            rests = [np.concatenate([np.zeros(0, np.uint32), *[spread(x.as_py(), "u4") for x in rows[f"rest{n}"]]]) for n in range(1, orders + 1)]
            lengths += own.lengths.tolist()
            scores += backed_off(own, rests, total, backoff, bits).tolist()
        flat = [x for own in slices["ids"].to_pylist() for x in own]
        return pa.table([pa.array(flat, ids), pa.array(lengths, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "log_score"])

    return run


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, slice_words: int = SLICE_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_words, log_score) of each row of docs.

    Words are lower-cased runs without ASCII white space. S(w | context) is the
    n-gram's count by that of its context, or, where no other document has the
    n-gram, backoff times S(w | shorter context); a word's own S is its count by
    the number of words, and backoff by that number plus one where no other
    document has it. Counts are over all other documents: a document's own
    n-grams would else all be known. Repeated rows are documents of their own.
    log_score sums natural logarithms; without words (a null text too) it is 0.
    Other columns don't matter, and an empty table gives none. The first words
    of a document have contexts as long as there are words before them. A very long
    text is whole, as a slice of its own.

    Counts are exact but for equal hashes, of which an n-gram has a chance of
    about orders / 2**SPARE at most. Slices are bucketed, so that their counts come to
    them and they aren't shuffled. A slice is one row, so a task has
    slice_words words or one text at once; a range has an n-gram once for each slice,
    so a frequent one is no hot key.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = chosen(docs, doc_id="doc_id", text="text").withColumn("text", F.col("text").cast("string"))
    kind = source.schema["doc_id"].dataType.simpleString()
    slices = scratch.keep_buckets(sliced(source, slice_words).withColumn("slice", F.monotonically_increasing_id()), "slice", parts)
    total = slices.agg(F.sum("n_words")).first()[0] or 0
    bits = min(64, max(LEAST_BITS, total.bit_length() + SPARE))
    made = ", ".join(f"rest{n} binary" for n in range(1, order + 1))
    counts = dealt(slices.select("slice", "lengths", "vocabulary", "places"), order, parts, bits).groupBy("range").applyInArrow(others_counts(order, parts, bits), f"slice long, range int, {made}")
    return slices.groupBy("slice").cogroup(counts.groupBy("slice")).applyInArrow(scored(order, total, backoff, bits), f"doc_id {kind}, n_words long, log_score double")


def op5_scoring(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 4))


def op5_bigrams(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), 2).withColumn("log_score", F.round("log_score", 4))


SQL_BIGRAMS = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), total AS (
  SELECT sum(len(ws)) AS n FROM w
), t AS (
  SELECT r, len(ws) AS n, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS p FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
), c1 AS (
  SELECT w, count(*) AS c FROM t GROUP BY w
), o1 AS (
  SELECT r, w, count(*) AS c FROM t GROUP BY r, w
), c2 AS (
  SELECT p, w, count(*) AS c FROM t WHERE p IS NOT NULL GROUP BY p, w
), o2 AS (
  SELECT r, p, w, count(*) AS c FROM t WHERE p IS NOT NULL GROUP BY r, p, w
), u AS (
  SELECT r, o1.w, c1.c - o1.c AS a FROM o1 JOIN c1 USING (w)
), b AS (
  SELECT r, o2.p, o2.w, c2.c - o2.c AS a FROM o2 JOIN c2 ON o2.p = c2.p AND o2.w = c2.w
), s AS (
  SELECT t.r, CASE WHEN coalesce(b.a, 0) > 0 THEN ln(b.a) - ln(x.a)
    ELSE CASE WHEN i > 1 THEN ln(0.4) ELSE 0 END + CASE WHEN u.a > 0 THEN ln(u.a) - ln(greatest(total.n - t.n, 1)) ELSE ln(0.4) - ln(total.n - t.n + 1) END END AS s
  FROM t JOIN u ON u.r = t.r AND u.w = t.w LEFT JOIN b ON b.r = t.r AND b.p = t.p AND b.w = t.w LEFT JOIN u x ON x.r = t.r AND x.w = t.p, total
), per AS (
  SELECT r, sum(s) AS s FROM s GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(per.s, 0.0)::DOUBLE, 4) AS log_score FROM w LEFT JOIN per USING (r)
"""

#: The same with one more step.
SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), total AS (
  SELECT sum(len(ws)) AS n FROM w
), t AS (
  SELECT r, len(ws) AS n, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS p, CASE WHEN i > 2 THEN ws[i - 2] END AS q FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
), c1 AS (
  SELECT w, count(*) AS c FROM t GROUP BY w
), o1 AS (
  SELECT r, w, count(*) AS c FROM t GROUP BY r, w
), c2 AS (
  SELECT p, w, count(*) AS c FROM t WHERE p IS NOT NULL GROUP BY p, w
), o2 AS (
  SELECT r, p, w, count(*) AS c FROM t WHERE p IS NOT NULL GROUP BY r, p, w
), c3 AS (
  SELECT q, p, w, count(*) AS c FROM t WHERE q IS NOT NULL GROUP BY q, p, w
), o3 AS (
  SELECT r, q, p, w, count(*) AS c FROM t WHERE q IS NOT NULL GROUP BY r, q, p, w
), u AS (
  SELECT r, o1.w, c1.c - o1.c AS a FROM o1 JOIN c1 USING (w)
), b AS (
  SELECT r, o2.p, o2.w, c2.c - o2.c AS a FROM o2 JOIN c2 ON o2.p = c2.p AND o2.w = c2.w
), d AS (
  SELECT r, o3.q, o3.p, o3.w, c3.c - o3.c AS a FROM o3 JOIN c3 ON o3.q = c3.q AND o3.p = c3.p AND o3.w = c3.w
), s AS (
  SELECT t.r, CASE WHEN coalesce(d.a, 0) > 0 THEN ln(d.a) - ln(y.a)
    ELSE CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END + CASE WHEN coalesce(b.a, 0) > 0 THEN ln(b.a) - ln(x.a)
    ELSE CASE WHEN i > 1 THEN ln(0.4) ELSE 0 END + CASE WHEN u.a > 0 THEN ln(u.a) - ln(greatest(total.n - t.n, 1)) ELSE ln(0.4) - ln(total.n - t.n + 1) END END END AS s
  FROM t JOIN u ON u.r = t.r AND u.w = t.w LEFT JOIN b ON b.r = t.r AND b.p = t.p AND b.w = t.w LEFT JOIN u x ON x.r = t.r AND x.w = t.p
    LEFT JOIN d ON d.r = t.r AND d.q = t.q AND d.p = t.p AND d.w = t.w LEFT JOIN b y ON y.r = t.r AND y.p = t.q AND y.w = t.p, total
), per AS (
  SELECT r, sum(s) AS s FROM s GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(per.s, 0.0)::DOUBLE, 4) AS log_score FROM w LEFT JOIN per USING (r)
"""
