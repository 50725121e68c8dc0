"""Benchmark decontamination by Wu-Manber search for many patterns.

Patterns are windows of a benchmark item's words, symbols are words. A table
of shifts, indexed by a hash of two neighbouring words, says how far a search
may jump from there; where it says zero, the patterns that end in those two
words are compared with the text word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, chosen, map_texts, restored, slices, table

#: Words in a window; an item of fewer words is one window.
WINDOW = 10
#: Bytes of benchmark text that one pass over the documents searches for. A
#: larger benchmark is searched for in several passes.
PASS_BYTES = 8 << 20
#: Words of a benchmark item that are searched for in the same pass.
SEGMENT = 100_000
#: End positions that one lane of the vectorised search covers.
LANE = 96
#: Entries of the shift table, as a power of two.
TABLE_BITS = 20

#: Digits, lower-case letters and bytes from 0x80 on make words,
#: A-Z are lower-cased, all else parts words.
LETTERS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(LETTERS).split()


class Patterns:
    """Windows of the same length with their shift table and suffix buckets."""

    def __init__(self, windows: np.ndarray):
        self.rows, self.length = windows, windows.shape[1]
        self.block = min(2, self.length)
        self.shift = np.full(1 << TABLE_BITS, self.length - self.block + 1, np.int16)
        for end in range(self.block - 1, self.length):
            left = windows[:, end - 1] if self.block == 2 else np.zeros(len(windows), np.int64)
            np.minimum.at(self.shift, slot(left, windows[:, end]), self.length - 1 - end)
        ends = self.suffix(windows, self.length - 1)
        self.by_end = np.argsort(ends, kind="stable")
        self.ends = ends[self.by_end]

    def suffix(self, rows: np.ndarray, at: int) -> np.ndarray:
        return rows[:, at] + (rows[:, at - 1] << 32 if self.block == 2 else 0)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end position, pattern) of each occurrence in ids. Each lane jumps by
        the shifts from its first end position to its last; all step at once."""
        m = self.length
        at = np.arange(m - 1, len(ids), LANE)
        stop = np.minimum(at + LANE, len(ids))
        zeros = []
        while len(at):
            jump = self.shift[slot(ids[at - 1] if self.block == 2 else np.zeros(len(at), np.int64), ids[at])]
            zeros.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        zeros = np.concatenate(zeros) if zeros else np.zeros(0, np.int64)
        keys = ids[zeros] + (ids[zeros - 1] << 32 if self.block == 2 else 0)
        first, last = np.searchsorted(self.ends, keys, "left"), np.searchsorted(self.ends, keys, "right")
        ends, which = [], []
        size, k = last - first, 0
        while (live := size > k).any():
            e, p = zeros[live], self.by_end[first[live] + k]
            same = np.ones(len(e), bool)
            for j in range(m):
                same &= ids[e - m + 1 + j] == self.rows[p, j]
            ends.append(e[same])
            which.append(p[same])
            k += 1
        none = np.zeros(0, np.int64)
        return (np.concatenate(ends), np.concatenate(which)) if ends else (none, none)


def slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A place in the shift table for a block of two words."""
    mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Searcher:
    """All windows of some benchmark items, by length."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], list[str]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            m = min(window, len(ids))
            for k in range(len(ids) - m + 1 if m else 0):
                own = owners.setdefault(tuple(ids[k : k + m]), [])
                if not own or own[-1] != name:
                    own.append(name)
        self.groups = []
        for m in sorted({len(w) for w in owners}):
            windows = [w for w in owners if len(w) == m]
            self.groups.append((Patterns(np.array(windows, np.int64)), [owners[w] for w in windows]))

    def search(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text its number of words, its hit spans of words (end
        exclusive, joined where they touch) and its items."""
        get, flat, counts = self.vocabulary.get, [], []
        for text in texts:
            own = words(text)
            counts.append(len(own))
            flat += [get(w, 0) for w in own]
            flat.append(0)  # no window reaches over the end of a text
        ids = np.array(flat, np.int64)
        bounds = np.cumsum([0, *[c + 1 for c in counts]])
        edges = np.zeros(len(ids) + 1, np.int64)
        found: dict[int, set[str]] = {}
        for patterns, owners in self.groups:
            ends, which = patterns.find(ids)
            np.add.at(edges, ends - patterns.length + 1, 1)
            np.add.at(edges, ends + 1, -1)
            docs = np.searchsorted(bounds, ends, "right") - 1
            for d, p in set(zip(docs.tolist(), which.tolist(), strict=True)):
                found.setdefault(d, set()).update(owners[p])
        hit = np.concatenate([[0], (np.cumsum(edges)[:-1] > 0).astype(np.int8), [0]])
        turns = np.flatnonzero(np.diff(hit)).reshape(-1, 2)
        of = np.searchsorted(bounds, turns[:, 0], "right") - 1
        spans: dict[int, list[tuple[int, int]]] = {}
        for d, (a, b) in zip(of.tolist(), turns.tolist(), strict=True):
            spans.setdefault(d, []).append((a - int(bounds[d]), b - int(bounds[d])))
        return [(c, spans.get(d, []), sorted(found.get(d, ()))) for d, c in enumerate(counts)]


def merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(a + b):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


FIELDS = [("n_words", "long"), ("hits", "array<struct<start:long,end:long>>"), ("items", "array<string>")]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES, carry: list[str] | None = None) -> DataFrame:
    """docs (or its columns carry) with n_words, hits (spans of word positions,
    end exclusive) and items (ids as strings, sorted, each once).

    A benchmark of more than pass_bytes is parted by a hash of its texts, and each part
    is a pass of its own whose hits are written before the next begins, so a task, and
    what is broadcast, has one part at a time; a very long item is parted too. Null and
    empty texts have no words; items without words match nothing; a null item_id counts as
    the empty string; items that share an id are one. Very long texts are searched whole.
    Repeated documents are rows of their own. Columns of docs named like the
    three are replaced. Empty tables give no rows, or rows without hits.
    """
    patterns = segments(chosen(benchmark, item="item_id", text="text"), window)
    total = patterns.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // pass_bytes))
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in {n for n, _ in FIELDS}]
    rows = chosen(docs, carry, text="text")
    if passes == 1:
        return restored(searched(rows, patterns, window, ["row"] if carry else [])[0], carry, *[n for n, _ in FIELDS])
    scratch = Scratch(docs.sparkSession)
    count = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("long"), F.lit(0).cast("long"))
    rows = scratch.keep(rows.withColumn("n_words", count).withColumn("at", F.monotonically_increasing_id()))
    parts = []
    for k in range(passes):
        found, shared = searched(rows, patterns.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k), window, ["at"])
        parts.append(scratch.keep(found.where(F.size("hits") > 0).select("at", "hits", "items")))
        shared.destroy()

    @F.udf(FIELDS[1][1], useArrow=True)
    def merged(spans: list) -> list:
        return [{"start": a, "end": b} for a, b in merge([(s["start"], s["end"]) for s in spans], [])]

    # Few documents have hits, and each only its own.
    every = reduce(DataFrame.unionAll, parts).groupBy(F.col("at").alias("of")).agg(F.flatten(F.collect_list("hits")).alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    every = scratch.keep(every.select("of", merged("h").alias("hits"), F.col("i").alias("items")))
    told = rows.join(every, F.col("at") == F.col("of"), "left")
    return restored(told, carry, "n_words", *[F.coalesce(n, F.array().cast(kind)).alias(n) for n, kind in FIELDS[1:]])


def searched(rows: DataFrame, patterns: DataFrame, window: int, carry: list[str]) -> tuple[DataFrame, Broadcast]:
    """Columns carry of rows (carry, text) with FIELDS for the patterns (item, text), and
    the searcher, which is broadcast. The patterns are of bounded size."""
    searcher = Searcher([(r["item"], r["text"]) for r in patterns.sort("item", "text").toLocalIterator()], window)
    shared = rows.sparkSession.sparkContext.broadcast(searcher)

    def work(_: pa.RecordBatch, texts: list[str]) -> list:
        got = shared.value.search(texts)
        return [[x[0] for x in got], [[{"start": a, "end": b} for a, b in x[1]] for x in got], [x[2] for x in got]]

    return map_texts(rows, work, FIELDS, carry), shared


def segments(items: DataFrame, window: int) -> DataFrame:
    """(item, text) of items (item, text), the texts of very long ones in parts that
    have all their windows; nulls are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                names, parts = [], []
                for name, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    own = words(text)
                    for start in range(0, max(1, len(own) - window + 1), SEGMENT):
                        names.append(name or "")
                        parts.append(b" ".join(own[start : start + SEGMENT + window - 1]).decode())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.string())], names=["item", "text"])

    return items.select(F.col("item").cast("string").alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item string, text string")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[k : k + m - 1], ' ') AS win
  FROM (SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS k FROM b WHERE len(ws) > 0)
), lengths AS (
  SELECT DISTINCT m FROM windows
), spots AS (
  SELECT r, m, k, array_to_string(ws[k : k + m - 1], ' ') AS win
  FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM w, lengths WHERE len(ws) >= m)
), found AS (
  SELECT r, s.m, k, item_id FROM spots s JOIN windows p ON s.m = p.m AND s.win = p.win
), hit AS (
  SELECT r, count(DISTINCT h) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS h FROM (SELECT DISTINCT r, m, k FROM found)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
