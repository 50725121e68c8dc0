"""Ranked lexical search: the best documents for each of many queries.

Documents are numbered inside their part and fall into windows of fixed size.
A window's postings (term, document, occurrences) stand sorted by term. For
each query a window's postings are traversed term by term and their scores
scattered into an array that fits a core's cache; a bitset of blocks says where
anything was added, and only those blocks are harvested, into a heap of the
best so far. Heaps of all parts are merged at the end.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from millrace.llm.common import Scratch, chosen, slices, spread, squeezed, table

#: Documents of a window: its scores are an array of 64 KB.
WINDOW = 8192
#: Postings of a window at most, but for a single document's.
POSTINGS = 1 << 20
#: Documents of a block, of which one bit says whether anything was added.
BLOCK = 64
#: Bytes of queries' terms that one pass over the documents searches for.
PASS_BYTES = 1 << 20
#: Documents that a query gets.
BEST = 50
#: Heaps of a query that are merged in one group.
MERGED = 256

#: Digits, letters and bytes from 0x80 on make terms, A-Z are
#: lower-cased, all else parts them.
LETTERS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(LETTERS).split()


def query_terms(queries: DataFrame) -> DataFrame:
    """(item, terms: distinct) of queries (item, text). Rows that share an item are one."""

    @F.udf("array<binary>", useArrow=True)
    def own(text: str | None) -> list[bytes]:
        return sorted(set(terms(text or "")))

    single = queries.select("item", F.explode(own(F.col("text").cast("string"))).alias("term")).distinct()
    return single.groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms"))


INDEX = "docs long, size long, ids binary, nulls binary, sizes binary, heads binary, counts binary, places binary, times binary"


def windows_of(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The postings of docs (id, text) for the terms of a vocabulary, a row a window: how many
    documents with terms, all their terms; of each document its id, whether that is null, and its
    number of terms; then the vocabulary's terms that occur, their numbers of documents, and by
    term the documents' places in the window and the occurrences."""
    schema = StructType.fromDDL(INDEX)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    width = max(1, len(vocabulary))

    def packed(ids: list, sizes: list[int], pairs: list[np.ndarray], times: list[np.ndarray]) -> list:
        pair = np.concatenate([*pairs, np.zeros(0, np.int64)])
        order = np.argsort(pair % width, kind="stable")
        pair, time = pair[order], np.concatenate([*times, np.zeros(0, np.int64)])[order]
        heads, counts = np.unique(pair % width, return_counts=True)
        n = np.array(sizes, np.int64)
        cols = [np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), n, heads, counts.astype(np.int64), (pair // width).astype(np.uint16), time]
        return [int((n > 0).sum()), int(n.sum()), *[squeezed(c) for c in cols]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        ids, sizes, pairs, times, found = [], [], [], [], 0

        def batch_of() -> pa.RecordBatch:
            row = packed(ids, sizes, pairs, times)
            for held in (ids, sizes, pairs, times):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k < 2 else pa.binary()) for k, v in enumerate(row)], names=schema.names)

        for batch in batches:
            for part, texts in slices(batch):
                for name, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    if len(ids) == WINDOW or found > POSTINGS:
                        yield batch_of()
                        found = 0
                    words = terms(text)
                    known = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                    which, often = np.unique(known[known >= 0], return_counts=True)
                    pairs.append(len(ids) * width + which)
                    times.append(often.astype(np.int64))
                    ids.append(name)
                    sizes.append(len(words))
                    found += len(which)
        if ids:
            yield batch_of()

    return docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class Opened:
    """A window's postings by term, with each posting's score before its term's weight."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids, self.nulls, n = spread(row["ids"], "int64"), spread(row["nulls"], "uint8"), spread(row["sizes"], "int64")
        heads, counts = spread(row["heads"], "int64"), spread(row["counts"], "int64")
        self.places, times = spread(row["places"], "uint16").astype(np.int64), spread(row["times"], "int64")
        m = 50 + 50 * n * n_docs // max(1, n_terms)
        self.impacts = 1_000_000_000 * times // (1000 * times + 20 * m[self.places])
        ends = np.cumsum(counts)
        self.spans = {h: (e - c, e) for h, c, e in zip(heads.tolist(), counts.tolist(), ends.tolist(), strict=True)}
        self.blocks = -(-len(n) // BLOCK)
        self.scores = np.zeros(self.blocks * BLOCK, np.int64)

    def harvest(self, weighted: list[tuple[int, int]], heap: list[tuple], best: int) -> None:
        """Adds this window's documents to a query's heap of (score, known id, -id)."""
        occupied = np.zeros(self.blocks, bool)
        for term, weight in weighted:
            if term in self.spans and weight:
                a, b = self.spans[term]
                at = self.places[a:b]
                self.scores[at] += weight * self.impacts[a:b]  # a document stands once in a term's postings
                occupied[at // BLOCK] = True
        blocks = np.flatnonzero(occupied)
        if not len(blocks):
            return
        scores = self.scores.reshape(-1, BLOCK)[blocks].reshape(-1)
        self.scores.reshape(-1, BLOCK)[blocks] = 0
        least = heap[0][0] if len(heap) == best else 1
        if len(scores) > best:
            least = max(least, int(np.partition(scores, len(scores) - best)[len(scores) - best]))
        for k in np.flatnonzero(scores >= max(1, least)).tolist():
            place = int(blocks[k // BLOCK]) * BLOCK + k % BLOCK
            entry = (int(scores[k]), not self.nulls[place], -int(self.ids[place]))
            if len(heap) < best:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def ranked(docs: DataFrame, items: list[tuple], best: int, scratch: Scratch) -> DataFrame:
    """(item: its number, doc_id, score): the best documents of each part for a pass's items."""
    vocabulary = {t: k for k, t in enumerate(sorted({bytes(t) for own in items for t in own}))}
    index = scratch.keep(windows_of(docs, vocabulary))
    n_docs, n_terms = (int(x or 0) for x in index.agg(F.sum("docs"), F.sum("size")).first())

    @F.udf("array<struct<term:long,n:long>>", useArrow=True)
    def lengths(heads: bytes, counts: bytes) -> list:
        return [{"term": t, "n": n} for t, n in zip(spread(heads, "int64").tolist(), spread(counts, "int64").tolist(), strict=True)]

    # A row for each term of the pass's queries.
    df = {r["term"]: r["n"] for r in index.select(F.inline(lengths("heads", "counts"))).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    weighted = [[(k, weight[k]) for t in own if (k := vocabulary[bytes(t)]) in weight] for own in items]
    shared = docs.sparkSession.sparkContext.broadcast(weighted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple]] = [[] for _ in shared.value]
        for batch in batches:
            for k in range(batch.num_rows):  # one window at a time is unpacked
                window = Opened({n: batch.column(n)[k].as_py() for n in batch.schema.names}, n_docs, n_terms)
                for own, heap in zip(shared.value, heaps, strict=True):
                    window.harvest(own, heap, best)
        for k, heap in enumerate(heaps):
            if heap:
                top = sorted(heap, reverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(top), pa.int64()), pa.array([-i if known else None for _, known, i in top], pa.int64()), pa.array([s for s, _, _ in top], pa.int64())], names=["item", "doc_id", "score"]
                )

    found = index.mapInArrow(run, "item long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # First in groups of some heaps, then of their best: no group grows with the documents.
    some = found.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(MERGED)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).where(F.col("rank") <= best)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= best).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, best: int = BEST, pass_bytes: int = PASS_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of docs (doc_id, text) for each
    of queries (item_id, text), highest score first, equal scores by ascending doc_id and a
    null doc_id last; only scores above 0.

    A term that few documents have weighs more, occurrences count less the more there are
    and the longer the document is against the average. Terms are whole, texts too, however
    long; null and empty texts have none. Repeated documents, and rows that share an id, are
    ranked each. Queries that share an item_id are one with all their terms, those of a null
    item_id too; a query without terms, or with terms that no document has, gets no row.
    Queries of more than pass_bytes of terms are searched for in several passes over docs, so
    what a task gets of them is bounded (a longer query is a pass of its own). Other columns
    are ignored. Empty tables give no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    source = chosen(docs, id="doc_id", text="text")
    kind = chosen(queries, item="item_id").schema["item"].dataType
    wanted = scratch.keep(query_terms(chosen(queries, item="item_id", text="text")))
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t) + 1)
    total = wanted.agg(F.sum(size)).first()[0] or 0
    passes, parts = max(1, -(-total // pass_bytes)), []
    for k in range(passes):
        own = [(r["item"], r["terms"]) for r in wanted.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k).toLocalIterator()]
        if own:
            names = docs.sparkSession.createDataFrame([(i, n) for i, (n, _) in enumerate(own)], StructType().add("item", "long").add("item_id", kind))
            parts.append(ranked(source, [t for _, t in own], best, scratch).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return docs.sparkSession.createDataFrame([], StructType().add("item_id", kind).add("rank", "integer").add("doc_id", "long").add("score", "long"))
    return reduce(DataFrame.unionAll, parts)


def op11_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), docs AS (
  SELECT r, doc_id, ws, len(ws)::BIGINT AS n FROM words WHERE len(ws) > 0
), sizes AS (
  SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM docs
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark
), postings AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, sizes GROUP BY term
), impacts AS (
  SELECT r, term, (1000000000::BIGINT * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * all_docs) // all_terms)) AS impact FROM postings JOIN docs USING (r), sizes
), scored AS (
  SELECT item_id, r, CAST(sum(w * impact) AS BIGINT) AS score FROM wanted JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, r
), places AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored JOIN docs USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM places WHERE rank <= 50
"""
