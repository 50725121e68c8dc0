"""Substring deduplication by MinHash banding of paragraphs.

Paragraphs are the text's own units, its lines and its blocks of lines, whatever
their lengths. Repeated passages also begin and end anywhere in a line, so any
passage of LENGTH words that begins at an anchor is a paragraph too: a word
position whose hash is the least of some SPACING neighbours. Anchors follow from
nearby words alone, so a passage of SPACING - 1 + LENGTH words has a paragraph in
common with any other place where it stands. MinHashes over a unit's shingles are
banded as they are; those of an anchored passage together with its anchor, or else
each would collide with those that begin some words later. Band hashes that several documents have make their paragraphs
candidates. These are compared exactly, and components of equal and similar paragraphs give the
clusters, of which one paragraph stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SLICE_CHARS, Scratch, chosen, packed_texts, slices, spread, squeezed, table, unpacked_text, window_hashes, word_hashes
from millrace.llm.components import components
from millrace.llm.jaccard import links_of
from millrace.llm.scoring import words

#: Words of an anchored passage, positions of which one is an anchor. Together they
#: make sure that a passage of 50 words that repeats inside lines is seen.
LENGTH, SPACING = 27, 24
WIDTH = 5
PERCENT = 75
#: Bands and their rows: at a similarity of 0.75 paragraphs of the same anchor
#: have a band in common with a chance of 1 - (1 - 0.75) ** 4 = 0.996.
BANDS, ROWS = 4, 1
#: Odd multipliers of the hash functions.
FACTORS = (np.random.default_rng(7).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
#: The same for lines and blocks, without an anchor: at a similarity of 0.75 a
#: chance of 1 - (1 - 0.75 ** 2) ** 6 = 0.993, at 0.8 of 0.998.
UNIT_BANDS, UNIT_ROWS = 6, 2
UNIT_FACTORS = (np.random.default_rng(8).integers(0, 2**63, UNIT_BANDS * UNIT_ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
#: Words of the shortest unit: a single word is no paragraph.
LEAST = 2
#: Bits of a band hash that are sent, besides those that its range implies.
LOW = (1 << 48) - 1


class Paragraphs:
    """The paragraphs of some texts: of (text), start and end (words), content
    (hash of the words), band hashes (flat) with their paragraphs (unit), and
    shingles of those that are asked for. A text has a content once, where it
    first stands."""

    def __init__(self, texts: list[str]):
        split = [unit_words(t) for t in texts]
        hashes = [word_hashes(w) for w, _ in split]
        ends = np.cumsum([0, *[len(h) for h in hashes]])
        flat = np.concatenate([*hashes, np.zeros(LENGTH, np.uint64)])
        self.grams = window_hashes(flat, WIDTH)
        windows = self.anchored(ends, flat)
        units = self.own_units([u for _, u in split], ends, flat)
        # Windows before units, in the order of texts.
        of, start, end, content, at = (np.concatenate(x) for x in zip(windows[:5], units[:5], strict=True))
        by = np.argsort(of, kind="stable")
        self.of, self.start, self.end, self.content, self.at = of[by], start[by], end[by], content[by], at[by]
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        unit = place[np.concatenate([windows[5], units[5] + len(windows[0])])]
        bands = np.concatenate([windows[6], units[6]])
        by = np.argsort(unit, kind="stable")
        self.unit, self.flat = unit[by], bands[by]

    def anchored(self, ends: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, ...]:
        at = anchors(ends, flat)
        of = np.searchsorted(ends, at, side="right") - 1
        start = at - ends[of]
        inside = LENGTH - WIDTH + 1
        # Contents: the shingles' hashes summed by position, so order counts.
        places = FACTORS[0] ** np.arange(1, inside + 1, dtype=np.uint64)
        content = np.zeros(len(at), np.uint64)
        for j in range(inside):
            content += self.grams[at + j] * places[j]
        first = firsts(of, content)
        of, start, content, at = of[first], start[first], content[first], at[first]
        least = []
        for f in FACTORS:
            mixed = np.lib.stride_tricks.sliding_window_view(remixed(self.grams, f), inside)
            least.append(mixed[at].min(axis=1) if len(at) else np.zeros(0, np.uint64))
        bands = banded(least, window_hashes(flat, 3)[at], BANDS, ROWS)
        return of, start, start + LENGTH, content, at, np.repeat(np.arange(len(at)), BANDS), bands.reshape(-1)

    def own_units(self, units: list[np.ndarray], ends: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, ...]:
        of = np.repeat(np.arange(len(units)), [len(u) for u in units])
        start, end = np.concatenate([*units, np.zeros((0, 2), np.int64)]).T
        at, n = start + ends[of], end - start
        # Contents as above, for any length: each place counts from the unit's start.
        factor = UNIT_FACTORS[0]
        size = np.ones(len(self.grams), np.uint64)
        size[1:] = factor
        back = size.copy()
        back[1:] = np.uint64(pow(int(factor), -1, 1 << 64))
        size, back = np.cumprod(size), np.cumprod(back)
        content = n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        long = np.flatnonzero(n >= WIDTH)
        if len(long):
            content[long] += reduced(np.add, self.grams * size, at[long], at[long] + n[long] - WIDTH + 1) * back[at[long]]
        for k in range(LEAST, WIDTH):
            short = np.flatnonzero(n == k)
            content[short] += window_hashes(flat, k)[at[short]]
        first = firsts(of, content)
        of, start, end, content, at = of[first], start[first], end[first], content[first], at[first]
        long, short = np.flatnonzero(end - start >= WIDTH), np.flatnonzero(end - start < WIDTH)
        last = at[long] + (end - start)[long] - WIDTH + 1
        least = [reduced(np.minimum, remixed(self.grams, f), at[long], last) for f in UNIT_FACTORS]
        bands = banded(least, np.full(len(long), 1 << 40, np.uint64), UNIT_BANDS, UNIT_ROWS)
        whole = banded([content[short]], np.full(len(short), 1 << 41, np.uint64), 1, 1)
        return of, start, end, content, at, np.concatenate([np.repeat(long, UNIT_BANDS), short]), np.concatenate([bands.reshape(-1), whole.reshape(-1)])

    def shingles(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The numbers of shingles of these paragraphs, and the sorted shingles one after
        another, some paragraphs at a time. 32 bits tell the few shingles of two paragraphs
        apart, but for a chance of about one in ten million. A unit of fewer words than a
        shingle is one as a whole."""
        sizes = np.maximum(self.end[which] - self.start[which] - WIDTH + 1, 1)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_CHARS)) + 1
        for part, n in zip(np.split(which, cuts), np.split(sizes, cuts), strict=True):
            own = np.repeat(np.arange(len(part)), n)
            first = np.cumsum(n) - n
            flat = self.grams[np.repeat(self.at[part] - first, n) + np.arange(len(own))]
            whole = self.end[part] - self.start[part] < WIDTH
            flat[first[whole]] = self.content[part[whole]]
            flat = (flat >> np.uint64(32)) | (own.astype(np.uint64) << np.uint64(32))
            flat.sort()
            flat = flat[np.concatenate([flat[:1] == flat[:1], flat[1:] != flat[:-1]])]
            yield np.bincount((flat >> np.uint64(32)).astype(np.int64), minlength=len(part)), flat.astype(np.uint32)


def unit_words(text: str) -> tuple[list[bytes], np.ndarray]:
    """The words of a text, and (start, end) of its units of LEAST words: its
    lines, and blocks of several lines between blank ones."""
    lines = [line.split() for line in text.encode("utf-8").lower().split(b"\n")]
    found, at, block, filled = [], 0, 0, 0
    for line in [*lines, []]:
        if line:
            found.append((at, at + len(line)))
            filled += 1
        else:
            if filled > 1:
                found.append((block, at))
            block, filled = at, 0
        at += len(line)
    spans = np.array(found, np.int64).reshape(-1, 2)
    return [w for line in lines for w in line], spans[spans[:, 1] - spans[:, 0] >= LEAST]


def firsts(of: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Where each text's contents stand first."""
    order = np.lexsort((content, of))
    new = np.ones(len(order), bool)
    new[1:] = (of[order][1:] != of[order][:-1]) | (content[order][1:] != content[order][:-1])
    return np.sort(order[new])


def remixed(grams: np.ndarray, factor: np.uint64) -> np.ndarray:
    mixed = grams * factor
    mixed ^= mixed >> np.uint64(32)
    return mixed * factor


def reduced(by: np.ufunc, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """by over values of each stretch from start to end, exclusive and less than all."""
    return by.reduceat(values, np.stack([start, end], axis=1).reshape(-1))[::2] if len(start) else np.zeros(0, values.dtype)


def banded(least: list[np.ndarray], seed: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of MinHashes, bands for each paragraph."""
    out = np.zeros((len(seed), bands), np.uint64)
    for b in range(bands):
        h = seed + np.uint64(b + 1)
        for m in least[b * rows : (b + 1) * rows]:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + m
        out[:, b] = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return out


def anchors(ends: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The places of the anchors among the words flat of texts that end at ends: of any
    SPACING neighbours the first with the least hash."""
    order = window_hashes(flat, 3)
    places = np.diff(ends) - LENGTH + 1
    best, least, width = np.arange(len(order)), order, 1
    while width < SPACING:
        step = min(width, SPACING - width)
        best = np.where(least[step:] < least[:-step], best[step:], best[:-step])
        least = np.minimum(least[step:], least[:-step])
        width += step
    windows = np.maximum(places - SPACING + 1, 0)
    windows[(places > 0) & (places <= SPACING)] = 0
    first = np.cumsum(windows) - windows
    found = best[np.repeat(ends[:-1] - first, windows) + np.arange(windows.sum())]
    few = [i + int(np.argmin(order[i : i + n])) for i, n in zip(ends[:-1].tolist(), places.tolist(), strict=True) if 0 < n <= SPACING]
    return np.unique(np.concatenate([found, np.array(few, np.int64)]))


def dealt(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, keys, lengths, low, high, prints) over docs (key, text): band
    hashes by range, with 32 bits of the contents."""
    names = ["range", "keys", "lengths", "low", "high", "prints"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                keys = part.column(0).to_numpy(zero_copy_only=False)
                found = Paragraphs(texts)
                flat, of = found.flat, found.of[found.unit]
                prints = (found.content >> np.uint64(32)).astype(np.uint32)[found.unit]
                where = (((flat >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.uint16 if ranges < 1 << 16 else np.int64)
                by = np.argsort(where, kind="stable")
                edges = np.searchsorted(where[by], np.arange(ranges + 1))
                rows = []
                for r in range(ranges):
                    p = by[edges[r] : edges[r + 1]]
                    if len(p):
                        edge = np.flatnonzero(np.concatenate([[True], np.diff(of[p]) > 0, [True]]))
                        rows.append((r, keys[of[p][edge[:-1]]].tobytes(), squeezed(np.diff(edge).astype(np.uint32)), flat[p].astype(np.uint32).tobytes(), (flat[p] >> np.uint64(32)).astype(np.uint16).tobytes(), prints[p].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.binary() if i else pa.int32()) for i in range(len(names))], names=names)

    return docs.select("key", "text").mapInArrow(run, "range int, " + ", ".join(f"{n} binary" for n in names[1:]))


def shared_bands(buckets: int):
    """The band hashes of a range that several documents have, for the buckets
    of documents; the top bit says that their contents differ."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(rows["keys"]), np.int64)
        lengths = np.concatenate([spread(x, "u4") for x in rows["lengths"]])
        h = np.frombuffer(b"".join(rows["low"]), np.uint32).astype(np.uint64)
        h |= np.frombuffer(b"".join(rows["high"]), np.uint16).astype(np.uint64) << np.uint64(32)
        prints = np.frombuffer(b"".join(rows["prints"]), np.uint32)
        of = np.repeat(np.unique(keys, return_inverse=True)[1], lengths)
        key = np.repeat(keys, lengths)
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        runs = np.diff(np.concatenate([starts, [len(h)]]))
        several = np.minimum.reduceat(of[order], starts) != np.maximum.reduceat(of[order], starts)
        differ = np.minimum.reduceat(prints[order], starts) != np.maximum.reduceat(prints[order], starts)
        take = order[np.repeat(several, runs)]
        value = h[take] | (np.repeat(differ, runs)[np.repeat(several, runs)].astype(np.uint64) << np.uint64(63))
        bucket = key[take] % buckets
        by = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
        out = [(b, key[take][p].tobytes(), value[p].tobytes()) for b in range(buckets) if len(p := by[edges[b] : edges[b + 1]])]
        return pd.DataFrame(out, columns=["bucket", "keys", "bands"]).assign(keys=lambda d: [squeezed(np.frombuffer(k, np.int64)) for k in d["keys"]])

    return run


#: What repeated finds.
FOUND = "doc_id long, start long, end long, content long, bands array<long>, n long, shingles binary"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("content", pa.int64()), ("bands", pa.list_(pa.int64())), ("n", pa.int64()), ("shingles", pa.binary())])


def repeated(docs: pa.Table, rows: pa.Table) -> pa.Table:
    """The candidates among a bucket's documents; bands and shingles only of
    those that meet other contents."""
    out = [FOUND_ARROW.empty_table()]
    if rows.num_rows and docs.num_rows:
        keys = np.concatenate([spread(x, "i8") for x in rows.column("keys").to_pylist()])
        bands = np.frombuffer(b"".join(rows.column("bands").to_pylist()), np.uint64)
        by = np.argsort(keys, kind="stable")
        keys, bands = keys[by], bands[by]
        docs = docs.take(np.flatnonzero(np.isin(docs.column("key").to_numpy(), keys)))
        # Parts have fewer than 2^16 documents.
        weights = np.cumsum(docs.column("chars").to_numpy() + 32) // SLICE_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(weights)) + 1).tolist(), docs.num_rows]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            out += repeated_of_part(docs.slice(start, stop - start), keys, bands)
    return pa.concat_tables(out)


def repeated_of_part(docs: pa.Table, keys: np.ndarray, bands: np.ndarray) -> Iterator[pa.Table]:
    """The same of some documents, the bands being sorted by document."""
    own = docs.column("key").to_numpy()
    first = np.searchsorted(keys, own, "left")
    sizes = np.searchsorted(keys, own, "right") - first
    place = np.cumsum(sizes) - sizes
    mine = bands[np.repeat(first - place, sizes) + np.arange(sizes.sum())]
    marked = (mine & np.uint64(LOW)) | (np.repeat(np.arange(len(own)), sizes).astype(np.uint64) << np.uint64(48))
    found = Paragraphs([unpacked_text(x) for x in docs.column("packed").to_pylist()])
    flat = (found.flat & np.uint64(LOW)) | (found.of[found.unit].astype(np.uint64) << np.uint64(48))
    hit = np.zeros(len(found.start), bool)
    hit[found.unit[among(flat, marked)]] = True
    differs = among(flat, marked[mine >> np.uint64(63) > 0])
    meets = np.bincount(found.unit[differs], minlength=len(hit))
    which = np.flatnonzero(hit)
    apart = meets[which] > 0
    none = pa.array(~apart)
    counts, shingles = [np.zeros(0, np.int64)], []
    for n, values in found.shingles(which[apart]):
        counts.append(n)
        shingles.append(values.tobytes())
    n = np.zeros(len(which), np.int64)
    n[apart] = np.concatenate(counts)
    offsets = np.concatenate([[0], np.cumsum(n)]) * 4
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(meets[which])]), pa.int32()), pa.array(found.flat[differs].view(np.int64)), mask=none)
    sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(which), [pa.array(apart).buffers()[1], pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(b"".join(shingles))]).cast(pa.binary())
    columns = [docs.column("doc_id").to_numpy()[found.of[which]], found.start[which], found.end[which], found.content[which].view(np.int64), lists, pa.array(n, mask=~apart), sets]
    yield pa.Table.from_arrays([pa.array(c) for c in columns], schema=FOUND_ARROW)


def among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among those wanted."""
    wanted = np.unique(wanted)
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def dedup_substrings(docs: DataFrame, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, start, end, cluster, keeper, removed): the paragraphs that other
    documents repeat, in words, end exclusive.

    A cluster is a component of paragraphs with equal words or a Jaccard
    similarity of percent. The smallest doc_id of a cluster is its keeper, whose
    paragraphs aren't removed. Words are lower-cased runs without ASCII white space.
    Lines and blocks of one word, null texts and rows without doc_id have no
    paragraphs; paragraphs of fewer than WIDTH words are alike only if equal, and
    passages inside lines are surely found from SPACING - 1 + LENGTH words on.
    Very long texts are read whole, one at a time. Paragraphs may overlap. A paragraph that only its own document repeats is none of these,
    and a document has a paragraph's content once. Rows of equal id and text are
    one document. Other columns don't matter. An empty table gives none.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = chosen(docs, doc_id="doc_id", text="text")
    keyed = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    bands = dealt(keyed, parts).groupBy("range").applyInPandas(shared_bands(parts), "bucket long, keys binary, bands binary")
    bucketed = packed_texts(keyed.withColumn("chars", F.char_length("text")), ["key", "doc_id", "chars"]).withColumn("bucket", F.pmod("key", F.lit(parts).cast("long")))
    found = bucketed.groupBy("bucket").cogroup(bands.groupBy("bucket")).applyInArrow(repeated, FOUND)
    inner = Scratch(spark)  # deleted once the clusters are written
    found = inner.keep(found)
    sets = found.where("bands is not null").groupBy("content").agg(F.first("n").alias("n"), F.flatten(F.collect_set("bands")).alias("prefix"), F.first("shingles").alias("shared")).withColumnRenamed("content", "id").withColumn("index", F.size("prefix"))
    pairs = Scratch(spark)
    tops = inner.keep(components(links_of(pairs.keep(sets), percent, pairs, "u4"), pairs))
    pairs.clear()
    placed = found.join(tops, found["content"] == tops["node"], "left").select("doc_id", "start", "end", F.coalesce("component", "content").alias("cluster")).distinct()
    placed = scratch.keep(placed)
    inner.clear()
    of = placed.groupBy("cluster").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper <> last")
    of = scratch.keep(of.select("cluster", "keeper"))  # so that a join of a large cluster can be parted
    return placed.join(of, "cluster").select("doc_id", "start", "end", "cluster", "keeper", (F.col("doc_id") != F.col("keeper")).alias("removed"))


def joined_spans(spans) -> F.Column:
    """Spans in order of their starts, joined where they touch."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(out, s):
        last = F.element_at(out, -1)
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (F.coalesce(F.try_element_at(out, F.lit(-1))["end"], F.lit(-1).cast("long")) >= s["start"]), longer).otherwise(F.concat(out, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    return F.aggregate(F.sort_array(spans), none, add)


def by_document(found: DataFrame) -> DataFrame:
    """A row for each document of dedup_substrings' result."""
    span = F.struct("start", "end")
    per = found.groupBy("doc_id").agg(F.collect_list(span).alias("s"), F.collect_list(F.when(F.col("removed"), span)).alias("r"), F.array_sort(F.collect_set("keeper")).alias("keepers"))
    words_in = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return per.select("doc_id", F.size("s").cast("long").alias("n_paragraphs"), joined_spans(F.col("s")).alias("repeated"), joined_spans(F.col("r")).alias("removed"), "keepers").withColumns({"n_repeated_words": words_in("repeated"), "n_removed_words": words_in("removed")})


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    """A row for each document with a passage of LENGTH words or more that other
    documents repeat, with all of its paragraphs, short lines too. A document that
    shares no more than short lines is in op2_lines, which has all paragraphs."""
    return op2_lines(spark, sf_dir).where(F.exists("repeated", lambda s: s["end"] - s["start"] >= LENGTH))


def op2_lines(spark, sf_dir: str) -> DataFrame:
    """A row for each document with paragraphs of any length that other documents repeat."""
    return by_document(dedup_substrings(table(spark, sf_dir, "documents")))
