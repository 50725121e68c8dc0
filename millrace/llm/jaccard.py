"""N-gram Jaccard join of documents with signature trees.

Candidates first. Each document's shingles are dealt by hash into ranges, where
each shingle learns in how many distinct sets it occurs. Shingles of one set
alone link nothing: a set that shares too few can't reach the threshold, and
of the others it is enough to compare those that share one of the rarest
shingles: as many as the larger set of a pair may lack and one more, against as
many as the smaller one may lack and one more. Sets connected by such
shingles are a cluster, and each cluster is joined with itself by a signature
tree: nodes hold the OR of their sets' bitmaps and the range of their sizes,
two nodes are traversed together, and a pair of nodes is left where their
largest possible overlap is below what the threshold needs, or where all their
sets are connected already. What remains is compared exactly. Large clusters
are joined in blocks, and what isn't connected then once more, by blocks or by
shared shingles, whichever moves fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, chosen, map_texts, restored, shingle_hashes, slices, spread, squeezed, table
from millrace.llm.components import components

WIDTH = 5
#: Link at this percentage of intersection to union.
PERCENT = 75
#: Bits of a signature, and children of a node.
SIGNATURE, FAN = 2048, 16
#: Sets that are compared one by one: their bitmaps would cost more.
LEAF = 4
#: Sets, and bytes of their shingles, that one task compares with each other.
BLOCK, BLOCK_BYTES = 250, 16 << 20
#: Sets of a large cluster that each of its blocks gets besides its own.
HUBS = 16
#: Bytes of a set up to which it moves no worse than a signature, and of such sets
#: that one task compares by their rare shingles.
SMALL, SMALL_BYTES = 512, 4 << 20
#: Sets up to which all pairs of a rare shingle's sets are made at once, beside a tree.
SHORT = 64
#: Shingles of pairs that are compared at a time.
PAIR_SHINGLES = 1 << 20


#: A set's digest as numpy compares it.
PAIR = np.dtype([("a", "u8"), ("b", "u8")])


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted 64-bit hashes of a text's shingles; of fewer words than width,
    one hash of them all; without words, none."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(words, min(width, len(words))) + np.uint64(len(words) if len(words) < width else 0))


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def set_table(docs: DataFrame, width: int, carry: list[str]) -> DataFrame:
    """Columns carry of docs with node, 64 bits of their set's digest, and n_shingles."""

    def work(_: pa.RecordBatch, texts: list[str]) -> list:
        sets = [shingle_set(t, width) for t in texts]
        return [np.frombuffer(b"".join(set_key(s) for s in sets), PAIR)["a"].view(np.int64), [len(s) for s in sets]]

    return map_texts(docs, work, [("node", "long"), ("n_shingles", "long")], carry)


def dealt(docs: DataFrame, width: int, ranges: int) -> DataFrame:
    """Packed shingles by range of hash: (range, sets, sizes, counts, hashes),
    the arrays' bytes. Of a slice's equal sets one goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch):
                own = {}
                for t in texts:
                    s = shingle_set(t, width)
                    if len(s):
                        own.setdefault(set_key(s), s)
                if not own:
                    continue
                keys = np.frombuffer(b"".join(own), "V16")
                sizes = np.array([len(s) for s in own.values()], np.uint32)
                flat = np.concatenate(list(own.values()))
                of = np.repeat(np.arange(len(keys)), sizes)
                where = ((flat >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                order = np.argsort(where, kind="stable")
                edges = np.searchsorted(where[order], np.arange(ranges + 1).astype(np.uint64))
                rows = []
                for r in range(ranges):
                    part = order[edges[r] : edges[r + 1]]
                    if len(part):
                        who, counts = np.unique(of[part], return_counts=True)
                        rows.append((r, keys[who].tobytes(), squeezed(sizes[who]), squeezed(counts.astype(np.uint32)), low_bytes(flat[part])))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate([pa.int32()] + [pa.binary()] * 4)], names=["range", "sets", "sizes", "counts", "hashes"])

    return docs.select("text").mapInArrow(run, "range int, sets binary, sizes binary, counts binary, hashes binary")


def low_bytes(h: np.ndarray) -> bytes:
    """The seven low bytes of hashes; a range implies the eighth, or most of it."""
    return h.reshape(-1, 1).view(np.uint8)[:, :7].tobytes()


def from_low(data: bytes, top: np.ndarray | int) -> np.ndarray:
    """Hashes of low_bytes, with a number below 256 for their range on top."""
    seven = np.frombuffer(data, np.uint8).reshape(-1, 7)
    out = np.zeros((len(seven), 8), np.uint8)
    out[:, :7] = seven
    out[:, 7] = top
    return out.view(np.uint64).reshape(-1)


def unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed arrays of several rows, joined: sets, sizes, counts."""
    sizes, counts = (np.concatenate([spread(x, "u4") for x in rows[c]]) for c in ("sizes", "counts"))
    return np.frombuffer(b"".join(rows["sets"]), "V16"), sizes, counts


def shared_of_range(buckets: int):
    """What a range knows of its sets' shared shingles, packed for the buckets of sets."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, sizes, counts = unpacked(rows)
        hashes = from_low(b"".join(rows["hashes"]), int(rows["range"].iloc[0]) % 256)
        _, first = np.unique(keys.view(PAIR), return_index=True)
        single = np.zeros(len(keys), bool)
        single[first] = True
        kept = np.repeat(single, counts)
        hashes, of = hashes[kept], np.repeat(np.arange(len(keys)), counts)[kept]
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        runs = np.diff(np.concatenate([starts, [len(ranked)]]))
        found = np.empty(len(ranked), np.int64)
        found[order] = np.repeat(runs, runs)
        common = found > 1
        of, hashes, found = of[common], hashes[common], np.minimum(found[common], 65535).astype(np.uint16)
        bucket = keys.view("u8")[::2][of] % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1).astype(np.uint64))
        out = []
        for b in range(buckets):
            part = order[edges[b] : edges[b + 1]]
            if len(part):
                who, n = np.unique(of[part], return_counts=True)
                out.append((b, keys[who].tobytes(), squeezed(sizes[who]), squeezed(n.astype(np.uint32)), hashes[part].tobytes(), squeezed(found[part])))
        return pd.DataFrame(out, columns=["bucket", "sets", "sizes", "counts", "hashes", "found"])

    return run


def least_overlaps(n: int, percent: int) -> tuple[int, int]:
    """What a set of n has in common with a partner at least: with a smaller one,
    and with one of its size or larger."""
    return -(-percent * n // 100), -(-2 * percent * n // (100 + percent))


def candidates_of_bucket(percent: int):
    """The sets that share enough shingles: (id, n, prefix, index, shared). The
    prefix has the shingles by which a set finds smaller ones, of which the first
    index are those by which larger ones find it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, sizes, counts = unpacked(rows)
        hashes = np.frombuffer(b"".join(rows["hashes"]), np.uint64)
        found = np.concatenate([spread(x, "u2") for x in rows["found"]])
        kinds, first, kind = np.unique(keys.view(PAIR), return_index=True, return_inverse=True)
        n = sizes[first].astype(np.int64)
        of = np.repeat(kind, counts)
        order = np.lexsort((hashes, found, of))
        edges = np.searchsorted(of[order], np.arange(len(kinds) + 1))
        out = []
        for i in range(len(kinds)):
            share = hashes[order[edges[i] : edges[i + 1]]]  # the rarest first
            need, most = least_overlaps(int(n[i]), percent)
            if len(share) >= need:
                # A smaller partner has at least need of the n; so of any n - need + 1 it has one.
                rare, index = len(share) - need + 1, max(0, len(share) - most + 1)
                out.append((kinds[i]["a"].view(np.int64), int(n[i]), share[:rare].view(np.int64), index, np.sort(share).tobytes()))
        return pd.DataFrame(out, columns=["id", "n", "prefix", "index", "shared"])

    return run


class Forest:
    """Which sets are connected already."""

    def __init__(self, labels: np.ndarray):
        first: dict[int, int] = {}
        self.parent = [first.setdefault(x, i) for i, x in enumerate(labels.tolist())]

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def all_one(self, start: int, stop: int, other: int, end: int) -> bool:
        top = self.find(start)
        return all(self.find(i) == top for i in range(start, stop)) and all(self.find(i) == top for i in range(other, end))


def tree_links(sizes: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of sets (as positions) that link and weren't connected before. sets
    hold the shingles that may be shared, sizes count all; labels tell which are
    connected from the start.

    Bound: an element of a whose bit b lacks is no common one, so the overlap is
    at most the common bits and the elements that share a bit with another one
    of their set (slack). OR-ed bitmaps and the largest slack of a node bound
    all its sets, the least sizes bound what the threshold needs.
    """
    order = np.argsort(sizes, kind="stable")
    sizes, sets, labels = sizes[order], [sets[i] for i in order], labels[order]
    forest, links = Forest(labels), []

    def compare(i: int, j: int) -> None:
        x, y = forest.find(i), forest.find(j)
        if x != y:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both * (100 + percent) >= percent * int(sizes[i] + sizes[j]):
                forest.parent[x] = y
                links.append((int(order[i]), int(order[j])))

    if len(sets) <= LEAF:
        for j in range(len(sets)):
            for i in range(j):
                compare(i, j)
        return links
    signs, lengths, slack = signatures(sets)
    levels = [(signs, sizes, sizes, lengths, slack)]
    while len(levels[-1][0]) > FAN:
        sign, low, high, most, loose = levels[-1]
        cuts = np.arange(0, len(sign), FAN)
        levels.append((np.bitwise_or.reduceat(sign, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(most, cuts), np.maximum.reduceat(loose, cuts)))

    def visit(level: int, a: range, b: range) -> None:
        """Children a against children b of that level; both may be the same."""
        sign, low, high, most, loose = levels[level]
        left, right = slice(a.start, a.stop), slice(b.start, b.stop)
        common = np.bitwise_count(sign[left, None, :] & sign[None, right, :]).sum(axis=2).astype(np.int64)
        overlap = np.minimum(common + np.minimum(loose[left, None], loose[None, right]), np.minimum(most[left, None], most[None, right]))
        open_ = overlap * (100 + percent) >= percent * (low[left, None] + low[None, right])
        open_ &= (100 * high[left, None] >= percent * low[None, right]) & (100 * high[None, right] >= percent * low[left, None])
        found, with_ = np.nonzero(open_)
        best = np.argsort(-overlap[found, with_], kind="stable")
        span = FAN**level
        for i, j in zip((found[best] + a.start).tolist(), (with_[best] + b.start).tolist(), strict=True):
            if i > j or (level == 0 and i == j):
                continue
            if level:
                ends = min((i + 1) * span, len(sets)), min((j + 1) * span, len(sets))
                if not forest.all_one(i * span, ends[0], j * span, ends[1]):
                    below = len(levels[level - 1][0])
                    visit(level - 1, range(i * FAN, min((i + 1) * FAN, below)), range(j * FAN, min((j + 1) * FAN, below)))
            else:
                compare(i, j)

    whole = range(len(levels[-1][0]))
    visit(len(levels) - 1, whole, whole)
    return links


def linked(sizes: np.ndarray, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (a, b) of positions link, compared exactly and many at once."""
    lengths = np.array([len(s) for s in sets], np.int64)
    out = np.minimum(lengths[a], lengths[b]) * (100 + percent) >= percent * (sizes[a] + sizes[b])
    open_ = np.flatnonzero(out)
    both = lengths[a[open_]] + lengths[b[open_]]
    for part in np.split(open_, np.flatnonzero(np.diff(np.cumsum(both) // PAIR_SHINGLES)) + 1):
        if len(part):
            x, y = a[part], b[part]
            flat = np.concatenate([sets[i] for i in np.stack([x, y], axis=1).reshape(-1).tolist()])
            if flat.itemsize > 4:
                flat = np.unique(flat, return_inverse=True)[1]
            pair = np.repeat(np.arange(len(part), dtype=np.uint64), lengths[x] + lengths[y])
            flat = flat.astype(np.uint64) | (pair << np.uint64(32))
            flat.sort()
            common = np.bincount((flat[1:][flat[1:] == flat[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(part))
            out[part] = common * (100 + percent) >= percent * (sizes[x] + sizes[y])
    return out


def rare_links(sizes: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """tree_links for many sets that share something and mostly nothing more: only those
    that share one of their shingles that are rarest among these sets meet, the sets of a
    rare one in pairs, by their signatures first, those of others in a tree."""
    if len(sets) <= BLOCK:
        return tree_links(sizes, sets, labels, percent)
    lengths = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), lengths)
    _, kind, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count[kind] > 1
    of, kind = of[common], kind[common]
    order = np.lexsort((kind, count[kind], of))
    of, kind = of[order], kind[order]
    held = np.bincount(of, minlength=len(sets))
    need, most = np.array([least_overlaps(int(n), percent) for n in sizes]).T
    place = np.arange(len(of)) - np.repeat(np.cumsum(held) - held, held)
    # Of any held - need + 1 of what a set has in common with others, a smaller partner has
    # one, and one of its size or larger has one of any held - most + 1.
    index = place < (held - most + 1)[of]
    first = place < (held - need + 1)[of]
    of, kind, index = of[first], kind[first], index[first]
    order = np.argsort(kind, kind="stable")
    of, kind, index = of[order], kind[order], index[order]
    starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.zeros(0, np.int64)
    many = np.diff(np.concatenate([starts, [len(kind)]]))
    links, forest = [], Forest(labels)

    def add(i: int, j: int) -> None:
        x, y = forest.find(i), forest.find(j)
        if x != y:
            forest.parent[x] = y
            links.append((i, j))

    few = np.repeat(many <= SHORT, many)
    own, token, low, n = of[few], kind[few], index[few], sizes[of[few]]
    pairs = [np.zeros(0, np.int64)]
    for d in range(1, SHORT):
        x, y = slice(0, max(0, len(own) - d)), slice(d, None)
        meet = (token[x] == token[y]) & ((low[x] & (low[y] | (n[y] > n[x]))) | (low[y] & (n[x] > n[y])))
        meet &= labels[own[x]] != labels[own[y]]
        meet = np.flatnonzero(meet)
        pairs.append(own[meet] * len(sets) + own[meet + d])
    pairs = np.unique(np.concatenate(pairs))
    if len(pairs):
        signs, lengths, slack = signatures(sets)
        for start in range(0, len(pairs), 1 << 16):
            part = pairs[start : start + (1 << 16)]
            a, b = part // len(sets), part % len(sets)
            both = np.bitwise_count(signs[a] & signs[b]).sum(axis=1).astype(np.int64) + np.minimum(slack[a], slack[b])
            open_ = both * (100 + percent) >= percent * (sizes[a] + sizes[b])
            a, b = a[open_], b[open_]
            yes = linked(sizes, sets, a, b, percent)
            for i, j in zip(a[yes].tolist(), b[yes].tolist(), strict=True):
                add(i, j)
    seen = set()
    for start, size in zip(starts[many > SHORT].tolist(), many[many > SHORT].tolist(), strict=True):
        own = of[start : start + size]
        if index[start : start + size].any() and (name := own.tobytes()) not in seen:
            seen.add(name)
            tops = np.array([forest.find(i) for i in own.tolist()])
            for i, j in tree_links(sizes[own], [sets[k] for k in own], tops, percent):
                add(int(own[i]), int(own[j]))
    return links


def joined_units(percent: int, kind: str):
    """The links inside the groups of a unit: rows (group, id, n, shared, label) of sets."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, labels = (rows[c].to_numpy() for c in ("id", "n", "label"))
        sets = [np.frombuffer(x, kind) for x in rows["shared"].to_numpy()]
        of = rows["group"].to_numpy()
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(of[order]) != 0])) if len(of) else np.zeros(0, np.int64)
        many = np.diff(np.concatenate([starts, [len(of)]]))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # The pairs of the smallest groups are compared together.
        for d in range(1, LEAF):
            for k in range(d, LEAF):
                at = starts[(many > k) & (many <= LEAF)]
                a.append(order[at + k - d])
                b.append(order[at + k])
        x, y = np.concatenate(a), np.concatenate(b)
        apart = labels[x] != labels[y]
        x, y = x[apart], y[apart]
        yes = linked(sizes, sets, x, y, percent)
        a, b = [ids[x[yes]]], [ids[y[yes]]]
        for start, size in zip(starts[many > LEAF].tolist(), many[many > LEAF].tolist(), strict=True):
            own = order[start : start + size]
            found = np.array(rare_links(sizes[own], [sets[k] for k in own], labels[own], percent), np.int64).reshape(-1, 2)
            a.append(ids[own[found[:, 0]]])
            b.append(ids[own[found[:, 1]]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}, dtype=np.int64)

    return run


#: Tasks' worth of small groups for each shuffle partition.
UNITS = 4


def by_unit(members: DataFrame) -> GroupedData:
    """members (group, blocks, block, part and others) by unit: a block and part of a
    large group is one, and so are many small groups."""
    many = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")) * UNITS
    alone = F.col("blocks") > 1
    unit = [
        F.when(alone, F.col("group")).otherwise(F.pmod(F.xxhash64("group"), F.lit(many).cast("long"))).alias("unit"),
        F.when(alone, F.col("block")).otherwise(F.lit(-1).cast("long")).alias("of"),
        F.when(alone, F.col("part")).otherwise(F.lit(0).cast("long")).alias("side"),
    ]
    return members.select("*", *unit).groupBy("unit", "of", "side")


def joined(members: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links (a, b) inside the groups of members (UNIT)."""
    return by_unit(members).applyInPandas(joined_units(percent, kind), "a long, b long")


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps of sets, their lengths, and how many elements share a bit with another
    of their set (slack)."""
    bits = np.zeros((len(sets), SIGNATURE), bool)
    for i, s in enumerate(sets):
        bits[i, (s & s.dtype.type(SIGNATURE - 1)).astype(np.int64)] = True
    signs = np.packbits(bits, axis=1).view(np.uint64)
    lengths = np.array([len(s) for s in sets], np.int64)
    return signs, lengths, lengths - np.bitwise_count(signs).sum(axis=1).astype(np.int64)


def signed(sets: DataFrame, kind: str) -> DataFrame:
    """(id, n, label, sign, length, slack) of sets (SET)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                signs, lengths, slack = signatures([np.frombuffer(x, kind) for x in part.column(3).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([s.tobytes() for s in signs], pa.binary()), pa.array(lengths), pa.array(slack)], names=["id", "n", "label", "sign", "length", "slack"])

    return sets.select("id", "n", "label", "shared").mapInArrow(run, "id long, n long, label long, sign binary, length long, slack long")


def open_units(percent: int):
    """Of rows (group, blocks, block, part, and what signed gives) those whose signature
    leaves them a partner in their group that isn't connected with them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        of, taken = rows["group"].to_numpy(), []
        order = np.argsort(of, kind="stable")
        every = np.frombuffer(b"".join(rows["sign"]), np.uint64).reshape(len(rows), -1)
        sizes, labels, most, loose = (rows[c].to_numpy() for c in ("n", "label", "length", "slack"))
        for own in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            for start in range(0, len(own), 64):
                a = own[start : start + 64]
                common = np.bitwise_count(every[a][:, None, :] & every[own][None, :, :]).sum(axis=2).astype(np.int64)
                overlap = np.minimum(common + np.minimum(loose[a][:, None], loose[own][None]), np.minimum(most[a][:, None], most[own][None]))
                open_ = overlap * (100 + percent) >= percent * (sizes[a][:, None] + sizes[own][None])
                taken.append(a[(open_ & (labels[a][:, None] != labels[own][None])).any(axis=1)])
        return rows.iloc[np.concatenate(taken)][["group", "blocks", "block", "part", "id"]]

    return run


def numbers(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def blocks_of(sets: Column, size: Column) -> Column:
    return F.greatest(F.ceil(sets / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("long")


SET = ("id", "n", "shared", "label")
UNIT = ("group", "blocks", "block", "part", *SET)


def unconnected(now: DataFrame, tokens: DataFrame, percent: int, kind: str, scratch: Scratch) -> DataFrame:
    """The rows (UNIT) that the second join needs, of the sets now (cluster, blocks,
    block, SET) of large clusters, label telling what is connected.

    By blocks: what isn't connected with its cluster's largest component, in parts,
    meets all blocks. By shingles: all sets of a shingle meet, where they aren't
    connected already. Each cluster takes the way of fewer rows: few outliers of many
    near copies go by blocks; sets that have passages in common and nothing more, by
    shingles, whose rows grow as the sets do. There signatures go first, an eighth of
    a usual set, and only sets that may have a partner follow them. Sets as small as
    signatures go at once, many to a task, where only those meet that share a shingle
    which is rare among them.
    """
    per = now.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k"), F.first("blocks").alias("blocks"))
    tops = per.groupBy("cluster").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("all"), F.first("blocks").alias("blocks"))
    rest = F.col("all") - F.col("top.k")
    tops = tops.where(rest > 0).select("cluster", F.col("top.label").alias("top"), F.ceil(rest * F.col("blocks") / F.col("all")).cast("long").alias("parts"), "all", rest.alias("rest"), "blocks")
    tops = scratch.keep(tops.withColumn("by_blocks", F.col("all") * F.col("parts") + F.col("rest") * F.col("blocks")))
    todo = now.join(tops.select("cluster"), "cluster", "left_semi").select("cluster", "id", "label", F.octet_length("shared").alias("size"))
    held = scratch.keep(tokens.join(todo, "id"))
    groups = held.groupBy("cluster", "token").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("id")).alias("list"), F.max("index").alias("index"), F.min("label").alias("first"), F.max("label").alias("last"))
    # Shingles of the same sets are one group.
    groups = groups.where("index and first <> last").groupBy("cluster", "sets", "list").agg(F.min("token").alias("token"), F.first("bytes").alias("bytes"))
    small = F.col("bytes") <= SMALL * F.col("sets")
    blocks = F.when(small, F.ceil(F.col("bytes") / SMALL_BYTES)).otherwise(blocks_of(F.col("sets"), F.col("bytes"))).cast("long")
    groups = scratch.keep(groups.select("cluster", "token", "sets", small.alias("small"), blocks.alias("blocks")))
    by_tokens = groups.groupBy("cluster").agg(F.sum(F.col("sets") * F.col("blocks")).alias("by_tokens"))
    ways = scratch.keep(tops.join(by_tokens, "cluster", "left").withColumn("tokens", F.coalesce("by_tokens", F.lit(0)) < F.col("by_blocks")).select("cluster", "top", "parts", "tokens"))

    whole = now.join(ways.where("not tokens"), "cluster").withColumn("group", F.col("cluster"))
    rest = whole.where("label <> top").withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts"))).drop("block").withColumn("block", numbers(F.col("blocks")))
    every = whole.withColumn("part", numbers(F.col("parts")))

    taken = groups.join(ways.where("tokens").select("cluster"), "cluster", "left_semi")
    near = held.select("id", "token").join(taken.select("token", "blocks", "small"), "token").select("id", F.col("token").alias("group"), F.col("blocks").alias("of"), "small")
    near = near.withColumn("own", F.pmod(F.xxhash64("id", "group"), F.col("of"))).withColumn("other", numbers(F.col("of")))
    near = near.select("id", "group", F.col("of").alias("blocks"), F.least("own", "other").alias("block"), F.greatest("own", "other").alias("part"), "small")
    signs = scratch.keep(signed(now.join(ways.where("tokens"), "cluster", "left_semi"), kind))
    told = by_unit(near.where("not small").drop("small").join(signs, "id")).applyInPandas(open_units(percent), "group long, blocks long, block long, part long, id long")
    near = scratch.keep(told.unionByName(near.where("small").drop("small")))
    near = near.join(now.select(*SET), "id")
    return rest.select(*UNIT).unionByName(every.select(*UNIT)).unionByName(near.select(*UNIT))


def links_of(sets: DataFrame, percent: int, scratch: Scratch, kind: str = "u8") -> DataFrame:
    """Links (a, b) that connect what is connected, over sets (id, n, prefix, index,
    shared), shared being sorted numbers of that kind.

    A large cluster is parted into blocks, each joined with itself and some hubs
    of the cluster. That leaves few sets of near copies that aren't connected with
    their cluster's largest component; see unconnected for these.
    """
    tokens = sets.select("id", "n", "index", F.posexplode("prefix").alias("at", "token"))
    tokens = scratch.keep(tokens.select("id", "n", "token", (F.col("at") < F.col("index")).alias("index")))
    least = tokens.groupBy("token").agg(F.min(F.when(F.col("index"), F.col("id"))).alias("m"), F.min(F.when(F.col("index"), F.col("n"))).alias("low"), F.count(F.lit(1)).alias("sets"))
    least = scratch.keep(least.where("sets > 1 and m is not null").select("token", "m", "low"))
    edges = tokens.join(least, "token").where("id <> m and n >= low").select(F.col("id").alias("a"), F.col("m").alias("b"))
    clusters = scratch.keep(components(edges, scratch))
    sizes = sets.select("id", F.octet_length("shared").alias("size")).join(clusters, F.col("id") == F.col("node")).select("id", F.col("component").alias("cluster"), "size")
    weights = sizes.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("bytes"))
    weights = scratch.keep(weights.select("cluster", "sets", blocks_of(F.col("sets"), F.col("bytes")).alias("blocks")))
    placed = scratch.keep(sizes.join(weights, "cluster").select("id", "cluster", "sets", "blocks"))
    members = sets.drop("prefix", "index").join(placed, "id").withColumns({"block": F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")), "label": F.col("id"), "group": F.col("cluster"), "part": F.lit(0).cast("long")})
    members = scratch.keep(members)
    large = members.where("blocks > 1")
    hubs = large.where(F.pmod(F.xxhash64("id", F.lit("hub")), F.col("sets")) < HUBS).drop("block").withColumn("block", numbers(F.col("blocks")))
    links = scratch.keep(joined(members.select(*UNIT).unionByName(hubs.select(*UNIT)), percent, kind))
    if large.isEmpty():
        return links
    labels = components(links, scratch).select("node", F.col("component").alias("label"))
    now = large.drop("label").join(labels, large["id"] == labels["node"], "left").withColumn("label", F.coalesce("label", "id"))
    now = scratch.keep(now.select("cluster", "blocks", "block", *SET))
    return scratch.keep(links.unionByName(joined(unconnected(now, tokens.select("id", "token", "index"), percent, kind, scratch), percent, kind)))


def connected_sets(docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """(node, component) of the sets of docs (text) that link with others."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = dealt(docs, width, parts).groupBy("range").applyInPandas(shared_of_range(parts), "bucket int, sets binary, sizes binary, counts binary, hashes binary, found binary")
    sets = ranges.groupBy("bucket").applyInPandas(candidates_of_bucket(percent), "id long, n long, prefix array<long>, index int, shared binary")
    return scratch.keep(components(links_of(scratch.keep(sets), percent, scratch), scratch))


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs.

    Documents link when intersection to union of their shingle sets is at least
    percent; component_id is the smallest doc_id that links reach. Shingles are
    compared by 64-bit hashes, and sets are told apart by 64 bits of a digest. Equal
    sets are one set with many documents. Null, empty and blank texts have empty sets,
    linked with nothing. Rows of one id are judged by their own texts. Rows without id
    link as others do, and hold others together; where none of a component has one,
    component_id is null. Very long texts are whole. Other columns don't matter. An
    empty table gives none.

    Nothing is cut: a range has the shingles of a share of the hashes, a bucket
    the sets of a share of the keys, both as many as there are shuffle
    partitions, and a cluster is compared in blocks. From 256 ranges on, hashes
    are whole; below, up to 8 of their 64 bits are those of the range.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = chosen(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = scratch.keep(set_table(docs, width, ["doc_id"]))
    tops = connected_sets(docs, width, percent, scratch)
    owners = scratch.keep(rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("id")).join(tops, "node", "left"))
    least = scratch.keep(owners.where("component is not null").groupBy("component").agg(F.min("id").alias("top")))
    named = scratch.keep(owners.join(least, "component", "left").select("node", F.coalesce("top", "id").alias("top")))
    return rows.join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("top", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs without near duplicates: of each component of linked texts the
    row of the smallest doc_id (none: last; then by a hash of the row).

    Rows are judged by their texts, also where they share an id or have none. Of equal
    rows one stays. Texts without words are linked with nothing, and stay.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    source = chosen(docs, docs.columns, doc_id="doc_id", text="text").withColumn("key", F.xxhash64("row"))
    rows = scratch.keep(set_table(source.select("doc_id", "key", "text"), width, ["doc_id", "key"]))
    tops = connected_sets(source.select("text"), width, percent, scratch)
    group = rows.where("n_shingles > 0").join(tops, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = group.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")).select("first.key")
    times = rows.groupBy("key").agg((F.max("n_shingles") == 0).alias("blank"), F.count(F.lit(1)).alias("rows"))
    stay = scratch.keep(times.join(first.withColumn("chosen", F.lit(True)), "key", "left").where("blank or chosen").select("key", (~F.col("blank") & (F.col("rows") > 1)).alias("several")))
    placed = source.select("row", "key").join(stay, "key")
    once = restored(placed.where("not several"), docs.columns)
    if stay.where("several").isEmpty():
        return once
    return once.unionAll(restored(placed.where("several").groupBy("key").agg(F.first("row").alias("row")), docs.columns))


def op1_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k : k + 4], ' '))) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
