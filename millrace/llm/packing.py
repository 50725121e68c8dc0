"""Packing of tokenized documents into sequences of one length.

Shortest-pack-first over the histogram of lengths: all packs are opened at
once, as many as the tokens fill, and lengths are placed longest first, each
into the packs that are emptiest. Packs that were filled alike are one pattern
with a count, so the work depends on the histogram, which has at most as many
entries as a sequence has tokens, and not on the documents. What a pattern
takes is then found for each document by its rank among those of its length.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from millrace.llm.common import SLICE_CHARS, Scratch, chosen, restored, slices, spread, squeezed, table, without

#: Tokens of a sequence.
LIMIT = 4096
#: The id that ends a document.
END = 2
#: Pieces of text whose ids a Python worker remembers, and their bytes with these ids;
#: all are forgotten beyond that.
REMEMBERED, REMEMBERED_BYTES = 800_000, 100_000_000

MADE = ("start", "length", "doc_tokens", "sequence_id", "offset", "ids")

#: Kinds of UTF-8 bytes. White space, letters (the lead byte of Latin-1's
#: are among them), digits, marks, and all others.
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[0x21:0x7F] = MARK
for _kind, _bytes in ((SPACE, b"\t\n\v\f\r "), (DIGIT, b"0123456789"), (LETTER, bytes([*range(65, 91), *range(97, 123), 0xC3]))):
    KINDS[list(_bytes)] = _kind
#: ASCII bytes in lower case.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: The tokenizer that Encoder cuts words for.
NORMALIZER = [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_words(path: str) -> bool:
    """Whether a tokenizer file lower-cases, then cuts words as pieces() does, ends each
    piece with a token in </w>, and has no special strings but those that begin with <|."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    normal, cut, model = d["normalizer"] or {}, d["pre_tokenizer"] or {}, d["model"]
    cuts = [(c["type"], c.get("pattern"), c.get("behavior"), c.get("invert"), c.get("add_prefix_space"), c.get("use_regex")) for c in cut.get("pretokenizers", [])]
    return (
        [(c["type"], c.get("pattern")) for c in normal.get("normalizers", [])] == NORMALIZER
        and cuts == [("Split", {"Regex": SPLIT}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
        and (model["type"], model["end_of_word_suffix"], model["dropout"]) == ("BPE", "</w>", None)
        and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"]) for t in d["added_tokens"])
    )


def pieces(texts: list[str], cut: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(pieces of texts as dictionary of bytes, which entries of it are as written, and
    pieces of each text). Texts are cut at white space; if cut, words of ASCII and Latin-1
    letters also as SPLIT does, in lower case. Words with other characters, or with what
    may be a special string, stay whole and as written."""
    encoded = [t.encode("utf-8") for t in texts]
    # White space around, so that each byte has neighbours.
    data = b"".join((b"\n", b"\n".join(encoded), b"\n\n\n"))
    raw = np.frombuffer(data, np.uint8)
    kind, low = KINDS[raw], LOWER[raw]
    lead = np.flatnonzero(raw == 0xC3)
    follow = raw[lead + 1]
    letter = (follow != 0x97) & (follow != 0xB7)  # not the signs of times and division
    kind[lead[~letter]] = OTHER
    kind[lead[letter] + 1] = LETTER
    low[lead[letter & (follow < 0x9F)] + 1] += 0x20
    if not cut:
        kind[kind != SPACE] = OTHER
    if b"<|" in data:
        kind[np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))] = OTHER
    if (other := np.flatnonzero(kind == OTHER)).size:
        edges = np.flatnonzero((kind[1:] != SPACE) != (kind[:-1] != SPACE)) + 1
        words = np.unique(np.searchsorted(edges, other, "right") - 1)
        sizes = edges[words + 1] - edges[words]
        own = np.repeat(edges[words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        kind[own], low[own] = OTHER, raw[own]
    start = np.zeros(len(raw), bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= kind == DIGIT
    start &= kind != SPACE
    # 's and the like: only where the mark comes first among marks.
    mark = np.flatnonzero((raw == ord("'")) & (kind == MARK) & start)
    mark = mark[kind[mark + 1] == LETTER]
    one, two = low[mark + 1], low[mark + 2]
    short = np.isin(one, list(b"stmd"))
    long = (np.isin(one, list(b"rv")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    start[mark[short | long] + 1] = False
    for after in (mark[short] + 2, mark[long] + 3):
        start[after[kind[after] == LETTER]] = True
    held = kind != SPACE
    at, body = np.flatnonzero(start), low[held]
    offsets = np.append(np.flatnonzero(start[held]), len(body)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
    written = np.zeros(len(found.dictionary), bool)
    written[found.indices.to_numpy()[kind[at] == OTHER]] = True
    ends = np.cumsum([len(e) + 1 for e in encoded], dtype=np.int64)
    return found, written, np.diff(np.searchsorted(at, ends, "right"), prepend=0)


class Encoder:
    """Ids of texts by a tokenizer file whose tokens never reach over white space. Each
    piece of texts is encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = cuts_words(path)
        # For pieces that are cut: the model alone. They are told apart by its tokens in </w>.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[n for t, n in vocab.items() if t.endswith("</w>")]] = True
        # How the tokenizer writes the bytes of such pieces, by UTF-8's letters of two bytes.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = np.arange(256, dtype="<u4")
        for k in range(0x80, 0xC0):
            lead, follow = level.pre_tokenize_str(chr(0xC0 | k & 0x3F))[0][0]
            self.written[[0xC3, k]] = ord(lead), ord(follow)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, bytes] = {}
        self.bytes = 0

    def learn(self, keys: list[bytes], written: list[bool]) -> None:
        """Ids of pieces that aren't known, each once; of those as written by the whole
        tokenizer, whose changes of texts take most of its time."""
        plain = [k for k, w in zip(keys, written, strict=True) if not w]
        rest = [k for k, w in zip(keys, written, strict=True) if w]
        joined = self.written[np.frombuffer(b" ".join(plain), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        ends = np.append(0, np.flatnonzero(self.last[ids]) + 1)
        if len(ends) != len(plain) + 1 or ends[-1] != len(ids):
            raise ValueError("a piece has not one token in </w>, at its end")
        cuts, data = (4 * ends).tolist(), ids.tobytes()
        self.known.update(zip(plain, [data[a:b] for a, b in pairwise(cuts)], strict=True))
        own = self.tokenizer.encode_batch_fast([k.decode("utf-8") for k in rest], add_special_tokens=False)
        self.known.update((k, np.array(e.ids, "<u4").tobytes()) for k, e in zip(rest, own, strict=True))
        self.bytes += len(joined) + len(data) + sum(len(k) + len(self.known[k]) for k in rest)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        short = iter(self.encode_all([t for t in texts if len(t) <= SLICE_CHARS]))
        return [next(short) if len(t) <= SLICE_CHARS else np.concatenate([self.encode_all([p])[0] for p in portions(t)]) for t in texts]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The same, of texts that are worked on at once."""
        if len(self.known) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.forget()
        found, written, counts = pieces(texts, self.cut)
        if not len(found):
            return [np.zeros(0, "<u4") for _ in texts]
        keys = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, keys))
        if unknown := [j for j, i in enumerate(ids) if i is None]:
            self.learn([keys[j] for j in unknown], written[unknown].tolist())
            for j in unknown:
                ids[j] = self.known[keys[j]]
        # Ids as bytes, so that Arrow puts them in a row.
        row = pa.array(ids, pa.large_binary()).take(found.indices)
        _, offsets, data = row.buffers()
        ends = np.frombuffer(offsets, np.int64)[: len(row) + 1][np.cumsum(counts)] // 4
        return np.split(np.frombuffer(data, "<u4")[: ends[-1]], ends[:-1])


def portions(text: str) -> Iterator[str]:
    """A text in parts of about SLICE_CHARS, cut at spaces or ends of lines only."""
    start = 0
    while len(text) - start > SLICE_CHARS:
        spots = [p for c in " \n" if (p := text.find(c, start + SLICE_CHARS)) >= 0]
        if not spots:
            break
        yield text[start : min(spots)]
        start = min(spots)
    yield text[start:]


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder: what it remembers serves its later tasks too."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def tokenized(docs: DataFrame, carry: list[str], tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(row: columns carry of docs, packed: ids compressed, n: ids, rest: what n leaves
    over full sequences, part, rank among the part's rows of that rest, full sequences
    of the part before this row)."""
    source = chosen(docs, carry, text="text")
    source = source.select(*[c for c in source.columns if c != "text"], F.col("text").cast("string").alias("text"))
    own = source.schema.fields[:-1]
    names = [*[f.name for f in own], "packed", "n", "rest", "part", "rank", "full"]
    schema = StructType([*own, *StructType.fromDDL("packed binary, n long, rest long, part long, rank long, full long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        seen, full = np.zeros(limit, np.int64), 0
        for batch in batches:
            for piece, texts in slices(batch):
                packed, sizes, ranks, fulls = [], [], [], []
                for ids in encode(texts):
                    ids = np.append(ids, np.uint32(END))
                    rest = len(ids) % limit
                    packed.append(squeezed(ids))
                    sizes.append(len(ids))
                    ranks.append(int(seen[rest]))
                    fulls.append(full)
                    seen[rest] += 1
                    full += len(ids) // limit
                n = np.array(sizes, np.int64)
                longs = [n, n % limit, np.full(len(n), part, np.int64), np.array(ranks, np.int64), np.array(fulls, np.int64)]
                yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in range(len(own))], pa.array(packed, pa.binary()), *[pa.array(x, pa.int64()) for x in longs]], names=names)

    return source.mapInArrow(run, schema)


def patterns(counts: dict[int, int], limit: int = LIMIT) -> np.ndarray:
    """What each pattern of packs takes, as rows (length, first rank, first sequence,
    offset, placed, first rank of the rest): documents of that length, from that rank on,
    go to as many sequences from that one on, at the offset. Where no pack has room for
    all of a length, the emptiest are filled up (placed < length) and the rests are
    documents of a shorter length, placed in their turn; so in all sequences together
    less than one is padding. Rows are sorted by length and rank.
    """
    need = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        need[length] = n
    total = int((need * np.arange(limit + 1)).sum())
    packs = -(-total // limit)
    # (negative room, first sequence, packs) of each pattern; each is a run of sequences.
    heap = [(-limit, 0, packs)] if packs else []
    rows = []
    for length in range(limit, 0, -1):
        left, rank = int(need[length]), 0
        while left:
            room, first, count = heapq.heappop(heap)
            take, placed = min(left, count), min(length, -room)
            rows.append((length, rank, first, limit + room, placed, int(need[length - placed]) if placed < length else 0))
            if placed < length:
                need[length - placed] += take
            if take < count:
                heapq.heappush(heap, (room, first + take, count - take))
            if room + placed:
                heapq.heappush(heap, (room + placed, first, take))
            left, rank = left - take, rank + take
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def places(slots: np.ndarray, length: np.ndarray, rank: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(document, tokens before, placed, sequence, offset) of documents by length and
    rank, in rounds: documents that were cut go on with what is left of them."""
    keys = slots[:, 0] << 44 | slots[:, 1]
    who, before, out = np.flatnonzero(length > 0), np.zeros(len(length), np.int64), []
    length, rank = length.copy(), rank.copy()
    while len(who):
        at = np.searchsorted(keys, length[who] << 44 | rank[who], "right") - 1
        ahead = rank[who] - slots[at, 1]
        out.append((who, before[who], slots[at, 4], slots[at, 2] + ahead, slots[at, 3]))
        before[who] += slots[at, 4]
        rank[who] = slots[at, 5] + ahead
        length[who] -= slots[at, 4]
        who = who[length[who] > 0]
    return out


def pack(docs: DataFrame, tokenizer: str, carry: list[str] | None = None, limit: int = LIMIT, scratch: Scratch | None = None) -> DataFrame:
    """A row for each piece of docs: columns carry (default: all but text and those named
    like the new ones), start (the document's ids before it), length, doc_tokens, sequence_id,
    offset (its place there), and ids (little-endian unsigned 32-bit).

    tokenizer is the path of a tokenizer file whose tokens don't reach over white space,
    there on all executors. Each document ends with END; a null or empty text is that id
    alone. A document of more than limit ids fills sequences of its own, and what is left
    over is packed, cut again only where no sequence has room for it. Repeated rows and
    rows that share an id are documents each; of documents of one length, the order of the
    written rows decides. Very long texts are encoded in parts cut at white space. Empty
    tables give no rows. Sequences from packs on, numbered by part, are the full ones.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    carry = without(docs, "text", *MADE) if carry is None else carry
    rows = scratch.keep(tokenized(docs, carry, tokenizer, limit))
    per = scratch.keep(rows.groupBy("rest", "part").agg(F.count(F.lit(1)).alias("n")))
    # A row for each length: at most limit of them, whatever the documents are.
    counts = {r["rest"]: r["n"] for r in per.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    slots = patterns(counts, limit)
    packs = -(-sum(k * n for k, n in counts.items()) // limit)
    base = per.select("rest", "part", (F.sum("n").over(Window.partitionBy("rest").orderBy("part")) - F.col("n")).alias("base"))
    # A row for each part and length: small files, but many rows, so it isn't broadcast.
    ranked = rows.join(base.hint("merge"), ["rest", "part"])
    ranked = ranked.select(*(["row"] if carry else []), "packed", "n", (F.col("rank") + F.col("base")).alias("rank"), (F.lit(packs) + F.shiftleft("part", 32) + F.col("full")).alias("full"))
    shared = docs.sparkSession.sparkContext.broadcast(slots)
    own = ranked.schema.fields[:-4]
    schema = StructType([*own, *StructType.fromDDL("start long, length long, doc_tokens long, sequence_id long, offset long, ids binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, packed in slices(batch, "packed"):
                n, rank, full = (piece.column(len(own) + k).to_numpy() for k in (1, 2, 3))
                whole = n // limit
                who = np.repeat(np.arange(len(n)), whole)
                k = np.arange(len(who)) - np.repeat(np.cumsum(whole) - whole, whole)
                found = [(who, k * limit, np.full(len(who), limit), full[who] + k, np.zeros(len(who), np.int64))]
                found += [(w, whole[w] * limit + before, placed, sequence, offset) for w, before, placed, sequence, offset in places(shared.value, n % limit, rank)]
                who, start, length, sequence, offset = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
                order = np.lexsort((start, who))
                who, start, length, sequence, offset = (x[order] for x in (who, start, length, sequence, offset))
                data = [spread(p, "uint32").astype("<u4").tobytes() for p in packed]
                ids = [data[w][4 * a : 4 * (a + m)] for w, a, m in zip(who.tolist(), start.tolist(), length.tolist(), strict=True)]
                longs = [start, length, n[who], sequence, offset]
                yield pa.RecordBatch.from_arrays([*[piece.column(i).take(pa.array(who)) for i in range(len(own))], *[pa.array(x, pa.int64()) for x in longs], pa.array(ids, pa.binary())], names=schema.names)

    names = [*(["row"] if carry else []), "packed", "n", "rank", "full"]
    placed = ranked.select(*names).mapInArrow(run, schema)
    return restored(placed, carry, *MADE) if carry else placed.select(*MADE)


def sequences(pieces: DataFrame, limit: int = LIMIT, pad: int = 0) -> DataFrame:
    """(sequence_id, tokens, ids) of pack's pieces: ids as they are trained on, padded to
    limit with pad except where the tokens are a power of two. A sequence has at most
    limit pieces, so a group is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), joined.alias("ids"))
    padded = F.rpad(F.col("ids"), 4 * limit, F.lit(int(pad).to_bytes(4, "little")))
    return whole.select("sequence_id", "tokens", F.when(F.bit_count("tokens") == 1, F.col("ids")).otherwise(padded).alias("ids"))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
