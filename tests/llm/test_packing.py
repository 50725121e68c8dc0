import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = ["The", "quick", "naïve", "ÉTÉ", "don't", "it's", "x'RE", "end.", "(see", "a,b;c", "12,5", "ΑΣ", "Σ", "ǅ", "İstanbul", "é", "́x", "日本語テキスト", "👍🏽", "<|endoftext|>", "<|STARTOFTEXT|>", "a\x1cb", "q\x1f", "\xa0", "tab\tbed", "line\nend", " ", "\x85", "ﬁ", "word.'s", "''", "--", "I", "aa" * 300]


def texts(seed, n=60):
    rng = random.Random(seed)
    alphabet = "abcXYZ '.,-\n\t\x1d<|éß你̀ⅷ٣_"
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", " ", "\n", "<|endoftext|>", "a" * 5000]


def whole(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_gives_the_tokenizer_s_ids(monkeypatch):
    tokenizer, encoder = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    for seed, chars, held in ((1, 1_000_000, 400_000), (2, 40, 400_000), (3, 7, 0)):
        monkeypatch.setattr(packing, "SLICE_CHARS", chars)
        monkeypatch.setattr(packing, "REMEMBERED", held)
        cases = texts(seed)
        for part in (cases, cases[::-1], cases[:1], []):
            assert [x.tolist() for x in encoder.encode(part)] == [whole(tokenizer, t) for t in part]


@pytest.mark.parametrize("seed", range(6))
def test_pieces_of_words_give_the_tokenizer_s_ids(seed):
    rng = random.Random(seed)
    alphabet = ["'", "'", *"stmdrevlLSRE", "é", "É", "ß", "ÿ", "Þ", "×", "÷", "µ", "¿", "ﬁ", "́", *"07$#<|>/w", "<|", "<|endoftext|>", "</w>", " ", "\n", "\xa0", "\0", "\x1f", "\x7f"][: rng.choice([19, 26, 99])]
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    tokenizer = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in packing.Encoder(PATH).encode(cases)] == [whole(tokenizer, t) for t in cases]


def test_words_with_marks_need_no_tokenizer_of_their_own():
    encoder = packing.Encoder(PATH)
    asked, tokenizer = [], encoder.tokenizer

    class Asked:
        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return tokenizer.encode_batch_fast(texts, **more)

    encoder.tokenizer = Asked()
    text = "thhe### lyhare$$$ It's L'ÉCOLE, d'été! a@mail1.example.com 22.210.186.51 (x)"
    assert encoder.encode([text, text + " «oui» x÷y"])[1].tolist() == whole(tokenizer, text + " «oui» x÷y")
    assert sorted(asked) == ["x÷y", "«oui»"]


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 10_000)
    encoder, tokenizer = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    for seed in range(4):
        cases = ["語" * 2000 + str(seed), *texts(seed)]
        assert [x.tolist() for x in encoder.encode(cases)] == [whole(tokenizer, t) for t in cases]
        assert cases[0].encode() in encoder.known and len(encoder.known) < 1000


def test_tokenizers_that_cut_otherwise(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    file["normalizer"]["normalizers"].pop()  # capitals stay
    path = str(tmp_path / "capitals.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(file, f)
    assert packing.cuts_words(PATH) and not packing.cuts_words(path)
    tokenizer, cases = Tokenizer.from_file(path), texts(4)
    assert [x.tolist() for x in packing.Encoder(path).encode(cases)] == [whole(tokenizer, t) for t in cases]


@pytest.mark.parametrize("seed", range(30))
def test_patterns_hold_each_document_once(seed):
    rng = random.Random(seed)
    limit = rng.choice([1, 2, 7, 16, 100])
    counts = {k: rng.randint(1, rng.choice([2, 500])) for k in range(1, limit) if rng.random() < rng.choice([0.1, 0.9])}
    slots = packing.patterns(counts, limit)
    length = np.repeat(np.array(list(counts), np.int64), list(counts.values()))
    rank = np.concatenate([*[np.arange(n) for n in counts.values()], np.zeros(0, np.int64)]).astype(np.int64)
    room, got = {}, np.zeros(len(length), np.int64)
    for who, before, placed, sequence, offset in packing.places(slots, length, rank):
        assert (before == got[who]).all()
        got[who] += placed
        for s, o, p in zip(sequence.tolist(), offset.tolist(), placed.tolist()):
            room.setdefault(s, []).append((o, p))
    assert (got == length).all()
    assert sorted(room) == list(range(-(-int(length.sum()) // limit)))
    for own in room.values():
        at = 0
        for o, p in sorted(own):
            assert o == at and p > 0
            at += p
        assert at <= limit


def test_longest_first_into_the_emptiest():
    # Nine tokens are two packs of five: 4 and 3 open them, 2 goes to the emptier.
    assert packing.patterns({4: 1, 3: 1, 2: 1}, 5).tolist() == [[2, 0, 1, 3, 2, 0], [3, 0, 1, 0, 3, 0], [4, 0, 0, 0, 4, 0]]
    assert len(packing.patterns({k: 10**9 for k in range(1, 4096)}, 4096)) < 20_000


def test_pack_on_spark(spark):
    rng = random.Random(5)
    rows = [(i, t, "clash") for i, t in enumerate(texts(7) + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 400))) for _ in range(100)])]
    rows += [(3, rows[3][1], "clash"), (3, "another of the same id", "clash"), (None, "no id", None), (None, None, None), (900, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string").repartition(3)
    tokenizer, limit = Tokenizer.from_file(PATH), 64
    pieces = packing.pack(docs, PATH, ["doc_id", "text"], limit).persist()
    assert pieces.columns == ["doc_id", "text", *packing.MADE]
    got = pieces.collect()
    want = sorted((d is None, d or 0, tuple(whole(tokenizer, t) + [2])) for d, t, _ in rows)
    # Pieces of one row follow each other; rows of the same id and text are told apart by their starts.
    held = {}
    for r in got:
        held.setdefault((r["doc_id"], r["text"]), []).append(r)
    found = []
    for (d, _), own in held.items():
        copies = sum(r["start"] == 0 for r in own)
        own.sort(key=lambda r: r["start"])
        ids = {}
        for r in own:
            ids.setdefault(r["start"], np.frombuffer(r["ids"], "<u4").tolist())
            assert r["length"] * 4 == len(r["ids"]) and r["doc_tokens"] >= r["start"] + r["length"]
        if copies == 1:
            assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
            found.append((d is None, d or 0, tuple(x for s in sorted(ids) for x in ids[s])))
        else:
            assert sum(r["length"] for r in own) == copies * own[0]["doc_tokens"]
            found += [w for w in want if w[:2] == (d is None, d or 0) and len(w[2]) == own[0]["doc_tokens"]][:copies]
    assert sorted(found) == want
    room = {}
    for r in got:
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in room.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *[n for _, n in sorted(own)]])[:-1].tolist()
    assert len(room) * limit - sum(r["length"] for r in got) < limit
    whole_sequences = packing.sequences(pieces, limit).collect()
    assert len(whole_sequences) == len(room)
    for s in whole_sequences:
        ids = b"".join(r["ids"] for r in sorted((r for r in got if r["sequence_id"] == s["sequence_id"]), key=lambda r: r["offset"]))
        assert s["ids"][: len(ids)] == ids and not any(s["ids"][len(ids) :])
        assert len(s["ids"]) == (len(ids) if s["tokens"].bit_count() == 1 else 4 * limit)


def test_empty_and_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, PATH).count() == 0
    docs = spark.createDataFrame([(1, None, 5, "r", 1), (2, "a b", 6, "s", 2)], "doc_id long, text string, `a.b` int, row string, PACKED int")
    out = packing.pack(docs, PATH)
    assert out.columns == ["doc_id", "a.b", "row", "PACKED", *packing.MADE]
    assert sorted((r["a.b"], r["row"], r["doc_tokens"]) for r in out.collect()) == [(5, "r", 1), (6, "s", 3)]
    assert packing.pack(docs, PATH, []).columns == list(packing.MADE)
    assert out.select(F.crc32("ids")).collect()[0][0] in (zlib.crc32(np.array([2], "<u4").tobytes()), zlib.crc32(np.array([*whole(Tokenizer.from_file(PATH), "a b"), 2], "<u4").tobytes()))
