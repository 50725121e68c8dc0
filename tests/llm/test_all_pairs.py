"""Lines and blocks of op2 against a version that compares all pairs: spans, clusters and keepers."""

import random

import pytest
from test_jaccard import groups

from millrace.llm import substrings


def paragraphs(text):
    """{words: (start, end)} of lines, and of blocks of several lines, of two words or more, each where it first stands."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    lines = [[w for w in line.replace("\t", " ").split(" ") if w] for line in text.split("\n")]
    found, at, block = [], 0, []
    for line in [*lines, []]:
        if line:
            found.append((at, at + len(line), line))
            block.append((at, line))
        else:
            if len(block) > 1:
                own = [w for _, x in block for w in x]
                found.append((block[0][0], block[0][0] + len(own), own))
            block = []
        at += len(line)
    out = {}
    for a, b, own in sorted(found, key=lambda f: (f[0], f[1])):
        if len(own) > 1:
            out.setdefault(tuple(own), (a, b))
    return out


def shingles(own):
    return {own[i : i + 5] for i in range(len(own) - 4)} or {own}


def all_pairs(rows):
    """{(doc_id, start, end): (keeper, its cluster's members)} of rows (doc_id, text)."""
    units = {}
    for i, text in rows:
        for own, span in paragraphs(text).items():
            units.setdefault(own, []).append((i, *span))
    kinds = list(units)
    sets = [shingles(k) for k in kinds]
    links = [(a, b) for a in range(len(kinds)) for b in range(a) if min(len(kinds[a]), len(kinds[b])) >= 5 and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    tops, members = groups(range(len(kinds)), links), {}
    for k, top in tops.items():
        members.setdefault(top, set()).update(units[kinds[k]])
    return {m: (min(own)[0], frozenset(own)) for own in members.values() for m in own if len({i for i, _, _ in own}) > 1}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_short_documents_by_all_pairs(spark, seed):
    """Documents of under 27 words, which have lines and blocks alone, with copies of lines and near copies of them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    pool = [[word() for _ in range(rng.choice([2, 3, 5, 9, 12, 20]))] for _ in range(40)]
    rows = []
    for i in range(160):
        lines, left = [], 26
        while left > 1 and len(lines) < 4:
            line = list(rng.choice(pool)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(1, 8))]
            if len(line) >= 12 and rng.random() < 0.5:
                line[rng.choice([0, -1])] = word()
            if len(line) > left:
                break
            left -= len(line)
            lines.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in line))
            if rng.random() < 0.3:
                lines.append(rng.choice(["", " \t"]))
        rows.append((i, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "one"), (503, "one")]
    found = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = all_pairs(rows)
    assert len(found) == len(want) > 150
    members = {}
    for r in found:
        members.setdefault(r["cluster"], set()).add((r["doc_id"], r["start"], r["end"]))
    got = {(r["doc_id"], r["start"], r["end"]): (r["keeper"], frozenset(members[r["cluster"]])) for r in found}
    assert got == want
    assert all(r["removed"] == (r["doc_id"] != r["keeper"]) for r in found)
    assert max(len(m) for _, m in want.values()) > 10 and any(len({e - s for _, s, e in m}) > 1 for _, m in want.values())
