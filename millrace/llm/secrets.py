"""Secret scan: fixed patterns, and windows of high Shannon entropy.

A candidate is a run of characters that keys and tokens are made of. For each
class of characters a window slides over its candidates, and the entropy of
the window follows from counts that change by one character in and one out.
Windows above the class's threshold, joined where they overlap, are spans
unless the allow-list explains them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import chosen, map_texts, restored, table, without

#: The kinds with their patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Runs are maximal, so runs of the least length are all that pass.
HEX = re.compile(rf"[0-9a-f]{{{LEAST['hex']},}}")
#: The order in which spans of the same start stand.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

#: Characters in a window, and in the window of runs that are shorter.
WINDOW, SHORT = 24, 16
#: By class: a candidate's pattern, and bits of entropy from which a window and a
#: short window are suspect. 24 characters can have 4 bits over 16 letters and 4.58
#: bits over more, 16 characters 4 bits. A sign = before a run parts it from a name;
#: after it, it is padding unless a value follows.
CLASSES = {
    "entropy_hex": (re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{16,}(?![0-9A-Za-z])"), 3.0, 2.7),
    "entropy_base64": (re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?"), 3.9, 3.4),
}
#: What a suspect stretch may be instead of a secret: words joined by a sign,
#: a version-4 identifier, a path, letters only or digits only, one case only
#: without digits, an ordered alphabet.
ALLOWED = (
    re.compile(r"[A-Za-z]+|[0-9_/+-]+"),
    re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE),
    re.compile(r"/?(?:[A-Za-z]+[0-9]{0,4}[/_-])+[A-Za-z]*[0-9]{0,4}"),
    re.compile(r".*(?:abcdefgh|ABCDEFGH|01234567|EXAMPLE|example).*"),
)
#: A run as short as any candidate; texts without one aren't looked at closer.
LONG = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORT}}}")
#: N * log2(n), for entropies from counts.
NLOGN = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and apart per kind."""
    spans = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return ordered(spans)


def ordered(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def hot_windows(run: str, threshold: float, width: int = WINDOW) -> list[tuple[int, int]]:
    """Stretches of run covered by windows whose entropy reaches threshold.

    With counts c of a window of w characters the entropy is
    log2(w) - sum(c log2 c) / w, so a step changes two terms of the sum.
    """
    counts: dict[str, int] = {}
    total, found = 0.0, []
    top = (math.log2(width) - threshold) * width
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += NLOGN[c + 1] - NLOGN[c]
        counts[ch] = c + 1
        if i >= width:
            old = run[i - width]
            c = counts[old]
            total += NLOGN[c - 1] - NLOGN[c]
            counts[old] = c - 1
        if i >= width - 1 and total <= top + 1e-9:
            start = i - width + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def entropy_spans(text: str) -> list[tuple[int, str, int]]:
    spans = []
    if LONG.search(text):
        for kind, (pattern, threshold, short) in CLASSES.items():
            for m in pattern.finditer(text):
                bare = len(m[0].rstrip("="))
                if not any(a.fullmatch(m[0], 0, bare) for a in ALLOWED):
                    for a, b in hot_windows(m[0], threshold) if bare >= WINDOW else hot_windows(m[0], short, SHORT):
                        if not any(x.fullmatch(m[0], a, min(b, bare)) for x in ALLOWED):
                            spans.append((m.start() + a, kind, m.start() + b))
    return spans


def uncovered(spans: list[tuple[int, str, int]], base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The spans that lie in no span of base, which is sorted: the farthest end of those
    that begin no later tells."""
    starts, reach = [b[0] for b in base], [0, *accumulate((b[2] for b in base), max)]
    return [s for s in spans if reach[bisect_right(starts, s[0])] < s[2]]


def find_secrets(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """docs (or its columns carry) with base and spans: arrays of (kind, start,
    end) in code points, end exclusive, by start and then kind.

    spans has base and what the entropy windows add; a stretch that a base span
    covers isn't added. Whole texts are searched, however long; a null or empty text
    has no spans. Columns of docs named base or spans are replaced; each row, also a
    repeated one, gives one row, and an empty table none.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c in without(docs, "base", "spans")]

    def work(_: pa.RecordBatch, texts: list[str]) -> list:
        base, every = [], []
        for text in texts:
            own = base_spans(text)
            more = uncovered(entropy_spans(text), own)
            base.append([{"kind": k, "start": a, "end": b} for a, k, b in own])
            every.append([{"kind": k, "start": a, "end": b} for a, k, b in ordered(own + more)])
        return [base, every]

    kind = "array<struct<kind:string,start:long,end:long>>"
    found = map_texts(chosen(docs, carry, text="text"), work, [("base", kind), ("spans", kind)], ["row"] if carry else [])
    return restored(found, carry, "base", "spans")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in LEAST]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_entropy")
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), added)


def op3_base(spark, sf_dir: str) -> DataFrame:
    """The fixed patterns' part of op3_secrets, which SQL can express."""
    return op3_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


#: Spans from what stands between matches: a match starts where the lengths before it end.
SQL_BASE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), kinds AS (
  SELECT * FROM (VALUES
    (1, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
    (2, 'access', '(AKIA[A-Z0-9]+)', 20),
    (3, 'hex', '([0-9a-f]+)', 24)) k(o, kind, pattern, least)
), parts AS (
  SELECT r, o, kind, least, regexp_extract_all(text, pattern) AS whole, regexp_extract_all(text, pattern, 1) AS value, string_split_regex(text, pattern) AS rest FROM d, kinds WHERE regexp_matches(text, pattern)
), matches AS (
  SELECT r, o, kind, least, unnest(whole) AS whole, unnest(value) AS value, unnest(rest[1:len(whole)]) AS rest, unnest(range(len(whole))) AS i FROM parts
), ends AS (
  SELECT *, CAST(sum(length(whole) + length(rest)) OVER (PARTITION BY r, o ORDER BY i) AS BIGINT) AS stop FROM matches
), spans AS (
  SELECT r, o, kind, stop - length(whole) AS start, stop FROM ends WHERE length(value) >= least
), per AS (
  SELECT r, count(*) FILTER (o = 1) AS a, count(*) FILTER (o = 2) AS c, count(*) FILTER (o = 3) AS h, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS told FROM spans GROUP BY r
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(told, '')) AS base_sha256 FROM d LEFT JOIN per USING (r)
"""
