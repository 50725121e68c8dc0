"""Fill-in-the-middle: a document is cut at ends of lines into prefix, middle
and suffix, which are written in another order between markers.

Two offset lookups cut a text: where its units end is collected once, in an
array of eight bytes a unit. Seeds and digests are of hashlib.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import chosen, restored, table, without

#: The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit: a line with its end, or what is left behind the last.
UNIT = regex.compile(r"[^\n]*\n|[^\n]+")
#: Percent of documents that are transformed, and of those that begin with the suffix.
RATE, SUFFIX_FIRST = 100, 50

MADE = ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256")
KINDS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def ends_of(text: str) -> array:
    return array("q", (m.end() for m in UNIT.finditer(text)))


def seeds(name: str, seed: int) -> list[int]:
    """Four numbers of 32 bits, by the digest of seed and name."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def transform(text: str, name: str, seed: int, rate: int, suffix_first: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = ends_of(text)
    n = len(ends)
    h = seeds(name, seed)
    if not text or h[2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = ends[low - 1] if low else 0, ends[high - 1] if high else 0
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuild(output: str, form: str) -> str:
    """The text that transform made output of. Its parts hold no marker, and none can
    begin in a part and end in a marker, so the first of each is the one that was set."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, carry: list[str] | None = None, seed: int = 7, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs (or its columns carry) with n (units), form (plain, psm or spm), prefix_chars and
    middle_chars (code points; null if plain), output and output_sha256.

    The cuts and the form follow from seed and doc_id alone, so reruns agree and rows that
    share an id are cut by the same numbers; a null doc_id counts as the empty string. Null
    texts count as empty, and empty ones and those that contain a marker stay as they are.
    Texts are cut as a whole, however long; repeated rows are rows each. Columns of docs
    named like the new ones are replaced. Empty tables give none.
    """
    carry = without(docs, *MADE) if carry is None else carry
    source = chosen(docs, carry, doc_id="doc_id", text="text")

    @F.pandas_udf(KINDS)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, texts in batches:
            rows = [transform(t or "", d or "", seed, rate, suffix_first) for d, t in zip(names, texts, strict=True)]
            made = pd.DataFrame(rows, columns=list(MADE[:-1])).astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64", "form": object, "output": object})
            made["output_sha256"] = [hashlib.sha256(r[4].encode()).hexdigest() for r in rows]
            yield made

    made = source.select("row", cut(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("made"))
    return restored(made, carry, *[F.col("made").getField(c).alias(c) for c in MADE])


def rebuilt(output: Column, form: Column) -> Column:
    """The exact texts that fill_in_middle made outputs of."""

    @F.pandas_udf("string")
    def join(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([rebuild(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return join(output, form)


def op13_infilling(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), ["doc_id"])
    made = made.withColumn("restored_sha256", F.sha2(rebuilt(F.col("output"), F.col("form")), 256))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
    [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS h FROM d
), c AS (
  SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS low, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
