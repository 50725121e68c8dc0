"""Quality rules whose cutoffs are certified on labelled documents.

Fixed base rules come first. Further rules compare a ratio with a cutoff that
is chosen per stratum: the lowest whose false rejections of documents labelled
good are, by an exact binomial bound, below a limit. As every rule is tested
in every stratum, the error is shared among all these tests; along a rule's
cutoffs the tests go from the mildest on and stop at the first that fails, so
those need no further correction.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, chosen, map_texts, restored, shingle_hashes, table, without

#: What counts as a symbol.
SYMBOLS = "#*$%&|<>"
#: ASCII white space, which parts words.
BLANKS = " \t\n\v\f\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratio rules: name, and the SQL of a ratio of which high values are bad.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "word_chars / greatest(n_words, 1) / 40",
}
#: Cutoffs that a rule may get, from the mildest on: reject above it.
CUTOFFS = tuple(k / 40 for k in range(39, 0, -1))
#: Share of good documents that all rules together may falsely reject in a
#: stratum, and the probability with which that may fail in any stratum.
MOST_LOST, ERROR = 0.02, 0.05
REPEAT_WINDOW = 3


def repeat_words(words: list[bytes], width: int = REPEAT_WINDOW) -> int:
    """Words inside windows that occur twice or more, first occurrences included."""
    if len(words) <= width:
        return 0
    windows = shingle_hashes(words, width)
    order = np.argsort(windows, kind="stable")
    same = np.diff(windows[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(len(words), bool)
    repeated = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    for j in range(width):
        twice[repeated + j] = True
    return int(twice.sum())


def measure_text(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8").split()
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
    )


def measures(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Columns carry of docs with MEASURES, n_lines and base_failed."""

    def work(_: pa.RecordBatch, texts: list[str]) -> list:
        return list(zip(*map(measure_text, texts), strict=True)) or [[]] * (len(MEASURES) + 1)

    counted = map_texts(docs, work, [(m, "long") for m in (*MEASURES, "n_lines")], carry)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def loses_less(lost: int, n: int, most: float, error: float) -> bool:
    """Whether lost of n shows, with the exact binomial test, a rate below most:
    the chance of so few at that rate is at most error."""
    if n == 0:
        return False
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(most) + (n - k) * math.log1p(-most) for k in range(lost + 1)] if lost < n * most else [0.0]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs)) <= math.log(error)


def certified(measured: DataFrame, good: DataFrame, stratum: str, scratch: Scratch, most_lost: float = MOST_LOST, error: float = ERROR) -> DataFrame:
    """(stratum, one cutoff a rule; null where none is certified).

    measured has the ratios' columns, good the doc_ids of the holdout's good
    documents. Counts at each cutoff are aggregated on Spark; a task then has
    one stratum's counts: a rule's cutoffs and their lost documents.
    """
    kept = measured.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    level = [F.sum(F.expr(f"cast(({sql}) > {c} as long)")).alias(f"{rule}_{i}") for rule, sql in RULES.items() for i, c in enumerate(CUTOFFS)]
    counts = scratch.keep(kept.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *level))
    each_lost = most_lost / len(RULES)
    share = error / (len(RULES) * max(1, counts.count()))

    def choose(batches):
        for pdf in batches:
            got = []
            for row in pdf.to_dict("records"):
                cut = {}
                for rule in RULES:
                    for i, c in enumerate(CUTOFFS):
                        if not loses_less(int(row[f"{rule}_{i}"]), int(row["n"]), each_lost, share):
                            break
                        cut[rule] = c
                got.append({"stratum": row["stratum"], **{r: cut.get(r) for r in RULES}})
            yield pd.DataFrame(got, columns=["stratum", *RULES]).astype({r: float for r in RULES})

    return counts.mapInPandas(choose, "stratum string, " + ", ".join(f"{r} double" for r in RULES))


def judge(docs: DataFrame, labels: DataFrame, carry: list[str], stratum: str = "lang", most_lost: float = MOST_LOST, error: float = ERROR, scratch: Scratch | None = None) -> DataFrame:
    """Columns carry of docs with MEASURES, n_lines, base_failed and kept.

    Labels of quality 1 are the holdout, those of toxic 1 aside; null labels
    and ids are no part of it. A null stratum is one of its own. A document
    whose stratum has no certified cutoff is judged by the base rules alone.
    Null and empty texts have no words and fail. Repeated rows are judged
    alike, very long texts as a whole. Columns named like the new ones are
    replaced; an empty table gives none, and without labels only the base
    rules count.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    named = [*MEASURES, "n_lines", "base_failed", "kept"]
    carry = [c for c in carry if c in without(docs, *named)]
    source = chosen(docs, carry, doc_id="doc_id", text="text", stratum=stratum).withColumn("stratum", F.col("stratum").cast("string"))
    # Written with the carried columns, so that texts are measured once.
    measured = scratch.keep(measures(source, [*(["row"] if carry else []), "doc_id", "stratum"]))
    good = chosen(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    cutoffs = scratch.keep(certified(measured, good, "stratum", scratch, most_lost, error))
    over = F.lit(False)
    for rule, sql in RULES.items():
        over = over | F.coalesce(F.expr(f"({sql}) > cut_{rule}"), F.lit(False))
    cut = cutoffs.select(F.col("stratum").alias("of"), *[F.col(r).alias(f"cut_{r}") for r in RULES])
    joined = measured.join(cut, measured["stratum"].eqNullSafe(cut["of"]), "left")
    return restored(joined.withColumn("kept", ~F.col("base_failed") & ~over), carry, *named)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return judged.select("doc_id", *MEASURES, "base_failed", "kept")


RATIOS = " UNION ALL ".join(f"SELECT r, doc_id, stratum, base_failed, '{rule}' AS rule, {sql} AS ratio FROM measured" for rule, sql in RULES.items())

SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), again AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM windows WHERE c > 1) GROUP BY r
), measured AS (
  SELECT r, doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    len(ws) < 50 OR 100 * coalesce(again.n, 0) > 50 * len(ws) AS base_failed
  FROM w LEFT JOIN again USING (r)
), ratios AS (
  {RATIOS}
), cutoffs AS (
  SELECT unnest([{", ".join(f"{c}::DOUBLE" for c in CUTOFFS)}]) AS c
), counts AS (
  SELECT stratum, rule, c, count(*) AS n, CAST(sum(CAST(ratio > c AS INT)) AS BIGINT) AS lost FROM ratios, cutoffs
  WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL) GROUP BY stratum, rule, c
), tails AS (
  SELECT stratum, rule, c, lost, n, list_sum(list_transform(range(0, lost + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    + k * ln({MOST_LOST / len(RULES)}::DOUBLE) + (n - k) * ln(1 - {MOST_LOST / len(RULES)}::DOUBLE)))) AS tail FROM counts
), failing AS (
  SELECT stratum, rule, max(c) FILTER (lost >= n * {MOST_LOST / len(RULES)}::DOUBLE
    OR tail > {ERROR}::DOUBLE / ({len(RULES)} * (SELECT count(*) FROM (SELECT DISTINCT stratum FROM counts)))) AS c FROM tails GROUP BY stratum, rule
), cut AS (
  SELECT t.stratum, t.rule, min(t.c) AS c FROM tails t JOIN failing f ON t.stratum IS NOT DISTINCT FROM f.stratum AND t.rule = f.rule WHERE t.c > coalesce(f.c, -1) GROUP BY 1, 2
), over_cut AS (
  SELECT DISTINCT r FROM ratios JOIN cut ON ratios.stratum IS NOT DISTINCT FROM cut.stratum AND ratios.rule = cut.rule AND ratio > cut.c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND r NOT IN (SELECT r FROM over_cut) AS kept
FROM measured
"""
