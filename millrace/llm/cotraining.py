"""Quality classifier by co-training of two views.

One view is a document's text, the other what its page says of it: source,
language and length. Each has a logistic regression over binary features. In
rounds, each view labels those of all unlabelled documents of which it is most
confident by its calibrated score and that it hasn't labelled yet, and the other
view learns from them. The calibrated views are then combined, and all documents
are scored.

The models are fitted on the driver, on samples of labelled and pseudo-labelled
documents of fixed size; all else is done where the documents are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import Scratch, chosen, map_texts, restored, table, without, word_count
from millrace.llm.decontamination import words as letters

#: Bounds of a fit: labelled documents, and pseudo-labelled ones of all that the
#: other view has handed over, both taken by a hash of their ids.
LABELLED, POOL = 8000, 8000
#: Of those, as many as have this many features (of labelled ones: words) together.
FEATURES = 10_000_000
#: Log odds beyond which documents count as equally sure, cells of one, and cells of a cell.
TOP_ODDS, COARSE, FINE = 40, 64, 1 << 14
#: Rounds, and the share of the documents that a view finds good, and of those that it
#: finds bad, that it labels for the other in a round, the most confident first.
#: Documents as confident as the last of them are labelled too.
ROUNDS, SHARE = 3, 0.1
#: What a view must know to hand over at all: the log odds of a class by which a
#: document's differ from all labelled ones'. A view that knows nothing gives everything
#: the same odds, and hands over nothing.
MARGIN = 1.0
#: The share of good documents of the holdout that the cutoff may cost.
MOST_LOST = 0.005
#: Places of word features, then those of the ratios' steps.
WORDS = 1 << 20
STEPS = 24
SIZE = {"text": WORDS + 10 * (STEPS + 1), "page": 1 << 14}


def step(ratio: float) -> int:
    """0 for 0, then ever finer towards it: a ratio's place among STEPS."""
    return 0 if ratio <= 0 else min(STEPS, max(1, STEPS + int(2 * math.log2(min(1.0, ratio)))))


def text_features(text: str) -> np.ndarray:
    """The features of a text: its distinct words, and steps of some ratios."""
    own = letters(text)
    kinds = set(own)
    n, chars = max(1, len(own)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, text))
    ratios = (
        len(own) / 4096,
        sum(map(text.count, "#*$%&<>")) / chars,
        text.count("|") / chars,
        text.count("!") / chars,
        upper / chars,
        sum(map(text.count, "0123456789")) / chars,
        1 - len(kinds) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(map(len, own)) / n / 32,
        len(lines) / n,
    )
    steps = [WORDS + k * (STEPS + 1) + step(r) for k, r in enumerate(ratios)]
    return np.unique(np.array([xxhash.xxh3_64_intdigest(w) % WORDS for w in kinds] + steps, np.int32))


def page_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    size = -1 if n_chars is None or n_chars < 0 else int(n_chars).bit_length()
    facts = (f"source {source}", f"lang {lang}", f"size {size}", f"source {source} lang {lang}")
    return np.unique(np.array([xxhash.xxh3_64_intdigest(f.encode()) % SIZE["page"] for f in facts], np.int32))


@dataclass
class Linear:
    """A logistic regression, and the line that calibrates its score."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([float(self.weights[r].sum()) + self.bias for r in rows])

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.slope * self.raw(rows) + self.shift


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[np.ndarray], good: np.ndarray, size: int, steps: int = 400, penalty: float = 1e-3, least: int = 5) -> Linear:
    """Accelerated proximal steps on the log loss with an L1 penalty, which
    leaves the few features that tell. Features of fewer than least rows stay out."""
    used, columns, counts = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    often = counts >= least
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[often[columns]]
    columns = (np.cumsum(often) - 1)[columns[often[columns]]]
    used, n = used[often], len(rows)
    # The step follows from the largest eigenvalue of the features' products.
    top, z = 1.0, np.full(len(used), len(used) ** -0.5) if len(used) else np.zeros(0)
    for _ in range(10):
        z = np.bincount(columns, np.bincount(of, z[columns], n)[of], len(used))
        top = max(1e-9, float(np.linalg.norm(z)))
        z = z / top
    rate = 1 / (0.25 * top / n + 0.25)
    share = float(np.clip(good.mean(), 1e-3, 1 - 1e-3))
    w, b, t = np.zeros(len(used)), math.log(share / (1 - share)), 1.0
    x, xb = w, b
    for _ in range(steps):
        error = (sigmoid(np.bincount(of, x[columns], n) + xb) - good) / n
        new, new_b = x - rate * np.bincount(columns, error[of], len(used)), xb - rate * error.sum()
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        x, xb = new + (last - 1) / t * (new - w), new_b + (last - 1) / t * (new_b - b)
        w, b = new, new_b
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return Linear(weights, float(b))


def line(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression of good on x's columns and 1, by
    Newton steps with a small penalty."""
    a = np.column_stack([x, np.ones(len(good))])
    c = np.zeros(a.shape[1])
    for _ in range(25):
        p = sigmoid(a @ c)
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(c))
        c = c + np.linalg.solve(hess, a.T @ (good - p) - 1e-2 * c)
    return c


def calibrate(model: Linear, rows: list[np.ndarray], good: np.ndarray) -> Linear:
    slope, shift = line(model.raw(rows), good)
    model.slope, model.shift = max(0.0, float(slope)), float(shift)
    return model


@dataclass
class Judge:
    views: dict[str, Linear]
    mix: np.ndarray
    cutoff: float
    #: How many documents each view had handed over after each round.
    handed: dict[str, list[int]] = field(default_factory=lambda: {v: [] for v in SIZE})

    def scores(self, text: list[np.ndarray], page: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        logits = [self.views["text"].logits(text), self.views["page"].logits(page)]
        return sigmoid(logits[0]), sigmoid(logits[1]), sigmoid(np.column_stack([*logits, np.ones(len(text))]) @ self.mix)


def handing(features: DataFrame, known: DataFrame, rounds: list[tuple[dict[str, Linear], dict | None]]) -> DataFrame:
    """(doc_id, and for each view p and given) of the unlabelled documents: the
    last models' chances, and the pseudo-labels of the rounds before. These follow
    from the rounds' models and limits, so no state is joined to documents."""
    shared = features.sparkSession.sparkContext.broadcast(rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            given = {v: np.full(batch.num_rows, np.nan) for v in SIZE}
            for models, limits in shared.value:
                p = {}
                for i, v in enumerate(SIZE, 1):
                    column = batch.column(i)
                    offsets = column.offsets.to_numpy()
                    values = column.values.to_numpy()[: offsets[-1]]
                    p[v] = sigmoid(models[v].slope * (np.add.reduceat(models[v].weights[values].astype(float), offsets[:-1]) + models[v].bias) + models[v].shift)
                    if limits is not None:
                        now = np.isnan(given[v]) & (np.maximum(p[v], 1 - p[v]) >= np.where(p[v] > 0.5, limits[v][1], limits[v][0]))
                        given[v][now] = p[v][now] > 0.5
            made = [x for v in SIZE for x in (pa.array(p[v]), pa.array(given[v], from_pandas=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", *[f"{v}_{x}" for v in SIZE for x in ("p", "given")]])

    kind = features.schema["doc_id"].dataType.simpleString()
    found = features.select("doc_id", *[f"{v}_features" for v in SIZE]).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{v}_p double, {v}_given double" for v in SIZE))
    return found.join(known, "doc_id", "left_anti")


def floors(share: float) -> tuple[float, float]:
    """The least confidence of bad and of good, where share of the labelled are good."""
    odds = math.log(share / (1 - share))
    return max(0.5, 1 / (1 + math.exp(odds - MARGIN))), max(0.5, 1 / (1 + math.exp(-odds - MARGIN)))


def limits_of(scores: DataFrame, share: float) -> dict[str, list[float]]:
    """For each view the confidence from which it hands over bad and good documents: that
    of which 1 - SHARE of those it finds so have less. The log odds of confidences are counted
    in coarse cells and then, in the cell of each limit, in fine ones; counts don't depend on
    the order of rows, so reruns agree."""
    least = floors(share)

    def coded(v: str) -> DataFrame:
        p = F.col(f"{v}_p")
        sure = F.greatest(p, 1 - p)
        odds = F.least(F.coalesce(F.log(F.try_divide(sure, 1 - sure)), F.lit(float(TOP_ODDS))), F.lit(float(TOP_ODDS)))
        return scores.where(F.col(f"{v}_given").isNull()).select(F.lit(v).alias("view"), (p > 0.5).cast("int").alias("good"), F.floor(odds * COARSE * FINE).alias("code"))

    codes = coded("text").unionAll(coded("page"))
    found: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in codes.groupBy("view", "good", F.floor(F.col("code") / FINE).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect():
        found.setdefault((r["view"], r["good"]), []).append((r["cell"], r["n"]))
    want, at = {}, {}
    for k, cells in found.items():
        left = math.ceil(round((1 - SHARE) * sum(n for _, n in cells), 6))
        for cell, n in sorted(cells):
            if left <= n:
                want[k], at[k] = left, cell
                break
            left -= n
    out = {v: [max(least[good], 1.0) for good in (0, 1)] for v in SIZE}
    if at:
        inside = reduce(lambda x, y: x | y, [(F.col("view") == v) & (F.col("good") == g) & (F.floor(F.col("code") / FINE) == cell) for (v, g), cell in at.items()])
        fine = sorted(codes.where(inside).groupBy("view", "good", "code").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["code"])
        for v, good in at:
            for r in fine:
                if (r["view"], r["good"]) == (v, good):
                    want[v, good] -= r["n"]
                    if want[v, good] <= 0:
                        # A hair less, so that all of the cell count as confident.
                        out[v][good] = max(least[good], (1 - 1e-15) / (1 + math.exp(-r["code"] / (COARSE * FINE))))
                        break
    return out


def bounded(rows: DataFrame, order: Column, size: Column) -> DataFrame:
    """The ids of rows (doc_id and others, few) in order, as long as their sizes add up to FEATURES at most."""
    sizes = rows.groupBy("doc_id").agg(F.max(size).alias("size"))
    so_far = F.sum("size").over(Window.orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return sizes.select("doc_id", so_far.alias("so_far")).where(F.col("so_far") <= FEATURES).select("doc_id")


def fetched(rows: DataFrame, *names: str) -> list[tuple]:
    """rows, by Arrow: arrays as numpy's, others as they are."""
    got = rows.select(*names).toArrow()
    columns = []
    for name in names:
        parts = got.column(name).chunks
        columns.append([x.values.to_numpy() for part in parts for x in part] if pa.types.is_list(got.schema.field(name).type) else got.column(name).to_pylist())
    return list(zip(*columns, strict=True))


def cotrain(rows: list[tuple[np.ndarray, np.ndarray, int]], features: Callable[[], DataFrame], known: DataFrame, pool: int, scratch: Scratch, n_rounds: int = ROUNDS) -> Judge:
    """Over labelled rows (text features, page features, 1 for good, 0 for bad), and
    the features of all documents, of which those in known have labels.

    Of five labelled rows three teach, one calibrates the views and one their
    combination. Without labels of both kinds everything is good.
    """
    folds = [[r for i, r in enumerate(rows) if i % 5 in own] for own in ((0, 1, 2), (3,), (4,))]
    if any(len({r[2] for r in f}) < 2 for f in folds):
        return Judge({v: Linear(np.zeros(SIZE[v], np.float32), 0.0) for v in SIZE}, np.array([0.0, 0.0, 4.0]), 0.5)
    teach, tune, last = folds
    truth = lambda fold: np.array([r[2] for r in fold], float)
    views = {"text": 0, "page": 1}
    every = scratch.keep(features())
    given: dict[str, list] = {v: [] for v in views}
    rounds: list[tuple[dict[str, Linear], dict | None]] = []
    handed: dict[str, list[int]] = {v: [] for v in views}
    for turn in range(n_rounds + 1):
        models = {}
        for v, k in views.items():
            own = [r[k] for r in teach] + [x for x, _ in given[v]]
            models[v] = calibrate(fit(own, np.concatenate([truth(teach), np.array([g for _, g in given[v]], float)]), SIZE[v]), [r[k] for r in tune], truth(tune))
        if turn == n_rounds:
            break
        scores = scratch.keep(handing(every, known, [*rounds, (models, None)]))
        limits = limits_of(scores, float(truth(rows).mean()))
        rounds.append((models, limits))
        for v in views:
            other, p = next(o for o in views if o != v), F.col(f"{v}_p")
            now = F.when(F.greatest(p, 1 - p) >= F.when(p > 0.5, limits[v][1]).otherwise(limits[v][0]), (p > 0.5).cast("double"))
            # Of several rows of an id the worst label counts.
            labelled = scores.select("doc_id", F.coalesce(f"{v}_given", now).alias("good")).where("good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
            handed[v].append(labelled.count())
            order = F.xxhash64(F.lit("sample"), "doc_id")
            # At most pool ids and labels: a bounded broadcast.
            taken = F.broadcast(labelled.orderBy(order, "doc_id").limit(pool))
            found = every.select("doc_id", F.col(f"{other}_features").alias("x")).join(taken, "doc_id")
            found = found.join(F.broadcast(bounded(found, order, F.size("x"))), "doc_id").groupBy("doc_id").agg(F.min(F.struct("x", "good")).alias("r"))
            given[other] = fetched(found.sort(order, "doc_id").select("r.*"), "x", "good")
    mix = line(np.column_stack([models[v].logits([r[k] for r in last]) for v, k in views.items()]), truth(last))
    judge = Judge(models, mix, 0.5, handed)
    score = judge.scores([r[0] for r in last], [r[1] for r in last])[2]
    judge.cutoff = float(np.quantile(score[truth(last) == 1], MOST_LOST))
    return judge


def viewed(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """(row, doc_id, text, source, lang, n_chars) of docs; the last three null where
    docs has no such column."""
    there = {c.lower() for c in docs.columns}
    own = chosen(docs, carry, doc_id="doc_id", text="text", **{c: c for c in ("source", "lang", "n_chars") if c in there})
    lacking = {c: F.lit(None) for c in ("source", "lang", "n_chars") if c not in there}
    return own.withColumns({c: x.cast("long" if c == "n_chars" else "string") for c, x in (lacking | {c: F.col(c) for c in ("source", "lang", "n_chars") if c in there}).items()})


PAGE = ("source", "lang", "n_chars")


def described(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Columns carry of docs (as viewed) with text_features and page_features."""
    first = len(carry)

    def work(part: pa.RecordBatch, texts: list[str]) -> list:
        pages = zip(*(part.column(first + i).to_pylist() for i in range(3)), strict=True)
        return [[text_features(t) for t in texts], [page_features(*p) for p in pages]]

    fields = [("text_features", "array<int>"), ("page_features", "array<int>")]
    return map_texts(docs, work, fields, [*carry, *PAGE]).select(*carry, "text_features", "page_features")


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, scratch: Scratch | None = None, rounds: int = ROUNDS) -> Judge:
    """The judge that a bounded sample of labelled documents, by a hash of the ids,
    and all unlabelled documents make. Of several rows of an id the one with the least
    features stands for it, in whatever order they are."""
    docs = viewed(docs)
    known = chosen(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min(F.expr("cast(quality = 1 and coalesce(toxic, 0) = 0 as int)")).alias("good"))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    # At most labelled ids and flags: a bounded broadcast.
    taught = F.broadcast(known.orderBy(order, "doc_id").limit(labelled))
    taught = F.broadcast(bounded(docs.select("doc_id", "text").join(taught, "doc_id"), order, word_count(F.col("text")))).join(taught, "doc_id")
    sample = described(docs.join(F.broadcast(taught), "doc_id"), ["doc_id", "good"]).groupBy("doc_id").agg(F.min(F.struct("text_features", "page_features", "good")).alias("r"))
    rows = fetched(sample.sort(order, "doc_id").select("r.*"), "text_features", "page_features", "good")
    return cotrain(rows, lambda: described(docs.where("doc_id is not null"), ["doc_id"]), known, pool, scratch or Scratch(docs.sparkSession), rounds)


def classify(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, labelled: int = LABELLED, pool: int = POOL) -> DataFrame:
    """docs (or its columns carry) with text_score, page_score, score (chances of
    being good) and kept.

    Good is what labels call of quality 1 and not toxic; of several labels of a
    document the worst counts, and null quality is no label. Kept are documents
    from a cutoff on that costs MOST_LOST of the holdout's good ones. A null text is
    empty, a null or missing source, lang or n_chars is a fact of its own; very long
    texts are read whole. Without labels of both kinds all are kept. Columns of docs
    named like the four are replaced; repeated rows are scored alike, and an empty
    table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, labelled, pool))
    made = ["text_score", "page_score", "score", "kept"]
    carry = [c for c in (docs.columns if carry is None else carry) if c in without(docs, *made)]
    along = ["row"] if carry else []
    first = len(along)

    def work(part: pa.RecordBatch, texts: list[str]) -> list:
        pages = zip(*(part.column(first + i).to_pylist() for i in range(3)), strict=True)
        text, site, both = shared.value.scores([text_features(t) for t in texts], [page_features(*p) for p in pages])
        return [text, site, both, both >= shared.value.cutoff]

    fields = [("text_score", "double"), ("page_score", "double"), ("score", "double"), ("kept", "boolean")]
    return restored(map_texts(viewed(docs, carry), work, fields, [*along, *PAGE]), carry, *made)


def op7_cotraining(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, table(spark, sf_dir, "labels"), ["doc_id"])
