"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

Indicators of n-grams are scaled by the log-count ratio of the two classes; a linear classifier with hinge loss is fitted
to them by dual coordinate descent (Hsieh et al., 2008), in numpy. N-grams are of two kinds: one and two words of the
text, and one to three shapes of words (case, length class, what they end with, whether they repeat the word before).
Margins become probabilities by a logistic curve fitted on rows that the support vectors haven't seen.

At most `max_rows` labelled rows (a documented bound), chosen by a hash, are learned from. Spark counts their n-grams; those
in at least `least` rows, at most the `size` most frequent of them (100,000; ties: the smaller one), are the features, and
only the numbers of each row's features come to the driver. Scoring is one narrow pass.

Defined cases: null and empty texts have no n-grams and score by the bias; repeated rows score alike; a doc_id with both
labels counts as 0; with labels of one class only, or none, every score is the share of label 1 (0.5 without labels);
extra columns stay, whatever they are called, and are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, crc_bucket, sample

_MARKS = re.compile(r"\W*+")


class Shapes(dict):
    """word -> its shape: what stands before it, case and length class, what follows it."""

    limit = 200_000

    def __missing__(self, word: str) -> str:
        if len(self) >= self.limit:
            self.clear()
        first = _MARKS.match(word).end()  # two scans, each linear: a word may be a million marks
        last = len(word) - _MARKS.match(word[::-1]).end() if first < len(word) else first
        before, core, after = word[:first], word[first:last], word[last:]
        case = "-" if not core else "9" if core[0].isdigit() else "A" if core.isupper() and len(core) > 1 else "Aa" if core[0].isupper() else "a"
        shape = self[word] = f"\n{before[:3]}{case}{min(len(core) // 6, 2) if core else ''}{after[:3]}"
        return shape


def ngrams(text: str | None, shapes: Shapes) -> set:
    """The different n-grams of a text: words, pairs of words, and runs of one to three shapes (which begin with a line end)."""
    ws = text.split() if text else []
    if not ws:
        return set()
    seen = list(map(shapes.__getitem__, ws))
    if any(map(eq, ws, islice(ws, 1, None))):
        seen = [seen[0], *("\n=" if a == b else s for a, b, s in zip(ws, ws[1:], seen[1:], strict=False))]
    low = text.lower().split()
    out: set = set(low)
    out.update(zip(low, islice(low, 1, None), strict=False))
    out.update(zip(seen, islice(seen, 1, None), islice(seen, 2, None), strict=False))
    out.update(zip(seen, islice(seen, 1, None), strict=False))
    out.update((s,) for s in set(seen))
    lines = text.split("\n")
    if len(set(lines)) < len(lines):
        out.add("\n\n")
    return out


@dataclass
class NBSVM:
    weights: dict = field(default_factory=dict)
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, text: str | None, shapes: Shapes) -> float:
        weights = self.weights
        return self.bias + sum(weights[g] for g in ngrams(text, shapes) & weights.keys())

    def score(self, text: str | None, shapes: Shapes) -> float:
        z = self.slope * self.margin(text, shapes) + self.shift
        return 1 / (1 + math.exp(-min(max(z, -500), 500)))


def descend(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, *, passes: int = 30, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2/2 + sum cost * hinge, coordinate by coordinate of the dual.

    rows: the columns of each example; values: each column's value; the bias is a column of ones.
    """
    w, b, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    square = np.array([float((values[r] ** 2).sum()) + 1 for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            gradient = y[i] * (float(w[r] @ values[r]) + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if change := new - alpha[i]:
                worst = max(worst, abs(change) * square[i])
                alpha[i] = new
                w[r] += change * y[i] * values[r]
                b += change * y[i]
        if worst < 1e-3:
            break
    return w, b


def _calibrate(margins: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method; y is 0 or 1, smoothed as Platt does."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    c = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        g = x.T @ (p - t)
        c = c - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), g)
        if np.abs(g).max() < 1e-6:
            break
    return (float(c[0]), float(c[1])) if np.isfinite(c).all() and c[0] > 0 else (1.0, 0.0)


LEAST, SIZE = 3, 100_000  # rows that an n-gram is in at least, n-grams at most


def written(gram: str | tuple) -> str:
    """An n-gram as text. No word holds a blank, and only shapes begin with a line end."""
    return gram if isinstance(gram, str) else " ".join(gram)


def read(text: str) -> str | tuple:
    return text if text == "\n\n" or " " not in text and not text.startswith("\n") else tuple(text.split(" "))


def learn(rows: list[np.ndarray], y: np.ndarray, grams: list[str | tuple], *, cost: float = 0.02, folds: int = 4) -> NBSVM:
    """rows: the numbers of each row's n-grams; y: 1 or -1."""
    n0, n1 = (y == -1).sum(), (y == 1).sum()
    costs = np.where(y == 1, cost * len(y) / (2 * n1), cost * len(y) / (2 * n0))

    def of(chosen: np.ndarray) -> tuple[np.ndarray, float]:
        p, q = np.ones(len(grams)), np.ones(len(grams))
        for i in chosen:
            (p if y[i] == 1 else q)[rows[i]] += 1
        ratio = np.log((p / p.sum()) / (q / q.sum()))
        w, b = descend([rows[i] for i in chosen], ratio, y[chosen], costs[chosen])
        return w * ratio, b

    part = np.arange(len(y)) % folds
    margins = np.zeros(len(y))
    for k in range(folds):
        w, b = of(np.flatnonzero(part != k))
        for i in np.flatnonzero(part == k):
            margins[i] = w[rows[i]].sum() + b
    slope, shift = _calibrate(margins, (y == 1).astype(float))
    w, b = of(np.arange(len(y)))
    return NBSVM({g: float(w[i]) for i, g in enumerate(grams) if abs(w[i]) > 1e-4}, float(b), slope, shift)


def of_one_class(y: np.ndarray) -> NBSVM | None:
    """What is known without two classes: the share of label 1."""
    if len(y) and abs(y.sum()) < len(y):
        return None
    share = float((y == 1).mean()) if len(y) else 0.5
    return NBSVM(slope=0.0, shift=math.log((share + 1e-9) / (1 - share + 1e-9)))


def fit(texts: list[str], labels: list[int], **options) -> NBSVM:
    """The fit on texts that are at hand."""
    y = np.where(np.array(labels) == 1, 1, -1)
    if model := of_one_class(y):
        return model
    shapes = Shapes()
    found = [ngrams(x, shapes) for x in texts]
    counts = Counter(g for gs in found for g in gs)
    grams = sorted((g for g, c in counts.items() if c >= LEAST), key=lambda g: (-counts[g], written(g).encode()))[:SIZE]
    number = {g: i for i, g in enumerate(grams)}
    return learn([np.array(sorted(number[g] for g in gs & number.keys()), dtype=np.int64) for gs in found], y, grams, **options)


def train(documents: DataFrame, labels: DataFrame, *, fold: int = 5, max_rows: int = 3000, text: str = "text") -> NBSVM:
    """A model from quality labels of rows whose crc32(doc_id) mod `fold` isn't 0."""
    known = labels.filter(F.col("doc_id").isNotNull() & (crc_bucket("doc_id", fold) != 0) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = documents.select("doc_id", F.col(text).alias("text")).join(F.broadcast(sample(known, ["doc_id"], max_rows)), "doc_id")
    rows = checkpoint(sample(texts, ["doc_id", "text"], max_rows).select("doc_id", "text", F.col("quality").cast("int").alias("quality")))
    y = np.array([1 if r.quality == 1 else -1 for r in rows.select("quality").collect()])
    if model := of_one_class(y):
        return model

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shapes = Shapes()
        for x in batches:
            yield pd.Series([[written(g) for g in ngrams(t, shapes)] for t in x], dtype=object)

    counts = rows.select(F.explode(split("text")).alias("gram")).groupBy("gram").count().filter(F.col("count") >= LEAST)
    grams = [r.gram for r in counts.orderBy(F.desc("count"), "gram").limit(SIZE).collect()]
    number = documents.sparkSession.sparkContext.broadcast({read(g): i for i, g in enumerate(grams)})

    @F.pandas_udf("array<int>")
    def numbered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shapes, known = Shapes(), number.value
        for x in batches:
            yield pd.Series([sorted(known[g] for g in ngrams(t, shapes) & known.keys()) for t in x], dtype=object)

    found = sorted(((r.doc_id, r.cols, r.quality) for r in rows.select("doc_id", numbered("text").alias("cols"), "quality").collect()))
    return learn([np.array(cols, dtype=np.int64) for _, cols, _ in found], np.array([1 if q == 1 else -1 for _, _, q in found]), [read(g) for g in grams])


def score(documents: DataFrame, model: NBSVM, text: str = "text", output: str = "score") -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shapes = Shapes()
        for texts in batches:
            yield pd.Series([held.value.score(t, shapes) for t in texts], dtype="float64")

    return documents.withColumn(output, scored(F.col(text)))


def query(documents: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    out = score(documents.select("doc_id", "text"), train(documents, labels, fold=fold))
    return out.select("doc_id", (crc_bucket("doc_id", fold) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
