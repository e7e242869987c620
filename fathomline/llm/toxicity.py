"""Toxicity: non-negative positive-unlabelled learning of a linear numpy classifier.

The texts learned from are confirmed toxic documents and unlabelled ones; no text is ever taken as a clean example. With
the class prior pi, the risk on negatives is estimated from unlabelled text less pi times the risk of positives taken as
negatives; where that estimate falls below zero the model has begun to remember single texts, and a step goes the other
way (Kiryo et al., 2017). The logistic loss under this risk makes the score an estimate of P(toxic | text). The prior is
a parameter; by default it is the share of toxic rows among the labelled ones (so that clean labels are counted, once).

The fit takes at most `max_positive` + `max_unlabelled` rows (a documented bound), chosen by a hash. Their words are counted
by Spark; the `size` words whose share differs most between the two kinds of rows are the features (ties: the smaller
word), and only the numbers of each row's features come to the driver. Scoring is one narrow pass over all documents.

Defined cases: a null or empty text scores as a text without words (the bias); repeated rows score alike; extra
columns stay, whatever they are called, and are never read; a doc_id with several labels is toxic if one of them says so;
with no confirmed toxic row every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, crc_bucket, fresh, sample

_WORD = re.compile(r"\w+")


def features(text: str | None, stem: int = 5) -> set[str]:
    """A text's words, and the stems that two or more of its different words begin with (marked by a `~`)."""
    words = set(_WORD.findall((text or "").lower()))
    once: set[str] = set()
    often: set[str] = set()
    for w in words:
        if len(w) > stem:
            (often if (s := w[:stem]) in once else once).add(s)
    words.update(s + "~" for s in often)
    return words


@dataclass
class PUModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0

    def score(self, text: str | None) -> float:
        weights = self.weights
        z = self.bias + sum(weights[f] for f in features(text) & weights.keys())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def standard_errors(p: np.ndarray, u: np.ndarray, n: int, m: int) -> np.ndarray:
    """How far the share p / n is from u / m, in standard errors."""
    pooled = (p + u) / (n + m)
    return np.abs(p / n - u / m) / np.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m) + 1e-9)


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float, float]:
    """The parts of the risk on margins of positive and unlabelled rows: on positives, and the estimate on negatives; and what is minimised."""
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return positive, negative, positive + max(0.0, negative)


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float, beta: float = 0.0, gamma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the risk with respect to the margins; of minus the estimate on negatives where that is below -beta."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    sp, su = sigmoid(zp), sigmoid(zu)
    as_positive, as_negative_p, as_negative_u = (sp - 1) * prior / len(zp), -prior * sp / len(zp), su / len(zu)
    if risk(zp, zu, prior)[1] < -beta:
        return -gamma * as_negative_p, -gamma * as_negative_u
    return as_positive + as_negative_p, as_negative_u


def minimise(positive: list[list[int]], unlabelled: list[list[int]], words: list[str], prior: float, *, steps: int = 200, rate: float = 0.1, l2: float = 2e-4, beta: float = 0.0, gamma: float = 1.0) -> PUModel:
    """Minimise pi * R_P+ + max(0, R_U- - pi * R_P-) with the logistic loss by Adam on all rows at once. Rows are numbers of words."""
    prior, d = float(np.clip(prior, 1e-3, 0.999)), len(words)
    flat = lambda rows: (np.repeat(np.arange(len(rows)), list(map(len, rows))), np.fromiter((i for r in rows for i in r), np.int64))
    (pr, pc), (ur, uc) = flat(positive), flat(unlabelled)
    w, b = np.zeros(d), np.log(prior / (1 - prior))
    first, second = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        zp = b + np.bincount(pr, w[pc], minlength=len(positive))
        zu = b + np.bincount(ur, w[uc], minlength=len(unlabelled))
        gp, gu = slopes(zp, zu, prior, beta, gamma)
        g = np.append(np.bincount(pc, gp[pr], minlength=d) + np.bincount(uc, gu[ur], minlength=d) + l2 * w, gp.sum() + gu.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return PUModel({x: float(w[i]) for i, x in enumerate(words) if abs(w[i]) > 1e-3}, float(b))


SIZE, LEAST, APART = 200, 5, 4.0  # words at most, rows that a word is in at least, standard errors at least


def fit_nnpu(positive: list[str], unlabelled: list[str], prior: float, **options) -> PUModel:
    """The fit on texts that are at hand."""
    if not positive or not unlabelled:
        return PUModel()
    sets = [[features(x) for x in texts] for texts in (positive, unlabelled)]
    p, u = (Counter(w for s in x for w in s) for x in sets)
    known = sorted(w for w in {*p, *u} if p[w] + u[w] >= LEAST)
    apart = standard_errors(np.array([p[w] for w in known], float), np.array([u[w] for w in known], float), len(positive), len(unlabelled))
    words = [known[i] for i in np.argsort(-apart, kind="stable")[:SIZE] if apart[i] >= APART]
    number = {w: i for i, w in enumerate(words)}
    rows = [[[number[w] for w in sorted(s & number.keys())] for s in x] for x in sets]
    return minimise(*rows, words, prior, **options)


def train(documents: DataFrame, labels: DataFrame, *, fold: int = 5, prior: float | None = None, max_positive: int = 2000, max_unlabelled: int = 6000, text: str = "text") -> PUModel:
    """A model from rows whose crc32(doc_id) mod `fold` isn't 0: their toxic labels, and their texts as unlabelled ones."""
    known = labels.filter(F.col("doc_id").isNotNull() & (crc_bucket("doc_id", fold) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.count(F.when(F.col("toxic") == 1, 1))).first()
    if not n or not toxic:
        return PUModel()
    texts = documents.filter(F.col("doc_id").isNotNull() & (crc_bucket("doc_id", fold) != 0)).select("doc_id", F.col(text).alias("text"))
    confirmed = sample(known.filter("toxic = 1").select("doc_id"), ["doc_id"], max_positive)
    positive = sample(texts.join(F.broadcast(confirmed), "doc_id", "left_semi"), ["doc_id", "text"], max_positive)
    unlabelled = sample(texts, ["doc_id", "text"], max_unlabelled, salt=1)

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([sorted(features(t)) for t in x], dtype=object)

    rows = positive.select("text", F.lit(True).alias("toxic")).unionByName(unlabelled.select("text", F.lit(False).alias("toxic")))
    rows = checkpoint(rows.select("toxic", split("text").alias("words")))
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return PUModel()
    n_p, n_u = float(sizes[True]), float(sizes[False])
    counts = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.when(F.col("toxic"), 1)).alias("p"), F.count(F.when(~F.col("toxic"), 1)).alias("u")).filter(F.col("p") + F.col("u") >= LEAST)
    pooled = (F.col("p") + F.col("u")) / (n_p + n_u)
    apart = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u) + 1e-9)
    words = [r.word for r in counts.filter(apart >= APART).orderBy(F.desc(F.round(apart, 9)), "word").limit(SIZE).collect()]
    known_words = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    numbered = rows.select("toxic", F.transform(F.array_intersect("words", known_words), lambda w: F.array_position(known_words, w) - 1).alias("cols")).collect()
    of = lambda toxic: sorted(list(r.cols) for r in numbered if r.toxic == toxic)
    return minimise(of(True), of(False), words, toxic / n if prior is None else prior)


def score(documents: DataFrame, model: PUModel, text: str = "text", output: str = "score") -> DataFrame:
    """documents with the model's score in `output`; one narrow pass, all columns kept."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = held.value.score
        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype="float64")

    return documents.withColumn(output, scored(F.col(text)))


def query(documents: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    model = train(documents, labels, fold=fold)
    out = score(documents.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_bucket("doc_id", fold) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """documents without those that the model rejects."""
    name = fresh(documents, "toxicity")
    return score(documents, train(documents, labels, text=text), text, name).filter(F.col(name) < 0.5).drop(name)
