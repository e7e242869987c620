"""Language identification by a linear-chain conditional random field over words.

Each word has features: itself, whether it is in a language's lexicon (its commonest words), its affixes and its character
n-grams. With learned transitions between the labels of neighbours, forward-backward gives every word's label
probabilities; so words of a text that switches between languages are labelled one by one. A document's language is the one
with most expected words, and its share of the words is the score.

Learned in numpy on the driver from a bounded sample of labelled rows, chosen by a hash: at most `per_language` documents of
each language, and `max_rows` of all of them (fewer of each language if there are very many, but one at least). Their texts are cut
into runs of `run` words (or `letters` letters, where words are very long), of which at most `per_language_runs` of a language,
again chosen by a hash over whole texts, go to the driver. Each of these runs is learned from exactly once in a step: runs
of several languages are spliced, in shuffled order, into training sequences, so that switches are seen. The lexicon holds the
`lexicon` (100) commonest words of a language; features of fewer than `least` (3) different words are left out. Labelling is
one narrow pass over whole texts and all words.

Defined cases: text that is null or has no letter is `und` with score 0; without any labelled row everything is `und`;
ties go to the first language in order; repeated rows get equal results and count once in learning; other columns are not
read. A word is a run of letters of any length, also a whole sentence in a script without blanks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _SLOTS, crc_bucket

_RUN = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words(text: str | None) -> list[str]:
    """Runs of letters in lower case; numerals that count as word characters but aren't letters make no word."""
    if not text:
        return []
    found = _RUN.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def features(word: str, lexicons: dict[str, list[str]]) -> list[str]:
    """Itself, its lexicons, affixes of two and three letters (marked by their ends), and its trigrams."""
    out = [word, "^" + word[:2], "^" + word[:3], word[-2:] + "$", word[-3:] + "$"]
    out += [f"+{word[i : i + 3]}" for i in range(len(word) - 2)]
    return out + [f"l:{lang}" for lang in lexicons[word]] if word in lexicons else out


@dataclass
class CRF:
    langs: list[str]
    lexicons: dict[str, list[str]]
    columns: dict[str, int]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray  # from x to

    def emissions(self, words: list[str]) -> np.ndarray:
        """A row of label scores for each word."""
        get, last = self.columns.get, len(self.columns)  # the last row of weights is zero
        flat: list[int] = []
        starts = []
        for w in words:
            starts.append(len(flat))
            flat += [get(f, last) for f in features(w, self.lexicons)]
        return np.add.reduceat(self.weights[flat], starts, axis=0) if words else np.zeros((0, len(self.langs)), np.float32)


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, want_pairs: bool = False) -> tuple[np.ndarray, float, np.ndarray | None]:
    """Label probabilities of every word of sequences that lie one after another, longest first; the log partition
    functions' sum; and the expected transitions, if wanted. One step handles the t-th word of all sequences."""
    psi = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    step = np.exp(transitions)
    k = psi.shape[1]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")  # with more than t words
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    log_z = float(emissions.max(axis=1).sum())
    a = None
    for t, n in enumerate(active):
        at = starts[:n] + t
        a = psi[at] if a is None else (a[:n] @ step) * psi[at]
        scale = a.sum(axis=1, keepdims=True)
        a /= scale
        alpha[at] = a
        log_z += float(np.log(scale).sum())
    pairs = np.zeros((k, k)) if want_pairs else None
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        after = starts[:n] + t + 1
        message = psi[after] * beta[after]
        b = message @ step.T
        b /= b.sum(axis=1, keepdims=True)
        beta[starts[:n] + t] = b
        if want_pairs:
            joint = alpha[starts[:n] + t][:, :, None] * step[None] * message[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True), log_z, pairs


def splices(runs: list[tuple[str, list[str]]], langs: list[str], rng: np.random.Generator, sequence: int, stay: float) -> list[list[tuple[str, list[str]]]]:
    """All runs, each once, in sequences of `sequence` runs (the last may be shorter) that now and then switch language."""
    waiting = {lang: [ws for x, ws in runs if x == lang] for lang in langs}
    for ws in waiting.values():
        rng.shuffle(ws)
    left, out, lang = [x for x in langs if waiting[x]], [], ""
    while left:
        parts: list[tuple[str, list[str]]] = []
        while left and len(parts) < sequence:
            if not parts or lang not in left or rng.random() > stay:
                lang = left[rng.integers(len(left))]
            parts.append((lang, waiting[lang].pop()))
            if not waiting[lang]:
                left.remove(lang)
        out.append(parts)
    return out


def runs_of(text: str | None, run: int, letters: int) -> list[list[str]]:
    """The words of a text in runs of `run` words; a run ends earlier where it would have more than `letters` letters, and a longer word is cut."""
    out: list[list[str]] = [[]]
    size = 0
    for w in words(text):
        for part in (w[i : i + letters] for i in range(0, len(w), letters)):
            if out[-1] and (len(out[-1]) == run or size + len(part) > letters):
                out.append([])
                size = 0
            out[-1].append(part)
            size += len(part)
    return out if out[-1] else []


def fit(runs: list[tuple[str, list[str]]], *, lexicon: int = 100, least: int = 3, sequence: int = 4, stay: float = 0.6, steps: int = 60, rate: float = 0.15, l2: float = 1e-5, seed: int = 0) -> CRF | None:
    """runs: (language, words). Maximises the conditional likelihood of spliced sequences by Adam."""
    runs = [r for r in runs if r[1]]
    langs = sorted({lang for lang, _ in runs})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    counts: dict[str, Counter] = {lang: Counter() for lang in langs}
    for lang, ws in runs:
        counts[lang].update(ws)
    lexicons: dict[str, list[str]] = {}
    for lang in langs:
        for w, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:lexicon]:
            lexicons.setdefault(w, []).append(lang)
    # Sequences: mostly two or more runs of one language before a switch.
    spliced = splices(runs, langs, rng, sequence, stay)
    spliced.sort(key=lambda ps: -sum(len(ws) for _, ws in ps))
    flat = [(lang, w) for ps in spliced for lang, ws in ps for w in ws]
    lengths = np.array([sum(len(ws) for _, ws in ps) for ps in spliced])
    index = {lang: i for i, lang in enumerate(langs)}
    gold = np.array([index[lang] for lang, _ in flat])
    distinct = {w: i for i, w in enumerate(sorted({w for _, w in flat}))}
    word = np.array([distinct[w] for _, w in flat])
    each = [features(w, lexicons) for w in distinct]
    seen = Counter(f for fs in each for f in fs)
    columns = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= least))}
    rows = np.concatenate([np.full(len(fs), i) for i, fs in enumerate(each)])
    cols = np.array([columns.get(f, -1) for fs in each for f in fs])
    rows, cols = rows[cols >= 0], cols[cols >= 0]
    k, d, u, n = len(langs), len(columns), len(distinct), len(flat)
    last = np.cumsum(lengths) - 1
    inner = np.setdiff1d(np.arange(n), last)
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[inner], gold[inner + 1]), 1)
    weights, moves = np.zeros((d, k)), np.zeros((k, k))
    m, v = np.zeros((d + k, k)), np.zeros((d + k, k))
    target = np.zeros((n, k))
    target[np.arange(n), gold] = 1
    for t in range(1, steps + 1):
        scores = np.stack([np.bincount(rows, weights[cols, j], minlength=u) for j in range(k)], axis=1)
        p, _, pairs = forward_backward(scores[word], lengths, moves, want_pairs=True)
        of_word = np.stack([np.bincount(word, (p - target)[:, j], minlength=u) for j in range(k)], axis=1)
        g = np.stack([np.bincount(cols, of_word[rows, j], minlength=d) for j in range(k)], axis=1) / n + l2 * weights
        g = np.concatenate([g, (pairs - gold_pairs) / n])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights, moves = weights - move[:d], moves - move[d:]
    return CRF(langs, lexicons, columns, np.concatenate([weights, np.zeros((1, k))]).astype(np.float32), moves.astype(np.float32))


class Labeller:
    """Label probabilities for many texts at once; remembers words' emissions up to a limit."""

    limit, at_once = 150_000, 400_000

    def __init__(self, model: CRF):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.empty((1024, len(self.model.langs)), np.float32)

    def _emissions(self, ws: list[str]) -> np.ndarray:
        if len(self.index) > self.limit:
            self._clear()
        index = self.index
        new = list(set(ws) - index.keys())
        if new:
            while len(index) + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            first = len(index)
            index.update(zip(new, range(first, first + len(new)), strict=True))
            self.rows[first : first + len(new)] = self.model.emissions(new)
        return self.rows[np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))]

    def probabilities(self, texts: list[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
        """(place in texts, probabilities of its words) for each text that has words."""
        order = sorted((i for i, ws in enumerate(texts) if ws), key=lambda i: -len(texts[i]))
        while order:
            total, k = 0, 0
            while k < len(order) and (not k or total + len(texts[order[k]]) <= self.at_once):
                total += len(texts[order[k]])
                k += 1
            part, order = order[:k], order[k:]
            lengths = np.array([len(texts[i]) for i in part])
            p, _, _ = forward_backward(self._emissions([w for i in part for w in texts[i]]), lengths, self.model.transitions)
            yield from zip(part, np.split(p, np.cumsum(lengths)[:-1]), strict=True)


def sampled_runs(documents: DataFrame, *, fold: int = 4, held: int = 2, per_language: int = 150, max_rows: int = 3000, run: int = 12, letters: int = 2000, per_language_runs: int = 10_000) -> list[tuple[str, list[str]]]:
    """(language, words): runs of words of sampled labelled documents outside the held-out fold. At most min(n, max_rows) languages' runs, each of at most `letters` letters, are sent to the driver."""
    known = documents.filter(F.col("lang").isNotNull() & (crc_bucket("doc_id", fold) != held)).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").count()
    n = counts.count()
    if not n:
        return []
    quota = max(1, min(per_language, max_rows // n))
    # Somewhat more than the quota goes through the filter; the rest is cut off in hash order.
    slot = F.pmod(F.xxhash64("doc_id", "text", F.lit(2)), F.lit(_SLOTS))
    share = F.least(F.lit(1.0), (quota + 4 * quota**0.5) * 4 / 3 / F.col("count"))
    sizes = F.broadcast(counts) if n <= 10_000 else counts
    some = known.filter("text IS NOT NULL").join(sizes, "lang").filter(slot < share * _SLOTS).select("lang", "text", slot.alias("slot")).distinct()
    chosen = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("slot", "text"))).filter(F.col("k") <= quota)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                out += [(lang, ws) for ws in runs_of(text, run, letters)]
            yield pd.DataFrame(out, columns=["lang", "ws"])

    each = chosen.select("lang", "text").mapInPandas(cut, "lang string, ws array<string>")
    ranked = each.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("ws"), "ws")))
    return sorted((r.lang, list(r.ws)) for r in ranked.filter(F.col("k") <= per_language_runs).select("lang", "ws").collect())


def label(documents: DataFrame, model: CRF | None, text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, n_words, n_runs (runs of words with the same likeliest label)."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = sent.value
        labeller = Labeller(crf) if crf else None
        for batch in batches:
            texts = [words(x) for x in batch[text]]
            n = len(texts)
            pred, score, runs = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.zeros(n, dtype=np.int64)
            for i, p in labeller.probabilities(texts) if labeller else ():
                expected = p.sum(axis=0, dtype=np.float64)
                best = int(expected.argmax())
                pred[i], score[i] = crf.langs[best], min(1.0, expected[best] / expected.sum())
                likeliest = p.argmax(axis=1)
                runs[i] = 1 + int((likeliest[1:] != likeliest[:-1]).sum())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": pred, "score": score, "n_words": [len(ws) for ws in texts], "n_runs": runs})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInPandas(labelled, "doc_id long, lang_pred string, score double, n_words long, n_runs long")


def label_words(texts: list[str | None], model: CRF) -> list[list[tuple[str, str]]]:
    """(word, language) for each word of each text."""
    split = [words(x) for x in texts]
    out: list[list[tuple[str, str]]] = [[] for _ in texts]
    for i, p in Labeller(model).probabilities(split):
        out[i] = [(w, model.langs[j]) for w, j in zip(split[i], p.argmax(axis=1), strict=True)]
    return out


def query(documents: DataFrame, fold: int = 4, held: int = 2) -> DataFrame:
    out = label(documents, fit(sampled_runs(documents, fold=fold, held=held)))
    return out.select("doc_id", (crc_bucket("doc_id", fold) == held).alias("held_out"), "lang_pred", "score", "n_words", "n_runs")
