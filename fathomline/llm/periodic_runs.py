"""Periodic runs of words by an online, sparse diagonal dynamic program.

A run of period q is a diagonal: word i equals word i - q for m words on end, and the run has q + m words. The program goes
through a text word by word. A word's earlier occurrences put lags into the set of active ones, each active lag's match
grows by one with every equal word, and a lag whose match ends with sufficient length gives its run at once.

What keeps it sparse: a lag q matters only if at least max(q, SHORTEST - q) words match, so an occurrence counts together with
the words before it: as 6 words for lags up to 11, as g = 12, 24, 48, ... words for lags from g to 2g - 1. Of the places of
equal g-word stretches, those closer than g / 2 lie in one region of a smaller period, a block. A block is linked with the
(at most three) blocks before it that are in reach, only through the ends of both; a text of one word a million times over costs
a pass.

Why the ends are enough. Let a run of smallest period q link a place of block C with one of an earlier block R, both regions
of period p. R ends inside the run, for else R and C were one. If C ends inside the run, it ends q after R's end, so the last
places of both are linked; if R begins inside the run, the first places are. Otherwise R and C each cover a half of the run,
so they touch, and the run ends with C or q after R's end: there R's last place is linked to C's last, or to any of C.
A lag inside one block is a multiple of p; its diagonal spans the run of period p again.

Defined cases: null and empty texts, and texts of blanks alone, have no words and no runs; repeated rows give equal rows; a null
doc_id counts as the empty text where the id decides; texts of any length are taken whole; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a run at least; also two periods.
SHORTEST = 12
#: The shortest stretch that is looked up: of any run, SHORTEST - q or q words match, hence six or more.
_STRETCH = SHORTEST // 2

_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class WordNumbers(dict):
    """word -> number, in order of appearance."""

    limit = 500_000

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal keys, and how often each number occurs."""
    _, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return number, counts


def _stretches(x: np.ndarray) -> np.ndarray:
    """Numbers of the six-word stretches that begin at each word; equal for equal words, exact."""
    two = _numbered(x[:-1] * (x.max() + 1) + x[1:])[0]
    four = _numbered(two[:-2] * (two.max() + 1) + two[2:])[0]
    return _numbered(four[:-2] * (two.max() + 1) + two[4:])[0]


def _links_at(x: np.ndarray, g: int, at: np.ndarray, of: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(last word, lag) of the links that stretches of g words give. at: where repeated stretches begin, ascending; of: their numbers."""
    order = np.argsort(of, kind="stable")
    at, of = at[order], of[order]
    same, gap = of[1:] == of[:-1], np.diff(at)
    begins = np.concatenate(([True], ~same | (gap > g // 2)))
    block = np.cumsum(begins) - 1
    firsts = np.flatnonzero(begins)
    lasts = np.append(firsts[1:], len(at)) - 1
    first, last, which = at[firsts], at[lasts], of[firsts]
    many = lasts > firsts
    period = np.where(many, at[np.minimum(firsts + 1, len(at) - 1)] - first, 0)
    low, high = (1, 2 * g - 1) if g == _STRETCH else (g, 2 * g - 1)
    out = []
    if g == _STRETCH:
        inside = np.flatnonzero(~begins)
        out.append((at[inside] + g - 1, gap[inside - 1]))
    # Of a block with more members than one: the first stretch of its region, and the last.
    p, several, end = period[block], many[block], at + g
    edge = np.append(x, -1)  # no word follows the last one, none stands before the first
    opens = ~several | ((at == first[block]) & ((at == 0) | (x[at - 1] != x[np.minimum(at - 1 + p, len(x) - 1)])))
    closes = ~several | ((at == last[block]) & (edge[end] != x[end - np.maximum(p, 1)]))
    for back in (1, 2, 3):
        has = np.flatnonzero(block >= back)
        has = has[which[block[has] - back] == of[has]]
        before = block[has] - back
        touching = several[has] & _touch(x, last[before] + g, first[block[has]], p[has])
        for ends, allowed in ((last, closes[has] | touching), (first, opens[has])):
            lag = at[has] - ends[before]
            fits = (lag >= low) & (lag <= high) & allowed
            out.append((end[has][fits] - 1, lag[fits]))
    return out


def _touch(x: np.ndarray, end: np.ndarray, begin: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Where the region of period p before `end` ends there and the one from `begin` on reaches back to it."""
    gap = begin - end
    near = (gap < p) & (x[np.minimum(end, len(x) - 1)] != x[end - np.maximum(p, 1)])
    for k in np.flatnonzero(near & (gap > 0)):
        if (x[end[k] : begin[k]] != x[end[k] + p[k] : begin[k] + p[k]]).any():
            near[k] = False
    return near


def links(x: np.ndarray) -> list[tuple[int, int]]:
    """(word, lag), by word: at this word an earlier stretch of words, `lag` words before, is seen again and can become a run."""
    n = len(x)
    if n < SHORTEST:
        return []
    found: list[tuple[np.ndarray, np.ndarray]] = []
    g, number = _STRETCH, _stretches(x)
    at = np.flatnonzero(np.bincount(number)[number] > 1)
    of = np.full(n, -1, dtype=np.int64)
    of[at] = number[at]
    while len(at):
        found += _links_at(x, g, at, of[at])
        if 4 * g > n:  # lags from 2g on need 4g words
            break
        at = at[at + 2 * g <= n]
        at = at[of[at + g] >= 0]
        if not len(at):
            break
        number, counts = _numbered(of[at] * (of.max() + 1) + of[at + g])
        again = counts[number] > 1
        at, g = at[again], 2 * g
        of = np.full(n, -1, dtype=np.int64)
        of[at] = number[again]
    if not found:
        return []
    word, lag = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((word, lag))
    word, lag = word[order], lag[order]
    # A link right after one of the same lag finds that lag active.
    new = np.concatenate(([True], (lag[1:] != lag[:-1]) | (word[1:] > word[:-1] + 1)))[: len(word)]
    word, lag = word[new], lag[new]
    order = np.argsort(word, kind="stable")
    return list(zip(word[order].tolist(), lag[order].tolist(), strict=True))


def runs(x: list, linked: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period. x: numbers of words; linked: links()."""
    n, k = len(x), 0
    active: dict[int, int] = {}  # lag -> the first word of its match
    found: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
    i = 0
    while active or k < len(linked):
        if not active:
            i = linked[k][0]
        ended = list(active) if i == n else [q for q in active if x[i] != x[i - q]]
        for q in ended:
            first = active.pop(q)
            if i - first >= max(q, SHORTEST - q):
                span = (first - q, i)
                found[span] = min(q, found.get(span, q))
        while k < len(linked) and linked[k][0] == i:
            q = linked[k][1]
            k += 1
            if q not in active:
                first = i  # the words before that match already
                while first > q and x[first - 1] == x[first - 1 - q]:
                    first -= 1
                active[q] = first
        i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def folded(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """words, of which every tenth document (by a checksum of its id) repeats a stretch to its end."""
    h, n = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that a run repeats: what it has after its first period."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _suspects(x: np.ndarray, lengths: np.ndarray) -> list[int]:
    """Texts (x: all their words' numbers) in which a stretch of six words seems to occur again; none that has one is left out."""
    if len(x) < _STRETCH:
        return []
    text = np.repeat(np.arange(len(lengths)), lengths)
    mixed = x.astype(np.uint64)
    h = np.zeros(len(x) - _STRETCH + 1, dtype=np.uint64)
    for k in range(_STRETCH):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mixed[k : k + len(h)]
    h = h * np.uint64(0x9E3779B97F4A7C15) + text[: len(h)].astype(np.uint64)
    whole = text[: len(h)] == text[_STRETCH - 1 :]
    h, text = h[whole], text[: len(whole)][whole]
    order = np.sort(h)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return []
    place = np.minimum(np.searchsorted(again, h), len(again) - 1)
    return np.unique(text[again[place] == h]).tolist()


def _rows(ids: list, texts: list, numbers: WordNumbers) -> list[tuple]:
    if len(numbers) > numbers.limit:
        numbers.clear()
    split = [folded(t.split(), i) if t else [] for i, t in zip(ids, texts, strict=True)]  # bytes split at the six ASCII blanks alone
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    x = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
    starts = np.cumsum(lengths) - lengths
    of_text: dict[int, list[tuple[int, int, int]]] = {}
    for k in _suspects(x, lengths):
        own = x[starts[k] : starts[k] + lengths[k]]
        if linked := links(own):
            of_text[k] = runs(own.tolist(), linked)
    out = []
    for k, (doc_id, words) in enumerate(zip(ids, split, strict=True)):
        found = of_text.get(k, ())
        start, length, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        exponent = 1000 * length // q if found else None
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
        kept = collapsed(words, found) if found else words
        out.append((doc_id, len(found), start, length, q, exponent, sha256(listed).hexdigest(), sha256(b" ".join(kept)).hexdigest()))
    return out


def find(documents: DataFrame, text: str = "text", at_once: int = 1 << 22) -> DataFrame:
    """A row for each document: its number of runs, the longest one, and digests of all runs and of the collapsed text.

    at_once: bytes of text that are numbered and searched together, or one text if it is longer.
    """

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            first = size = 0
            for k, t in enumerate([*texts, None]):
                if k == len(texts) or size > at_once:
                    rows = _rows(ids[first:k], texts[first:k], numbers)
                    columns = list(zip(*rows, strict=True)) or [[]] * 8
                    kinds = [pa.int64()] * 6 + [pa.string()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _SCHEMA.split(", ")])
                    first, size = k, 0
                size += len(t or b"")

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(searched, _SCHEMA)


def query(documents: DataFrame) -> DataFrame:
    return find(documents)
