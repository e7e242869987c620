"""Token counts by a linear longest-match automaton (after Song et al., 2021).

A trie of the vocabulary's byte strings gets failure links: where a word can't go on from a trie node, the link
says how many pieces greedy longest-match-first emits at once and at which node the match goes on. Following links
moves forward through the word only, so a word costs time linear in its length. Since only counts are wanted, the pieces
that a link pops are kept as a number and never built.

The vocabulary is a public byte-level one. Its pieces are taken as byte strings, without the mark that some carry for a word's
end, so every single byte is a piece and every word can be covered; with a vocabulary that lacks bytes, a word that it can't
cover counts as one unknown token.

Words of a batch run through the automaton side by side, one numpy step for each byte position; those of more than `long` bytes
go alone, byte by byte, so that one very long word costs no array step for each of its bytes. Words seen before are looked up. Defined cases: null and empty texts have no words and tokens; words of any length are followed to their end;
repeated rows count alike; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of letters and digits, or single other characters that aren't white space.
_WORD = re.compile(r"[^\W_]+|[^\w\s]|_")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def vocabulary(path: str, end_mark: str = "</w>") -> set[bytes]:
    """The vocabulary's pieces as byte strings."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    symbols = byte_symbols()
    bodies = {token.removesuffix(end_mark) for token in tokens}
    return {bytes(symbols[c] for c in body) for body in bodies if body and all(c in symbols for c in body)}


@dataclass
class Automaton:
    """Edges of the trie as sorted keys node * 256 + byte, and each node's failure link and count of popped pieces."""

    keys: np.ndarray
    targets: np.ndarray
    fail: np.ndarray  # -1: no link
    pops: np.ndarray

    @classmethod
    def build(cls, pieces: set[bytes]) -> Automaton:
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in sorted(pieces):
            node = 0
            for s in piece:
                if s not in children[node]:
                    children[node][s] = len(children)
                    children.append({})
                    final.append(False)
                node = children[node][s]
            final[node] = True
        fail, pops = [-1] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:  # breadth first: links of shorter strings are known
            u = queue.popleft()
            for s, v in children[u].items():
                if final[v]:
                    fail[v], pops[v] = 0, 1
                elif u:
                    z, n = fail[u], pops[u]
                    while z != -1 and s not in children[z]:
                        z, n = fail[z], n + pops[z]
                    if z != -1:
                        fail[v], pops[v] = children[z][s], n
                queue.append(v)
        edges = sorted((u * 256 + s, v) for u, kids in enumerate(children) for s, v in kids.items())
        keys, targets = (np.array(c, dtype=np.int64) for c in zip(*edges, strict=True)) if edges else (np.empty(0, np.int64),) * 2
        return cls(keys, targets.astype(np.int32), np.array(fail, dtype=np.int32), np.array(pops, dtype=np.int32))

    def _go(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(node), -1)
        key = node.astype(np.int64) * 256 + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], -1)

    #: Bytes of a word that goes with others.
    long = 64

    def count(self, word: bytes) -> int:
        """Pieces of one word; -1 where the vocabulary can't cover it."""
        if not hasattr(self, "_edges"):
            self._edges, self._links = dict(zip(self.keys.tolist(), self.targets.tolist(), strict=True)), (self.fail.tolist(), self.pops.tolist())
        edges, (fail, pops) = self._edges.get, self._links
        node = total = 0
        for symbol in word:
            while (to := edges(node * 256 + symbol)) is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = to
        while node > 0:
            total += pops[node]
            node = fail[node]
        return -1 if node < 0 else total

    def counts(self, ws: list[bytes]) -> np.ndarray:
        """Pieces of each word; -1 where the vocabulary can't cover it."""
        if any(len(w) > self.long for w in ws):
            out = np.array([self.count(w) if len(w) > self.long else 0 for w in ws], dtype=np.int64)
            short = [i for i, w in enumerate(ws) if len(w) <= self.long]
            out[short] = self.counts([ws[i] for i in short])
            return out
        order = sorted(range(len(ws)), key=lambda i: -len(ws[i]))
        lengths = np.array([len(ws[i]) for i in order], dtype=np.int64)
        flat = np.frombuffer(b"".join(ws[i] for i in order), np.uint8).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        node, total = np.zeros(len(ws), np.int64), np.zeros(len(ws), np.int64)
        bad = np.zeros(len(ws), bool)
        for t in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # words of more than t bytes
            live = np.flatnonzero(~bad[:n])
            symbol = flat[starts[live] + t]
            while len(live):
                to = self._go(node[live], symbol)
                done = to >= 0
                node[live[done]] = to[done]
                live, symbol = live[~done], symbol[~done]
                total[live] += self.pops[node[live]]
                node[live] = self.fail[node[live]]
                stuck = node[live] < 0
                bad[live[stuck]] = True
                live, symbol = live[~stuck], symbol[~stuck]
        # At its end a word may be inside the trie: its last pieces are popped on the way back to the root.
        live = np.flatnonzero(~bad & (node > 0))
        while len(live):
            total[live] += self.pops[node[live]]
            node[live] = self.fail[node[live]]
            bad[live[node[live] < 0]] = True
            live = live[node[live] > 0]
        out = np.empty(len(ws), np.int64)
        out[order] = np.where(bad, -1, total)
        return out


class Counts(dict):
    """word -> pieces (-1: unknown), filled in by batches, up to a limit."""

    limit = 400_000

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def learn(self, ws: set[str]) -> None:
        if len(self) > self.limit:
            self.clear()
        new = list(ws - self.keys())
        self.update(zip(new, self.automaton.counts([w.encode("utf-8", "surrogatepass") for w in new]).tolist(), strict=True))


def count(documents: DataFrame, vocabulary_path: str, text: str = "text", at_once: int = 500) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for every row."""
    sent = documents.sparkSession.sparkContext.broadcast(Automaton.build(vocabulary(vocabulary_path)))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Counts(sent.value)
        for batch in batches:
            rows = []
            for first in range(0, len(batch), at_once):
                part = batch.iloc[first : first + at_once]
                texts = [words(x) for x in part[text]]
                known.learn(set().union(*texts))
                for doc_id, ws in zip(part["doc_id"], texts, strict=True):
                    pieces = list(map(known.__getitem__, ws))
                    unknown = pieces.count(-1)
                    rows.append((doc_id, len(ws), sum(pieces) + 2 * unknown, unknown))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_tokens", "n_unknown"]).astype({"doc_id": "Int64"})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInPandas(counted, "doc_id long, n_words long, n_tokens long, n_unknown long")


def query(documents: DataFrame, file: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    return count(documents, public_tokenizers.path(file))
