"""Byte-level BPE, encoding and decoding, with two tiers.

A text falls into pre-tokens by a pattern. The first tier is a minimal perfect hash of the vocabulary: as many slots as entries,
each key in a slot of its own, so that one probe and one comparison of bytes tell whether a whole pre-token is an entry and
which. Only what isn't one goes to the second tier: its bytes become a linked list, and a heap gives the pair of
neighbours of the lowest rank, the leftmost of equal ones, until no pair is an entry; that takes n log n steps for n bytes.

Defined cases: null and empty texts have no tokens, and decode to no bytes; special tokens' strings are plain text; bytes that the
pattern leaves out are not encoded; repeated rows are encoded each; texts and pre-tokens of any length are taken whole;
other columns are not read. Bytes that no entry covers raise: a byte-level vocabulary has all 256.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_MASK = (1 << 64) - 1
_SPREAD = 0x9E3779B97F4A7C15


def read_ranks(path: str) -> dict[bytes, int]:
    """Entries of a rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash of the keys, by hash and displace.

    Keys fall into buckets of about four. Buckets, largest first, get the first displacement that sends their keys to free slots;
    a bucket of one key gets a free slot itself, written as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        n = max(1, len(keys))
        self.size, self.buckets = n, -(-n // 4)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(hashes)) < len(keys):
            raise ValueError("equal keys, or keys of equal hashes")
        of = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(self.buckets + 1))
        displacement = np.zeros(self.buckets, dtype=np.int64)
        taken, slots = np.zeros(n, dtype=bool), np.full(len(keys), -1, dtype=np.int64)
        sizes = np.diff(bounds)
        tries = np.arange(1, 1025, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own = order[bounds[b] : bounds[b + 1]]
            first = np.uint64(0)
            while True:
                at = self._slot(hashes[own][:, None], (first + tries)[None, :])
                inner = np.sort(at, axis=0)
                good = ~taken[at].any(axis=0) & (inner[1:] != inner[:-1]).all(axis=0)
                if good.any():
                    k = int(good.argmax())
                    displacement[b], slots[own] = int(first + tries[k]), at[:, k]
                    taken[at[:, k]] = True
                    break
                first += np.uint64(len(tries))
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(~taken)[: len(single)]
        displacement[single], slots[order[bounds[single]]] = -free - 1, free
        self.displacement = displacement.tolist()
        self.keys: list[bytes | None] = [None] * n
        self.values: list[int] = [-1] * n
        for k, (key, slot) in enumerate(zip(keys, slots.tolist(), strict=True)):
            self.keys[slot], self.values[slot] = key, k

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d * np.uint64(_SPREAD))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(self.size)).astype(np.int64)

    def place(self, key: bytes) -> int:
        """The key's place in the list that this was built from; -1 if it isn't there."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[h % self.buckets]
        if d < 0:
            slot = -d - 1
        else:
            x = (h ^ (d * _SPREAD & _MASK)) * 0xD6E8FEB86659FD93 & _MASK
            slot = (x ^ (x >> 32)) % self.size
        return self.values[slot] if self.keys[slot] == key else -1


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: neighbours of the lowest rank are joined, leftmost first, until none is an entry."""
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))  # parts as a list linked by their first bytes; n ends it
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    alive = bytearray(b"\1" * n)
    while heap:
        _, i, end = heappop(heap)
        if not alive[i]:
            continue
        middle = after[i]
        if middle >= n or after[middle] != end:
            continue  # a neighbour has grown since
        alive[middle] = 0
        after[i] = end
        if end < n:
            before[end] = i
            longer = after[end]
            if (r := ranks.get(piece[i:longer])) is not None:
                heappush(heap, (r, i, longer))
        left = before[i]
        if left >= 0 and (r := ranks.get(piece[left:end])) is not None:
            heappush(heap, (r, left, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder(dict):
    """Pre-token -> its ids as little-endian 32-bit bytes. What was looked up is kept, up to a limit; long ones aren't."""

    limit, longest = 300_000, 64

    def __init__(self, ranks: dict[bytes, int], table: PerfectHash, order: list[int], pattern: str):
        import regex

        self.ranks, self.table, self.order = ranks, table, order
        self.split = regex.compile(pattern).findall
        self.bytes_of = {i: token for token, i in ranks.items()}

    def ids(self, piece: bytes) -> list[int]:
        at = self.table.place(piece)
        return [self.order[at]] if at >= 0 else merged(piece, self.ranks)

    def __missing__(self, piece: str) -> bytes:
        value = np.array(self.ids(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = value
        return value

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode(documents: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", at_once: int = 500) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids themselves (`ids`, little-endian 32-bit) for every row.

    The vocabulary and its perfect hash, a few MB whatever the documents, are broadcast.
    """
    ranks = read_ranks(ranks_path)
    keys = list(ranks)
    sent = documents.sparkSession.sparkContext.broadcast((ranks, PerfectHash(keys), list(ranks.values())))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*sent.value, pattern)
        for whole in batches:
            for first in range(0, len(whole), at_once):
                batch = whole.slice(first, at_once)
                ids = [encoder.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
                columns = [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([sha256(encoder.decode(x)).hexdigest() for x in ids], pa.string()),
                    pa.array(ids, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(encoded, f"{_SCHEMA}, ids binary")


def query(documents: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Digests of every document's ids and of what they decode to; vocabulary: a rank file of the public tokenizers."""
    import public_tokenizers

    return encode(documents, public_tokenizers.path(vocabulary), public_tokenizers.PATTERN).drop("ids")
