"""Best-fit packing by large-item matching.

Documents become token ids (byte-level BPE, then one end token); longer ones are cut into pieces of the capacity, the
shorter piece first. The packing itself is planned on the histogram of piece lengths, at most `capacity` numbers however
many documents there are:

* Pieces above a third of the capacity fit at most twice in a sequence. They are matched greedily, each of the largest
  left with the largest that still fits beside it.
* Smaller pieces, longest first, go where they fit best: into the smallest gap that holds them.

The plan says of every length which ranks go to which sequences and offsets. Ranks are counted per length and salt
(a hash of the piece), so no length, however common, is ranked in one task.

Defined cases: null and empty texts are one piece of the end token alone; repeated rows are packed each on its own (equal
rows get places in any order); an empty table has no pieces; other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

END_OF_TEXT = "<|endoftext|>"


class CachedEncoder:
    """Ids of texts as little-endian 32-bit bytes.

    The same ids as the vocabulary's tokenizers file gives without added special tokens; the special token's own
    string in a text becomes its id. A piece between single spaces is encoded once and remembered: byte-level BPE
    splits a text before each space that no other white space touches, so ids of the parts join to ids of the whole.
    """

    limit = 200_000
    _touching = re.compile(r" \s")

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode(text, allowed_special="all"), dtype="<u4").tobytes()

    def _after_space(self, part: str) -> bytes:
        if len(self.known) >= self.limit:
            self.known.clear()
        ids = self.known[part] = np.array(self.encoding.encode_ordinary(" " + part), dtype="<u4").tobytes()
        return ids

    def __call__(self, text: str) -> bytes:
        if END_OF_TEXT in text or self._touching.search(text):
            return self.whole(text)
        head, *parts = text.split(" ")
        known = self.known
        out = [self.whole(head)]
        for part in parts:
            out.append(known.get(part) or self._after_space(part))
        return b"".join(out)


def pieces(documents: DataFrame, ranks_path: str, pattern: str, *, capacity: int = 2048, end_id: int = 0, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a row for each piece."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = CachedEncoder(ranks_path, pattern)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (encode(x) if x else b"") + end
                n = len(ids) // 4
                start, k = 0, 0
                while start < n:
                    stop = min(n, start + ((n - start) % capacity or capacity))
                    out.append((doc_id, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, k = stop, k + 1
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """For each length, runs of ranks and where they go: `count` ranks from `rank` on fill, `each` in turn, the sequences from `first` on at `offset`."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {}
        self.sequences = 0

    def put(self, length: int, rank: int, first: int, each: int, offset: int) -> None:
        self.runs.setdefault(length, []).append((rank, first, each, offset))


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Places for histogram[length] pieces of each length."""
    made, used = Plan(), dict.fromkeys(histogram, 0)
    left = {n: c for n, c in histogram.items() if c}
    #: Sequences alike, by gap: (first sequence, how many). A gap is the room at the end.
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((first, count))

    def place(length: int, first: int, count: int, each: int, gap: int) -> None:
        """`each` pieces into each of `count` sequences that have this gap."""
        made.put(length, used[length], first, each, capacity - gap)
        used[length] += count * each
        left[length] -= count * each

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        k = bisect_left(large, capacity - n + 1) - 1
        while k >= 0 and not left[large[k]]:
            del large[k]
            k -= 1
        partner = large[k] if k >= 0 else None
        count = left[n] if partner is None else left[n] // 2 if partner == n else min(left[n], left[partner])
        if partner == n and not count:  # a single one of its length: with the next smaller one
            k -= 1
            while k >= 0 and not left[large[k]]:
                del large[k]
                k -= 1
            partner, count = (large[k] if k >= 0 else None), 1
        first = made.sequences
        made.sequences += count
        place(n, first, count, 1, capacity)
        if partner is not None:
            place(partner, first, count, 1, capacity - n)
        leave(capacity - n - (partner or 0), first, count)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect_left(open_gaps, n)
            if k == len(open_gaps):
                count = -(-left[n] // (capacity // n))
                leave(capacity, made.sequences, count)
                made.sequences += count
                continue
            gap = open_gaps[k]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], open_gaps[k]
            each = gap // n
            full = min(count, left[n] // each)
            if full:
                place(n, first, full, each, gap)
                leave(gap - each * n, first, full)
            if full < count:
                rest = left[n]  # fewer than one sequence takes
                if rest:
                    place(n, first + full, 1, rest, gap)
                    leave(gap - rest * n, first + full, 1)
                    full += 1
                leave(gap, first + full, count - full)
    return made


def pack(cut: DataFrame, *, capacity: int = 2048, per_salt: int = 50_000) -> DataFrame:
    """cut (pieces()) with sequence_id and offset."""
    held = checkpoint(cut)
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    made = plan(counts, capacity)
    salts = max(1, -(-max(counts.values(), default=1) // per_salt))
    salted = held.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(own) - 1).join(sizes, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    runs = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for n, r in made.runs.items()}
    sent = held.sparkSession.sparkContext.broadcast(runs)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for length, rank in batches:
            out = np.empty((len(length), 2), dtype=np.int64)
            lengths, ranks = length.to_numpy(np.int64), rank.to_numpy(np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                rank0, first, each, offset = sent.value[int(n)]
                k = np.searchsorted(rank0, ranks[at], side="right") - 1
                within = ranks[at] - rank0[k]
                out[at, 0] = first[k] + within // each[k]
                out[at, 1] = offset[k] + (within % each[k]) * n
            yield pd.DataFrame(out, columns=["sequence_id", "offset"])

    result = ranked.withColumn("_p", placed("length", "_rank"))
    return result.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_p.sequence_id").alias("sequence_id"), F.col("_p.offset").alias("offset"))


def query(documents: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """All documents packed; vocabulary: a file of the public tokenizers, the ranks of byte_bpe_50k.json."""
    import public_tokenizers

    return pack(pieces(documents, public_tokenizers.path(vocabulary), public_tokenizers.PATTERN))
