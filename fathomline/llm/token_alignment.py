"""Alignment of two tokenizers' tokens, with an identity-map fast path.

Two tokenizers cut the same bytes. Where tokens of both end, the bytes fall into groups; within a group each pair of tokens
whose bytes overlap is a link. A pair of ids counts in how many documents it is linked.

Most groups are one token of each with the same bytes. A map made beforehand gives for each A id the B id of the same bytes; such
pairs are counted in vectors as long as A's vocabulary, one a task, summed by Spark. Only pairs of other groups are shuffled, as
pairs combined before the shuffle. A pair of the map that turns up inside another group goes to the vector as well, so each
pair is counted at one place.

Counts come back to documents the same way: the vectors, and the pairs with more than one in 2^16 of all (document, pair)
rows - by that rule fewer than 2^16 of them, however many documents there are - are sent to the tasks; rows of the other pairs,
none of which can be a hot key, join their counts by shuffle.

Texts are aligned whole, many at once. Both tokenizers' token ends, as byte offsets over all texts of a batch, are two sorted arrays:
where they meet a group ends, and each stretch between neighbours of their union is one link.

The A file's ids have to follow its merges, as those of byte-level vocabularies of this kind do (checked when it is read); then the
ids are ranks, and a rank-based encoder gives what the file's own gives.

Defined cases: null and empty texts, and texts whose tokens don't give back the bytes of a space and the text, have no tokens: zeros
and an empty digest; special tokens' strings are plain text; rows that share a doc_id, equal ones too, count as documents of their
own; texts and words of any length are taken whole; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder
from .token_counts import byte_symbols

#: Pairs with more than one in this many (document, pair) rows are sent to the tasks; there are fewer than this many.
HOT_SHARE = 1 << 16
_BITS = 24
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def bytes_of_a(path: str) -> list[bytes]:
    """Bytes of each entry of a byte-level tokenizers file, by id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbols, special = byte_symbols(), {t["content"] for t in spec.get("added_tokens", [])}
    entries = spec["model"]["vocab"]
    out = [b""] * (max(entries.values(), default=-1) + 1)
    for token, i in entries.items():
        out[i] = token.encode() if token in special else bytes(symbols[c] for c in token)
    return out


def bytes_of_b(path: str) -> list[bytes]:
    """Bytes of each piece of a sentencepiece model, by id: <0xHH> as that byte, U+2581 as a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        byte = _BYTE.fullmatch(piece)
        out.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
    return out


def identity_map(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each A id the smallest B id of the same bytes, -1 where there is none."""
    by: dict[bytes, int] = {}
    for i, token in enumerate(b):
        if token:
            by.setdefault(token, i)
    return np.array([by.get(token, -1) if token else -1 for token in a], dtype=np.int64)


def read_ranks(path: str) -> dict[bytes, int]:
    """Entries of a byte-level tokenizers file as ranks: each merge has to give the next id after the single bytes'."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    entries, special = spec["model"]["vocab"], {t["content"] for t in spec.get("added_tokens", [])}
    merged = [pair.split(" ") if isinstance(pair, str) else pair for pair in spec["model"]["merges"]]
    if any(entries[x + y] != 256 + k for k, (x, y) in enumerate(merged)):
        raise ValueError(f"{path}: ids don't follow the merges")
    symbols = byte_symbols()
    return {bytes(symbols[c] for c in token): i for token, i in entries.items() if token not in special}


class Aligner:
    """Both tokenizers, the bytes of their entries, and the map from A ids to B ids of the same bytes."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=read_ranks(a_path), special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = bytes_of_a(a_path), bytes_of_b(b_path)
        self.a_length, self.b_length = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_lengths = self.a_length.tolist()
        self.identity = identity_map(self.a_bytes, self.b_bytes)
        # An id and what stands behind it: A ids with a comma or a bar, then B ids with a comma or a semicolon.
        self.written = [f"{i}{end}".encode() for n, end in ((len(self.a_bytes), ","), (len(self.a_bytes), "|"), (len(self.b_bytes), ","), (len(self.b_bytes), ";")) for i in range(n)]

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a space and each text; none for texts that are empty or whose bytes a tokenizer doesn't give back."""
        a_ids: list[list[int]] = []
        b_ids: list[list[int]] = []
        for text in texts:
            a = self.a.encode_ordinary(" " + text) if text else []
            b = self.b.encode(text) if text else []
            wanted = f" {text}".encode() if text else b""
            # A's tokens are stretches of the text in order: as many bytes are the same bytes.
            exact = sum(map(self.a_lengths.__getitem__, a)) == len(wanted) and b"".join(map(self.b_bytes.__getitem__, b)) == wanted
            a_ids.append(a if exact else [])
            b_ids.append(b if exact else [])
        return a_ids, b_ids


class Alignment:
    """The alignment of many texts' tokens side by side. a_of and b_of: the text of each token; link_of, link_a, link_b: of each link."""

    def __init__(self, a_ids: list[list[int]], b_ids: list[list[int]], aligner: Aligner):
        self.n = len(a_ids)
        self.a_of, self.a = _flat(a_ids)
        self.b_of, self.b = _flat(b_ids)
        a_end, b_end = np.cumsum(aligner.a_length[self.a]), np.cumsum(aligner.b_length[self.b])
        size = int(a_end[-1]) + 1 if len(a_end) else 1
        # By byte offset: whether a token ends there, and how many have ended up to there.
        in_a, in_b = np.zeros(size, bool), np.zeros(size, bool)
        in_a[a_end], in_b[b_end] = True, True
        shared = in_a & in_b
        up_a, up_b, up_shared = (np.cumsum(x, dtype=np.int32) for x in (in_a, in_b, shared))
        self.a_last, self.b_last = shared[a_end], shared[b_end]  # where a group ends
        self.a_group, self.b_group = up_shared[a_end] - self.a_last, up_shared[b_end] - self.b_last
        groups = np.flatnonzero(shared)
        self.a_through, self.b_through = up_a[groups], up_b[groups]  # tokens through each group's end
        ends = np.flatnonzero(in_a | in_b)
        first, second = up_a[ends] - in_a[ends], up_b[ends] - in_b[ends]
        self.link_of, self.link_a, self.link_b = self.a_of[first], self.a[first], self.b[second]

    def counts(self, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, minlength=self.n)

    def digests(self, aligner: Aligner) -> list[str]:
        """sha256 of each text's groups, written as `a1,a2|b1;a3|b2`; empty for a text without tokens."""
        na, nb = len(aligner.a_bytes), len(aligner.b_bytes)
        shown = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        # Of a group first the A ids, then the B ids.
        shown[np.arange(len(self.a)) + np.append(0, self.b_through)[self.a_group]] = self.a + na * self.a_last
        shown[np.arange(len(self.b)) + self.a_through[self.b_group]] = self.b + 2 * na + nb * self.b_last
        ends = np.cumsum(self.counts(self.a_of) + self.counts(self.b_of)).tolist()
        listed, out, begin = shown.tolist(), [], 0
        for end in ends:
            out.append(sha256(b"".join(map(aligner.written.__getitem__, listed[begin:end]))[:-1]).hexdigest() if end > begin else "")
            begin = end
        return out


_FIRST = "part int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<int>, same_n array<long>, pairs array<long>, pairs_n array<long>"


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The number of the list that each element is in, and all elements."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.repeat(np.arange(len(lists)), sizes), np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))


def _counted(of: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values (of less than 48 bits) of each of n owners with how often each occurs: offsets by owner, values, counts."""
    both, counts = np.unique(of << 48 | values, return_counts=True)
    return np.searchsorted(both >> 48, np.arange(n + 1)), both & (1 << 48) - 1, counts


def _first_rows(ids: list, texts: list[str | None], aligner: Aligner, vector: np.ndarray) -> pa.RecordBatch:
    """A row for each document; `vector` counts documents by A id of the identity map's pairs."""
    n = len(ids)
    found = Alignment(*aligner.encode(texts), aligner)
    is_same = aligner.identity[found.link_a] == found.link_b
    same_at, same, same_n = _counted(found.link_of[is_same], found.link_a[is_same], n)
    other = ~is_same
    pair_at, pairs, pairs_n = _counted(found.link_of[other], found.link_a[other] << _BITS | found.link_b[other], n)
    vector += np.bincount(same, minlength=len(vector))
    lists = lambda at, values, kind: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
    whole = [pa.array(found.counts(of), pa.int64()) for of in (found.a_of, found.b_of, found.a_of[found.a_last], found.link_of)]
    columns = [
        pa.array([None] * n, pa.int32()), pa.array(ids, pa.int64()), *whole, pa.array(found.digests(aligner), pa.string()),
        lists(same_at, same.astype(np.int32), pa.int32()), lists(same_at, same_n, pa.int64()), lists(pair_at, pairs, pa.int64()), lists(pair_at, pairs_n, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _FIRST.split(", ")])


def _vector_row(vector: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(vector)
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([pa.field(c.split()[0], kinds[c.split()[1]]) for c in _FIRST.split(", ")])
    row = dict.fromkeys(schema.names) | {"part": 0, "same": at.tolist(), "same_n": vector[at].tolist()}
    return pa.RecordBatch.from_pylist([row], schema=schema)


def links(documents: DataFrame, a_path: str, b_path: str, pattern: str, *, text: str = "text", at_once: int = 1 << 20, most: int = 1 << 14) -> DataFrame:
    """A row for each document (part null) with its distinct links and how often each occurs: `same`, A ids of the identity map's
    pairs, and `pairs`, others as A id * 2^24 + B id. A task adds one row (part 0) with its vector of document counts in `same_n`.

    at_once: characters of text that are aligned together, or one text if it is longer; most: texts at once, at most.
    """
    n = len(bytes_of_a(a_path))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, vector = Aligner(a_path, b_path, pattern), np.zeros(n, dtype=np.int64)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            first = size = 0
            for k, t in enumerate([*texts, None]):
                if k == len(texts) or size > at_once or k - first == most:
                    yield _first_rows(ids[first:k], texts[first:k], aligner, vector)
                    first, size = k, 0
                size += len(t or "")
        if vector.any():
            yield _vector_row(vector)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(aligned, _FIRST)


_SECOND = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, key long, n long"


def _second_rows(batch: pa.RecordBatch, same_count: np.ndarray, best: np.ndarray, hot: np.ndarray, hot_count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents with what the vectors and hot pairs give, and a row for each other pair of theirs."""
    names = [c.split()[0] for c in _SECOND.split(", ")]
    n = len(batch)

    def lists(name: str) -> tuple[np.ndarray, np.ndarray]:
        c = batch.column(name)
        return np.repeat(np.arange(n), np.diff(c.offsets.to_numpy())), c.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    total = lambda of, values: np.bincount(of, values, n).astype(np.int64) if len(of) else np.zeros(n, np.int64)
    of, same = lists("same")
    times = lists("same_n")[1]
    n_best, count_sum = total(of, times * (same_count[same] == best[same])), total(of, times * same_count[same])
    of, key = lists("pairs")
    times = lists("pairs_n")[1]
    at = np.minimum(np.searchsorted(hot, key), max(0, len(hot) - 1))
    is_hot = hot[at] == key if len(hot) else np.zeros(len(key), bool)
    c = hot_count[at[is_hot]]
    n_best += total(of[is_hot], times[is_hot] * (c == best[key[is_hot] >> _BITS]))
    count_sum += total(of[is_hot], times[is_hot] * c)
    uid = batch.column("uid").to_numpy()
    own = [batch.column(x) for x in names[:7]]
    # Documents' own rows get keys that no pair has, all different, so that the join deals them out evenly.
    yield pa.RecordBatch.from_arrays([*own, pa.array(n_best), pa.array(count_sum), pa.array(-1 - uid), pa.array(np.zeros(n, np.int64))], names=names)
    cold = np.flatnonzero(~is_hot)
    if len(cold):
        nulls = [pa.nulls(len(cold), k) for k in [*[pa.int64()] * 5, pa.string(), *[pa.int64()] * 2]]
        yield pa.RecordBatch.from_arrays([pa.array(uid[of[cold]]), *nulls, pa.array(key[cold]), pa.array(times[cold])], names=names)


def scored(found: DataFrame, n_a: int, folder: str, hot_share: int = HOT_SHARE) -> DataFrame:
    """found (links(), with a unique number `uid` for each row, stored) with n_best and count_sum. n_a: size of A's vocabulary."""
    spark = found.sparkSession
    docs = found.filter("part IS NULL")
    same_count, best = np.zeros(n_a, np.int64), np.zeros(n_a, np.int64)
    vectors = found.filter("part IS NOT NULL").select(F.explode(F.arrays_zip("same", "same_n")).alias("x")).groupBy(F.col("x.same").alias("a")).agg(F.sum("x.same_n").alias("n"))
    for r in vectors.collect():  # a row for each A id at most
        same_count[r.a] = best[r.a] = r.n
    docs.select(F.explode("pairs").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("count")).write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    for r in pairs.groupBy(F.shiftright("key", _BITS).alias("a")).agg(F.max("count").alias("n")).collect():  # again by A id
        best[r.a] = max(best[r.a], r.n)
    rows = pairs.agg(F.sum("count").alias("n")).first().n or 0
    often = sorted((r.key, r["count"]) for r in pairs.filter(F.col("count") * hot_share > rows).collect())  # fewer than hot_share
    hot, hot_count = (np.array(c, dtype=np.int64) for c in zip(*often, strict=True)) if often else (np.empty(0, np.int64),) * 2
    sent = spark.sparkContext.broadcast((same_count, best, hot, hot_count))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _second_rows(batch, *sent.value)

    each = docs.drop("part").mapInArrow(counted, _SECOND)
    bests = spark.createDataFrame([(int(a), int(best[a])) for a in np.flatnonzero(best)], "a long, best long")
    cold = pairs.filter(F.col("count") * hot_share <= rows).withColumn("a", F.shiftright("key", _BITS)).join(F.broadcast(bests), "a")
    cold = cold.select("key", "count", (F.col("count") == F.col("best")).cast("long").alias("is_best"))
    whole = lambda c: F.max(c).alias(c)
    added = lambda own, other: (F.coalesce(F.max(own), F.lit(0)) + F.coalesce(F.sum(F.col("n") * F.col(other)), F.lit(0))).alias(own)
    by = each.join(cold, "key", "left").groupBy("uid")
    return by.agg(*map(whole, ("doc_id", "n_a", "n_b", "n_groups", "n_links")), added("n_best", "is_best"), added("count_sum", "count"), whole("groups_sha256")).drop("uid")


def query(documents: DataFrame, a_file: str = "byte_bpe_50k.json", b_file: str = "piece_bpe_32k.model", hot_share: int = HOT_SHARE) -> DataFrame:
    """Links of all documents with their corpus-wide counts. The links are written once to the shared folder and read from there."""
    import public_tokenizers

    a_path = public_tokenizers.path(a_file)
    folder = f"{shared_folder(documents.sparkSession)}/alignment-{uuid.uuid4().hex}"
    found = links(documents, a_path, public_tokenizers.path(b_file), public_tokenizers.PATTERN).withColumn("uid", F.monotonically_increasing_id())
    found.write.parquet(f"{folder}/links")
    return scored(documents.sparkSession.read.parquet(f"{folder}/links"), len(bytes_of_a(a_path)), folder, hot_share)
