"""N-gram Jaccard join: which documents are linked by word shingles, by default of 3 words at a similarity of 0.9 or more.

1. Word document frequencies over all documents; a shingle's frequency is at most that of its rarest word. This bound,
   in classes of half a power of two, is the high part of the shingle's 64-bit key and a hash the low part. So a
   document's keys in ascending order are its shingles rare-first, and equal sets have equal keys.
2. Documents with equal sets become one node (their smallest doc_id).
3. Prefix filter: each node's first n - ceil(0.9 n) + 1 keys. Two nodes that link share a prefix key and have sizes in
   the same band or neighbouring ones. The nodes under one key and band gather around the smallest of them, its pivot;
   all that have the same pivot make one group, so a family of near copies is gathered once, not once for each key
   they share, and no list of pairs is ever written.
4. Groups are screened on sizes and small histograms of the keys (length and suffix filter) first; whole sets are
   made again and moved only for nodes with a partner left. In a group the pivot is compared first, then only pairs that
   nothing has linked yet; those that the length, suffix and positional filters leave are verified on whole sets. A
   pair that shares several groups belongs to the first. A group of over `block` nodes or `block_keys` keys is dealt out:
   first all its blocks against the pivot, then the nodes that the pivot doesn't link against all blocks.
5. Connected components of the links by alternating large-star and small-star steps, each written to the shared
   checkpoint folder.

Only words in at least 1/4000 of the documents are sent to all executors: there can't be more than 4000 times the
mean number of different words in a document, whatever the number of documents.

A group's size is joined to its nodes under a salt, so the nodes of a large group are never one task's; a task holds the
sets of at most two blocks. The join on the centre of a large star is left to Spark's splitting of skewed partitions.

Defined cases: null and empty texts have no shingles and are their own component; fewer words than a shingle has make one
shingle; repeated rows are exact copies; rows that share a doc_id but not their text are compared each for itself, and
a component's id is the smallest doc_id in it; a null doc_id links with nothing and has a null component; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import WordHashes, checkpoint, fresh

_ONE, _TWO, _THREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_LOW, _CLASS = np.uint64(6), np.uint64(58)


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space; bytes.lower() changes A-Z alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class RankedWords(WordHashes):
    """Hashes of words with a frequency class in the low six bits; 0 for words that aren't frequent."""

    def __init__(self, classes: dict[int, int]):
        self.classes = classes

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        value = self[word] = (h & ~63) | self.classes.get(h, 0)
        return value


def shingle_keys(text: str | None, ranked: RankedWords, shingle: int = 3) -> np.ndarray:
    """The different shingles of a text as keys, rare-first."""
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(ranked.__getitem__, ws), np.uint64, len(ws))
    rank, h = h & np.uint64(63), h >> _LOW
    k = min(shingle, len(ws))
    n = len(ws) - k + 1
    mixed, least = h[:n] * _ONE, rank[:n]
    for j in range(1, k):
        mixed, least = (mixed + h[j : n + j]) * _TWO, np.minimum(least, rank[j : n + j])
    if k < shingle:
        mixed = mixed + np.uint64(k)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _THREE
    mixed ^= mixed >> np.uint64(32)
    return np.unique((least << _CLASS) | (mixed >> _LOW))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def word_classes(documents: DataFrame, text: str, share: int = 4000, least: int = 16) -> dict[int, int]:
    """Frequency classes (1 to 63) of the words that are in at least 1/share of the documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws)) for ws in (set(words(x)) for x in texts)]
            word, df = np.unique(np.concatenate([*found, np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(df.astype(np.int64))], ["word", "df"])

    n = documents.count()
    floor = max(least, n // share)
    frequent = documents.select(text).mapInArrow(counted, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).filter(F.col("df") >= floor)
    return {w % (1 << 64): min(63, 1 + int(2 * np.log2(df / floor))) for w, df in frequent.collect()}


def histogram(keys: np.ndarray) -> bytes:
    """Counts of keys by their lowest bits, a byte each, about eight keys to a bin, in 64 to 2048 bins.

    The sum of differences of two histograms, folded to the same length, is a lower bound of the symmetric difference;
    cutting counts off at 255 only lowers it.
    """
    n = 1 << min(max(6, (len(keys) // 8).bit_length()), 11)
    return np.minimum(np.bincount((keys & np.uint64(n - 1)).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


class Verifier:
    """Filters on sizes and histograms, and exact verification of pairs of key sets."""

    def __init__(self, sizes: list[int], histograms: list[bytes], percent: int, sets: list[np.ndarray] | None = None):
        self.sets, self.percent = sets, percent
        self.sizes = np.array(sizes, dtype=np.int64)
        n = min(map(len, histograms))
        self.bins = np.stack([np.frombuffer(h, np.uint8).reshape(-1, n).sum(axis=0, dtype=np.int32) for h in histograms])

    def need(self, i: int, j: np.ndarray | int) -> np.ndarray:
        """The smallest intersection that links: 100 I >= percent (a + b - I)."""
        return -(-self.percent * (self.sizes[i] + self.sizes[j]) // (100 + self.percent))

    def candidates(self, i: int, others: np.ndarray) -> np.ndarray:
        """Of others, those that the length and suffix filters leave."""
        a, b = self.sizes[i], self.sizes[others]
        others = others[100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)]
        apart = np.abs(self.bins[others] - self.bins[i]).sum(axis=1)
        return others[apart <= a + self.sizes[others] - 2 * self.need(i, others)]

    def linked(self, i: int, j: int) -> bool:
        x, y, need = self.sets[i], self.sets[j], int(self.need(i, j))
        p, q = prefix_length(len(x), self.percent), prefix_length(len(y), self.percent)
        _, at, there = np.intersect1d(x[:p], y[:q], assume_unique=True, return_indices=True)
        if not len(at) or 1 + min(len(x) - at[0], len(y) - there[0]) - 1 < need:  # positional: nothing before the first is shared
            return False
        return len(np.intersect1d(x, y, assume_unique=True)) >= need


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


Row = tuple[int, np.ndarray, list[int], bool]  # node, keys, pivots of all its groups, whether the pivot doesn't link it


def group_links(pivot: int, rows: list[Row], percent: int, step: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that join what the group's rows have in common, and the nodes that the pivot doesn't link.

    step: `all` compares what is needed of all pairs, `pivot` only with the pivot, `rest` each row that is marked with all others.
    """
    rows = list({r[0]: r for r in sorted(rows, key=lambda r: (r[0], r[3]))}.values())
    if len(rows) < 2:
        return [], []
    nodes = [r[0] for r in rows]
    sets = [r[1] for r in rows]
    check, forest = Verifier([len(x) for x in sets], [histogram(x) for x in sets], percent, sets), Forest(len(rows))
    everyone = np.arange(len(rows))
    if step != "rest" and pivot in nodes:
        p = nodes.index(pivot)
        for j in check.candidates(p, everyone[everyone != p]):
            if min(set(rows[p][2]) & set(rows[j][2])) == pivot and check.linked(p, j):
                forest.join(p, j)
    alone = [nodes[i] for i in range(len(rows)) if step == "pivot" and nodes[i] != pivot and forest.root(i) != forest.root(nodes.index(pivot))]
    if step != "pivot":
        first = [min(r[2]) for r in rows]
        shared = [set(r[2]) for r in rows]
        for i in range(len(rows)):
            if step == "rest" and not rows[i][3]:
                continue
            others = everyone[:i] if step == "all" else np.array([j for j in range(len(rows)) if j != i and (j < i or not rows[j][3])], dtype=np.int64)
            for j in check.candidates(i, others):
                if forest.root(i) == forest.root(j):
                    continue
                if first[i] == first[j] < pivot or min(shared[i] & shared[j]) < pivot:
                    continue  # the pair belongs to an earlier group
                if check.linked(i, j):
                    forest.join(i, j)
    least: dict[int, int] = {}
    for i in range(len(rows)):
        r = forest.root(i)
        least[r] = min(least.get(r, nodes[i]), nodes[i])
    return [(nodes[i], least[forest.root(i)]) for i in range(len(rows)) if nodes[i] != least[forest.root(i)]], alone


def partners(pivot: int, rows: list[tuple[int, int, bytes, list[int]]], percent: int) -> list[int]:
    """Of (node, size, histogram, pivots) of a group, the nodes with a partner that the filters leave and that no earlier group has."""
    check = Verifier([r[1] for r in rows], [r[2] for r in rows], percent)
    groups, everyone = [set(r[3]) for r in rows], np.arange(len(rows))
    kept = np.zeros(len(rows), bool)
    for i in range(1, len(rows)):
        for j in check.candidates(i, everyone[:i]):
            if not (kept[i] and kept[j]) and min(groups[i] & groups[j]) == pivot:
                kept[i] = kept[j] = True
    return [rows[i][0] for i in np.flatnonzero(kept)]


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], done) -> Iterator[pa.RecordBatch]:
    """done(key, rows as tuples) for each run of two rows or more with equal keys in a sorted partition."""
    at, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[: len(keys)] != at:
                if len(held) > 1:
                    yield done(at, held)
                at, held = row[: len(keys)], []
            held.append(row[len(keys) :])
    if len(held) > 1:
        yield done(at, held)


def _screened(rows: DataFrame, percent: int) -> DataFrame:
    """rows: pivot, node, n, bins, pivots. Returns pivot, node where partners() keeps the node."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key, held):
            nodes = partners(key[0], held, percent)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(nodes), pa.int64()), pa.array(nodes, pa.int64())], ["pivot", "node"])

        return _runs(batches, ("pivot",), done)

    dealt = rows.select("pivot", "node", "n", "bins", "pivots").repartition("pivot").sortWithinPartitions("pivot", "node")
    return dealt.mapInArrow(kept, "pivot long, node long")


def _grouped_links(rows: DataFrame, percent: int, step: str) -> DataFrame:
    """rows: pivot, block, node, keys, pivots, rest. Returns a, b of links; with b null, nodes that the pivot doesn't link."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key, held):
            links, alone = group_links(key[0], [(node, np.frombuffer(keys, np.uint64), pivots, rest) for node, keys, pivots, rest in held], percent, step)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * (len(links) + len(alone)), pa.int64()), pa.array([*(a for a, _ in links), *alone], pa.int64()), pa.array([*(b for _, b in links), *(None for _ in alone)], pa.int64())], ["pivot", "a", "b"])

        return _runs(batches, ("pivot", "block"), done)

    dealt = rows.select("pivot", "block", "node", "keys", "pivots", "rest").repartition("pivot", "block").sortWithinPartitions("pivot", "block", "node")
    return dealt.mapInArrow(linked, "pivot long, a long, b long")


def signatures(documents: DataFrame, classes: dict[int, int], percent: int, text: str, shingle: int) -> DataFrame:
    """doc_id, n (set size), key (128-bit hash of the set), prefix (first keys), bins (histogram())."""
    held = documents.sparkSession.sparkContext.broadcast(classes)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = RankedWords(held.value)
        for batch in batches:
            sets = [shingle_keys(x, ranked, shingle) for x in batch.column(1).to_pylist()]
            heads = [s[: prefix_length(len(s), percent)] if len(s) else s for s in sets]
            ends = np.cumsum([0, *map(len, heads)])
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*heads, np.empty(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), prefix, pa.array([histogram(s) if len(s) else None for s in sets], pa.binary())], ["doc_id", "n", "key", "prefix", "bins"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(signed, "doc_id long, n long, key binary, prefix array<long>, bins binary")


def _with_sets(documents: DataFrame, members: DataFrame, classes: dict[int, int], text: str, shingle: int) -> DataFrame:
    """members (node, doc, key, pivots, groups: pivot and number of blocks) with their keys: node, pivots, groups, keys."""
    held = documents.sparkSession.sparkContext.broadcast(classes)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = RankedWords(held.value)
        for batch in batches:
            sets = [shingle_keys(x, ranked, shingle).tobytes() for x in batch.column("text").to_pylist()]
            same = pa.array([xxhash.xxh3_128_digest(s) == k for s, k in zip(sets, batch.column("key").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("pivots"), batch.column("groups"), pa.array(sets, pa.binary())], ["node", "pivots", "groups", "keys"]).filter(same)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc"), F.col(text).alias("text"))
    return texts.join(members, "doc").select("node", "text", "key", "pivots", "groups").mapInArrow(keyed, "node long, pivots array<long>, groups array<struct<pivot: long, blocks: long>>, keys binary")


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node that has a link (columns a, b)."""
    edges = checkpoint(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = checkpoint(small)
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def _nodes(signed: DataFrame) -> tuple[DataFrame, bool]:
    """A row for each different set: key, doc (smallest doc_id), node, n, prefix, bins; and whether a node is more than its doc.

    A node is called by its doc. Where rows with unlike texts share a doc_id, several sets have the same doc; such nodes are
    called by a hash of their key, below all usual ids.
    """
    sets = signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc"), *(F.first(c).alias(c) for c in ("n", "prefix", "bins")))
    crowded = checkpoint(sets.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc", F.lit(True).alias("crowded")))
    if crowded.isEmpty():
        return sets.withColumn("node", F.col("doc")), False
    named = F.when(F.col("crowded"), F.xxhash64("key").bitwiseOR(-(1 << 63)).bitwiseAND(~(1 << 62))).otherwise(F.col("doc"))
    return sets.join(crowded, "doc", "left").withColumn("node", named).drop("crowded"), True


def linked_components(documents: DataFrame, *, percent: int = 90, shingle: int = 3, block: int = 512, block_keys: int = 1 << 20, text: str = "text", salts: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) for every row of documents."""
    classes = word_classes(documents, text)
    signed = checkpoint(signatures(documents, classes, percent, text, shingle))
    nodes, shared_ids = _nodes(signed)
    entries = nodes.select("node", F.col("n").cast("int").alias("n"), F.explode("prefix").alias("token"))
    shared = entries.join(entries.groupBy("token").count().filter("count > 1").select("token"), "token")
    width = -math.log(percent / 100) * 1.0001  # sizes that can link are less than a band apart
    band = F.floor(F.log(F.col("n")) / width).cast("int")
    banded = checkpoint(shared.select("token", "node", "n", F.explode(F.array(band, band + 1)).alias("band")))
    pivots = banded.groupBy("token", "band").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    members = checkpoint(banded.join(pivots, ["token", "band"]).select("pivot", "node", "n").distinct())
    needed = F.greatest(F.count(F.lit(1)) / block, F.sum(F.col("n").cast("long")) / block_keys)
    crowds = members.groupBy("pivot").agg(F.ceil(needed).cast("long").alias("blocks")).filter("blocks > 1")
    crowds = crowds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    placed = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(crowds, ["pivot", "salt"], "left")
    groups = placed.groupBy("node").agg(F.collect_list(F.struct("pivot", F.coalesce("blocks", F.lit(1).cast("long")).alias("blocks"))).alias("groups"))
    listed = checkpoint(groups.withColumn("pivots", F.col("groups.pivot")).join(nodes.select("node", "doc", "key", "n", "bins"), "node"))
    each = listed.withColumn("g", F.explode("groups")).select("node", "n", "bins", "pivots", "g.*")
    kept = _screened(each.filter("blocks = 1"), percent).groupBy("node").agg(F.collect_list(F.struct("pivot", F.lit(1).cast("long").alias("blocks"))).alias("kept"))
    # Of a node's groups, the screened ones and those dealt out in blocks; so texts are moved once.
    groups = F.concat(F.filter("groups", lambda g: g.blocks > 1), F.coalesce("kept", F.array().cast("array<struct<pivot: long, blocks: long>>")))
    wanted = listed.join(kept, "node", "left").select("node", "doc", "key", "pivots", groups.alias("groups")).filter(F.size("groups") > 0)
    sets = checkpoint(_with_sets(documents, wanted, classes, text, shingle).dropDuplicates(["node"]))
    sets = sets.withColumn("g", F.explode("groups")).select(F.col("g.pivot").alias("pivot"), F.col("g.blocks").alias("blocks"), "node", "keys", "pivots")
    links = _grouped_links(sets.filter("blocks = 1").withColumns({"block": F.lit(0), "rest": F.lit(False)}), percent, "all").select("a", "b")
    large = sets.filter("blocks > 1")
    if not large.isEmpty():
        own = F.pmod(F.xxhash64("node"), F.col("blocks"))
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        first = large.withColumn("block", F.explode(F.when(F.col("node") == F.col("pivot"), every).otherwise(F.array(own)))).withColumn("rest", F.lit(False))
        found = checkpoint(_grouped_links(first, percent, "pivot"))
        links = links.unionByName(found.filter("b IS NOT NULL").select("a", "b"))
        rest = found.filter("b IS NULL").select("pivot", F.col("a").alias("node")).distinct()
        # The marked rows in parts as small as the blocks, each part with every block of the group.
        marked = large.join(rest, ["pivot", "node"])
        parts = marked.groupBy("pivot").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum(F.octet_length("keys")) / (8 * block_keys))).cast("long").alias("parts"))
        marked = marked.join(parts, "pivot").withColumn("_p", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))).withColumn("_b", F.explode(every)).withColumn("rest", F.lit(True))
        others = large.join(parts, "pivot").withColumn("_b", own).withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("rest", F.lit(False))
        second = marked.unionByName(others).select("pivot", "node", "keys", "pivots", "rest", (F.col("_p") * F.col("blocks") + F.col("_b")).alias("block"))
        links = links.unionByName(_grouped_links(second, percent, "rest").select("a", "b"))
    roots = components(links)
    of_set = nodes.select("key", "node", "doc").join(roots, "node", "left").select("key", "doc", F.coalesce("root", "node").alias("root"))
    if shared_ids:  # a root may be called by a hash
        of_set = of_set.join(of_set.groupBy("root").agg(F.min("doc").alias("component_id")), "root")
    else:
        of_set = of_set.withColumn("component_id", F.col("root"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "key").join(of_set.select("key", "component_id"), "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    """documents with the rows of the smallest doc_id of each component.

    Rows that share that doc_id stay if their texts differ; of those with the same text too, the one whose other columns are
    the smallest. Rows without a doc_id stay.
    """
    kept = linked_components(documents, text=text, **options).filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    known = documents.filter("doc_id IS NOT NULL")
    known = known.join(kept, F.col("doc_id").cast("long") == F.col("_kept"), "left_semi")
    own = Window.partitionBy("doc_id", F.xxhash64(text), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))).orderBy(*(F.col(f"`{f.name}`") for f in documents.schema.fields if not isinstance(f.dataType, (MapType, VariantType))))
    place = fresh(documents, "place")
    return known.withColumn(place, F.row_number().over(own)).filter(F.col(place) == 1).drop(place).unionByName(documents.filter("doc_id IS NULL"))
