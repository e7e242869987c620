"""Benchmark decontamination with DataFrame functions only.

Benchmark items become windows of 13 words (a shorter item is one window), normalised as the documents' words are. A
window's hash is made of two blocks of words, whose hashes are doubled up from single words to 2, 4 and 8, so that each
length costs one more hash for each word of a document. The hash set of all windows goes to every task as one value, a
table of slots; inside each row all windows of the text are looked up in it, and every hit is verified word for word
against the windows of its slot. Nothing is exploded or shuffled.

The table is sent only if it is measured to be at most `max_table` bytes. A larger benchmark is sent as a set of bits
(at most 16 MB, whatever its size): the scan of the rows is the same, and the few windows that it lets through are
verified by a join on their hash, salted so that a passage in very many documents is not one task's. Those rows hold
the window's words and a key made from the row's data, never its text.

Defined cases: null and empty texts have no words, no hits and aren't contaminated; items without words are never
found; equal windows of several items count for each of them; an item without an id counts as one item, which the digest
of ids leaves out; repeated rows each give a result of their own; with an empty benchmark nothing is hit; all columns of
the documents stay in `clean` and `without_spans`, whatever they are called; `hits` replaces columns called like its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import fresh, let

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _block(n: int) -> int:
    """The largest power of two that is at most n."""
    return 1 << (n.bit_length() - 1)


def _blocks(ws: Column, longest: int, body) -> Column:
    """body({1: hashes of the words, 2: of each two neighbours, 4: ...}), each array made once."""

    def level(size: int, made: dict[int, Column]) -> Column:
        if size > longest:
            return body(made)
        half = made[size // 2]
        return let(F.transform(half, lambda h, i: F.xxhash64(h, F.get(half, i + size // 2))), lambda hs: level(2 * size, made | {size: hs}))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), lambda hs: level(2, {1: hs}))


def _hash(blocks: dict[int, Column], n: int, i: Column) -> Column:
    """The hash of n words from place i on: of two blocks that cover them."""
    half = blocks[_block(n)]
    return F.xxhash64(F.lit(n), F.get(half, i), F.get(half, i + (n - _block(n))))


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """A row for each different window: h (hash), n (length), words, items (sorted ids that it occurs in)."""
    each = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    each = each.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(size(ws) - {size - 1}, 1)), i -> slice(ws, i, {size}))")).alias("words"))
    items = F.array_sort(F.transform(F.collect_set(F.struct("item")), lambda x: x.item))
    each = each.groupBy("words").agg(items.alias("items")).withColumn("n", F.size("words"))
    by_length = lambda blocks: reduce(lambda c, n: c.when(F.col("n") == n, _hash(blocks, n, F.lit(0))), range(1, size + 1), F)
    return each.select(_blocks(F.col("words"), size, by_length).alias("h"), "n", "words", "items")


def _dense(rows: DataFrame, slots: int, value: Column, default: Column) -> Column:
    """An array with value at each slot (column slot of rows, one row a slot), as a value that is computed once."""
    all_slots = rows.sparkSession.range(slots).select(F.col("id").alias("slot"))
    placed = all_slots.join(rows.select("slot", value.alias("v")), "slot", "left").select(F.struct("slot", F.coalesce("v", default).alias("v")).alias("x"))
    return placed.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.v)).scalar()


def _places(ws: Column, blocks: dict[int, Column], n: int, known) -> Column:
    """struct(i, h) of each window of n words whose hash is known."""
    every = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(F.array().cast("array<int>"))
    tested = F.transform(every, lambda i: let(_hash(blocks, n, i), lambda h: F.when(known(h), F.struct(i.alias("i"), h.alias("h")))))
    return F.filter(tested, lambda c: c.isNotNull())


def _same(ws: Column, c: Column, n: int, words: Column) -> Column:
    return F.slice(ws, c.i + 1, n) == words


def _with(documents: DataFrame, value: Column, name: str, body) -> DataFrame:
    """documents with body(value) in `name`. Spark wants a subquery outside of lambda functions; the optimiser puts the two projections together."""
    sent = fresh(documents, "sent")
    return documents.withColumn(sent, value).withColumn(name, let(F.col(sent), body)).drop(sent)


def _in_rows(documents: DataFrame, text: str, marked: DataFrame, count: int, lengths: list[int], output: str) -> DataFrame:
    """documents with struct(n, spans, items) of their texts in `output`, all made inside the row."""
    slots = 1 << max(3, (8 * count).bit_length())
    slot = lambda h: h.bitwiseAND(slots - 1).cast("int")
    entry = F.struct("h", "words", "items")
    filled = marked.groupBy(slot(F.col("h")).alias("slot")).agg(F.array_sort(F.collect_list(entry)).alias("v"))
    table = _dense(filled, slots, F.col("v"), F.array().cast(filled.schema["v"].dataType))

    def scan(table: Column, ws: Column) -> Column:
        at = lambda h: F.get(table, slot(h))

        def whole(blocks: dict[int, Column], n: int) -> Column:
            known = lambda h: let(at(h), lambda es: (F.size(es) > 0) & F.exists(es, lambda e: e.h == h))
            verified = lambda c: F.filter(at(c.h), lambda e: (e.h == c.h) & _same(ws, c, n, e.words))
            of_place = lambda c: let(verified(c), lambda es: F.when(F.size(es) > 0, F.struct(c.i.alias("start"), F.lit(n).alias("length"), F.flatten(F.transform(es, lambda e: e["items"])).alias("items"))))
            return F.filter(F.transform(_places(ws, blocks, n, known), of_place), lambda x: x.isNotNull())

        def of(blocks: dict[int, Column]) -> Column:
            found = [whole(blocks, n) for n in lengths]
            return let(F.concat(*found), lambda xs: F.struct(F.size(ws).alias("n"), F.transform(xs, lambda x: F.struct(x.start.alias("start"), x["length"].alias("length"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.transform(xs, lambda x: x["items"])))).alias("items")))

        return _blocks(ws, _block(max(lengths)), of)

    return _with(documents, table, output, lambda t: let(words(F.col(f"`{text}`")), lambda ws: scan(t, ws)))


def _by_join(documents: DataFrame, text: str, marked: DataFrame, count: int, lengths: list[int], output: str, salts: int = 32, most_bits: int = 1 << 27) -> DataFrame:
    """documents with struct(n, spans, items) in `output`: what the set of bits lets through is verified by a join."""
    size = min(most_bits, 1 << (16 * count).bit_length()) // 64 or 1
    slot = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(size - 1).cast("int")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    bits = _dense(marked.groupBy(slot(F.col("h")).alias("slot")).agg(F.bit_or(bit(F.col("h"))).alias("v")), size, F.col("v"), F.lit(0).cast("long"))

    def passed(bits: Column, ws: Column) -> Column:
        known = lambda h: F.get(bits, slot(h)).bitwiseAND(bit(h)) != 0
        of_length = lambda blocks, n: F.transform(_places(ws, blocks, n, known), lambda c: F.struct(c.i.alias("i"), F.lit(n).alias("n"), c.h.alias("h"), F.slice(ws, c.i + 1, n).alias("words")))
        return _blocks(ws, _block(max(lengths)), lambda blocks: F.concat(*(of_length(blocks, n) for n in lengths)))

    # What is found depends on the text alone; the salt, of a few other columns, keeps copies of one text from being one key.
    others = [F.col(f"`{f.name}`") for f in documents.schema.fields if f.name != text and not isinstance(f.dataType, (MapType, VariantType))][:3]
    key = [F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_key"), F.pmod(F.xxhash64(F.lit(0), *others), F.lit(salts)).alias("_salt")]
    slim = documents.select(*key, F.col(f"`{text}`").alias("_text"))
    through = _with(slim, bits, "c", lambda b: let(words(F.col("_text")), lambda ws: passed(b, ws))).select("_key", "_salt", F.explode("c").alias("c")).select("_key", "_salt", "c.*")
    spread = marked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    verified = through.join(spread, ["h", "_salt", "n", "words"])
    spans = F.collect_set(F.struct(F.col("i").alias("start"), F.col("n").alias("length")))
    of_key = verified.groupBy("_key", "_salt").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    row, rest = fresh(documents, "row"), [F.col(f"`{c}`") for c in documents.columns]
    # The words are counted before the join: where the texts aren't asked for, as in query(), they aren't moved.
    joined = documents.select(F.struct(*rest).alias(row), F.size(words(F.col(f"`{text}`"))).alias("_size"), *key).join(of_key, ["_key", "_salt"], "left")
    empty = lambda c: F.coalesce(c, F.array().cast(of_key.schema[c].dataType)).alias(c)
    found = F.struct(F.col("_size").alias("n"), empty("spans"), empty("items"))
    return joined.select(f"{row}.*", found.alias(output))


def marked_documents(documents: DataFrame, benchmark: DataFrame, output: str, *, size: int = 13, text: str = "text", max_table: int = 32 << 20) -> DataFrame:
    """documents with `output`: struct(n (words), spans (start, length of the occurring windows), items (sorted ids))."""
    marked = windows(benchmark, size)
    weight = F.aggregate("words", F.lit(64).cast("long"), lambda n, w: n + 16 + F.octet_length(w)) + F.aggregate("items", F.lit(128).cast("long"), lambda n, x: n + 16 + F.coalesce(F.octet_length(x), F.lit(0)))
    count, table, lengths = marked.agg(F.count(F.lit(1)), F.sum(weight), F.sort_array(F.collect_set("n"))).first()
    if not count:
        none = F.struct(F.size(words(F.col(f"`{text}`"))).alias("n"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
        return documents.withColumn(output, none)
    if table <= max_table:
        return _in_rows(documents, text, marked, count, list(lengths), output)
    return _by_join(documents, text, marked, count, list(lengths), output)


def hits(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """documents with `_n` (words), `_spans` (start, length of the occurring windows) and `_items` (sorted item ids)."""
    name = fresh(documents, "found")
    found = marked_documents(documents, benchmark, name, **options)
    kept = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in ("_n", "_spans", "_items")]
    return found.select(*kept, F.col(f"{name}.n").alias("_n"), F.col(f"{name}.spans").alias("_spans"), F.col(f"{name}.items").alias("_items"))


def _positions(spans: str | Column = "_spans") -> Column:
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s.start, s.start + s["length"] - 1))))


def contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = hits(documents.select("doc_id", "text"), benchmark)
    out = found.select("doc_id", F.col("_n").cast("long").alias("n_words"), F.size(_positions()).cast("long").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", contaminated(F.col("n_words"), F.col("n_hit")))


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """documents without the contaminated ones."""
    name = fresh(documents, "found")
    found = marked_documents(documents, benchmark, name, **options)
    return found.filter(let(F.col(name), lambda f: ~contaminated(f.n, F.size(_positions(f.spans))))).drop(name)


def without_spans(documents: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """documents whose texts lack the words of matched windows; what stands between words stays."""
    name = fresh(documents, "found")
    own_word = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    whole = F.col(f"`{text}`")
    gaps, own = F.split(whole, own_word, -1), F.regexp_extract_all(whole, F.lit(own_word), F.lit(0))
    found = marked_documents(documents, benchmark, name, text=text, **options)

    def marked(hit: Column) -> Column:
        """For each word whether it is hit, from sorted places: a piece for each hit and what lies before it."""
        no = lambda n: F.array_repeat(F.lit(False), n.cast("int"))
        before = lambda k: F.coalesce(F.get(hit, k - 1), F.lit(-1))
        return F.concat(F.flatten(F.transform(hit, lambda i, k: F.concat(no(i - before(k) - 1), F.array(F.lit(True))))), no(F.size(own) - before(F.size(hit)) - 1))

    def rest(hit: Column) -> Column:
        marks = let(F.array_sort(hit), marked)
        kept = F.zip_with(own, marks, lambda w, gone: F.when(gone, F.lit("")).otherwise(w))
        joined = F.array_join(F.zip_with(gaps, F.concat(kept, F.array(F.lit(""))), lambda g, w: F.concat(g, w)), "")
        return F.when(F.size(hit) > 0, joined).otherwise(whole)

    return found.withColumn(text, let(_positions(F.col(f"{name}.spans")), rest)).drop(name)


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item, len(w) AS n, array_to_string(w, ' ') AS w FROM (
    SELECT item, list_slice(ws, i, i + 12) AS w FROM items, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(i) WHERE len(ws) > 0)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
occ AS (
  SELECT d.r, d.i, win.n, win.item FROM (
    SELECT r, i, l.n, array_to_string(list_slice(ws, i, i + l.n - 1), ' ') AS w
    FROM docs, (SELECT DISTINCT n FROM win) AS l, unnest(range(1, len(ws) - l.n + 2)) AS t(i)) AS d JOIN win ON d.w = win.w AND d.n = win.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM occ)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
