"""Quality rules by distribution divergence, with DataFrame functions only.

Two histograms of a text are compared with language references by Jensen-Shannon distance: its character classes, and
how often the common words of the reference languages occur. Every language that the table names for `least_documents`
documents or more has a reference: its common words are the `common` words in most of its documents (ties: the smaller
word), and its histograms are the sums of all its documents'. A document is kept if, for the nearest language, both
distances stay below their limits. A document in a language without a reference isn't judged by those of other languages: only
the base rules hold for it. Texts of fewer than `least_words` words aren't judged by divergence (a short text's
histogram says little), only by the base rules.

Words are counted per language with partial sums before any shuffle; histograms are made inside each row, only their sums
per language are shuffled, and a row for each reference language goes to the driver. The work for a document grows with the
number of reference languages.

Defined cases: null and empty texts have no words and fail the base rules; a language without enough documents has no
reference, and its documents that pass the base rules stay; without any reference only the base rules hold; repeated rows give equal results; documents without a language
are compared like all others; other columns but the text are kept, whatever they are called, except that results replace
columns of their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, let

# Character classes, as Java patterns; white space, and all other characters (mostly lower case), are two more.
CLASSES = {
    "upper": r"\p{Lu}",
    "digit": r"[0-9]",
    "symbol": r"[#*$%&|<>@=+~^_\\{}\[\]/]",
    "stop": r"[.,;:!?'\"()-]",
}
# End of fixed values.

COMMON, LEAST_DOCUMENTS = 12, 10
#: The limit of words lies below the distance of a text without common words (0.349 to 0.354 on sf0.1, where the documents that pass
#: the base rules have their median at 0.10 to 0.11 and their 90 % point at 0.19 to 0.22).
LIMITS = {"classes": 0.22, "words": 0.30}
_WORD = r"[^\\x20\\x09-\\x0D]+"


#: Places of words that fit beside a hash in 64 bits; texts of more words take a slower way with the same result.
_PLACES = 1 << 17


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _packed(documents: DataFrame, text: str, lang: str | None = None) -> DataFrame:
    """documents as `row` (all columns but the text), `lang` and `t` (the text), so that no name can clash."""
    others = [F.col(f"`{c}`") for c in documents.columns if c != text] or [F.lit(None).alias("none")]
    return documents.select(F.struct(*others).alias("row"), (F.col(f"`{lang}`") if lang else F.lit(None)).cast("string").alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))


def _unpacked(packed: DataFrame, documents: DataFrame, text: str, results: list[str]) -> DataFrame:
    return packed.select(*(F.col(f"row.`{c}`") for c in documents.columns if c != text and c.lower() not in results), *results)


def _based(packed: DataFrame) -> DataFrame:
    """packed with `ws` (words), `rare` (the text without small letters and blanks, which no counted class has) and BASE."""
    df = packed.withColumn("ws", F.expr(f"regexp_extract_all(t, '{_WORD}', 0)")).withColumn("rare", F.regexp_replace("t", r"[a-z \n]+", ""))
    # Starts of 3-word windows that occur again: neighbours with equal words, once windows are sorted by hash and place.
    # Where neighbours' hashes are equal and their words aren't, windows are sorted by their words.
    windows = "CASE WHEN size(ws) < 3 THEN array() ELSE slice(ws, 1, size(ws) - 2) END"
    hashed = f"transform({windows}, (w, i) -> (xxhash64(w, ws[i + 1], ws[i + 2]) & {-_PLACES}L) + i)"
    place = lambda x: f"cast({x} & {_PLACES - 1}L AS int)"
    pairs = "zip_with(slice(s, 1, greatest(size(s) - 1, 0)), slice(s, 2, greatest(size(s) - 1, 0)), (a, b) -> CASE WHEN {same} THEN {both} END)"
    alike = f"slice(ws, {place('a')} + 1, 3) = slice(ws, {place('b')} + 1, 3)"
    fast = pairs.format(same=f"(a & {-_PLACES}L) = (b & {-_PLACES}L)", both=f"CASE WHEN {alike} THEN array({place('a')}, {place('b')}) ELSE array(-1) END")
    spelled = f"array_sort(transform({windows}, (w, i) -> struct(concat(w, ' ', ws[i + 1], ' ', ws[i + 2]) AS t, i AS i)))"
    slow = pairs.format(same="a.t = b.t", both="array(a.i, b.i)")
    found = lambda made, p: f"element_at(transform(array({made}), s -> flatten(filter({p}, p -> p IS NOT NULL))), 1)"
    either = f"element_at(transform(array(CASE WHEN size(ws) <= {_PLACES} THEN {found(f'sort_array({hashed})', fast)} ELSE array(-1) END), q -> CASE WHEN array_contains(q, -1) THEN {found(spelled, slow)} ELSE q END), 1)"
    df = df.withColumn("again", F.expr(f"element_at(transform(array(ws), ws -> {either}), 1)"))
    lines = "filter(split(t, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    return (
        df.withColumn("n_words", F.size("ws").cast("long"))
        .withColumn("word_chars", F.expr("aggregate(ws, 0L, (n, w) -> n + char_length(w))"))
        .withColumn("n_symbols", (F.length("rare") - F.length(F.regexp_replace("rare", "[#*$%&|<>]", ""))).cast("long"))
        .withColumn("n_dup_lines", F.expr(f"element_at(transform(array({lines}), x -> size(x) - size(array_distinct(x))), 1)").cast("long"))
        .withColumn("n_repeat_words", F.size(F.array_distinct(F.flatten(F.transform("again", lambda i: F.array(i, i + 1, i + 2))))).cast("long"))
        .withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
        .drop("again")
    )


def base(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents without their texts, with BASE."""
    return _unpacked(_based(_packed(documents, text)), documents, text, BASE)


def _letters(t: Column) -> Column:
    return F.split(F.lower(t), r"[^\p{L}]+")


def common_words(documents: DataFrame, lang: str = "lang", text: str = "text", common: int = COMMON, least_documents: int = LEAST_DOCUMENTS) -> dict[str, list[str]]:
    """Of each language with enough documents, the words that are in most of them."""
    rows = documents.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("t")).filter("lang IS NOT NULL")
    enough = [r.lang for r in rows.groupBy("lang").count().filter(F.col("count") >= least_documents).orderBy("lang").collect()]
    if not enough:
        return {}
    each = rows.filter(F.col("lang").isin(enough)).select("lang", F.explode(F.array_distinct(_letters(F.col("t")))).alias("word")).filter("word <> ''")
    ranked = each.groupBy("lang", "word").count().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word")))
    found: dict[str, list[str]] = {x: [] for x in enough}
    for r in ranked.filter(F.col("k") <= common).orderBy("lang", "k").collect():
        found[r.lang].append(r.word)
    return found


def _histograms(based: DataFrame, vocabulary: list[str]) -> DataFrame:
    """based with `classes` and `words`: counts per character class, and per common word."""
    counts = [F.length("rare") - F.length(F.regexp_replace("rare", p, "")) for p in CLASSES.values()]
    counts = [c.cast("long") for c in [*counts, F.length("t") - F.col("word_chars")]]
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    classes = let(F.struct(F.array(*counts).alias("c"), F.length("t").alias("n")), lambda s: F.concat(s.c, F.array(s.n - total(s.c))))
    # Common words alone, each between two blanks of its own, so that replacing one doesn't touch the next.
    kept = F.filter(_letters(F.col("t")), lambda w: w.isin(vocabulary)) if vocabulary else F.array().cast("array<string>")
    spaced = F.concat(F.lit("  "), F.array_join(kept, "  "), F.lit("  "))
    each = lambda s: F.array(*(F.floor((F.length(s) - F.length(F.replace(s, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)) for w in vocabulary)).cast("array<bigint>")
    words = let(F.struct(let(spaced, each).alias("c"), F.col("n_words").alias("n")), lambda s: F.concat(s.c, F.array(F.greatest(s.n - total(s.c), F.lit(0)))))
    return based.withColumn("classes", classes).withColumn("words", words)


def references(measured: DataFrame, langs: list[str], n_words: int) -> dict[str, dict[str, list[float]]]:
    """Shares per language, from the summed histograms of all its documents that have words."""
    if not langs:
        return {}
    rows = measured.filter(F.col("lang").isin(langs) & (F.col("n_words") > 0))
    summed = lambda c, n: F.array(*(F.sum(F.col(c)[i]) for i in range(n))).alias(c)
    sums = rows.groupBy("lang").agg(summed("classes", len(CLASSES) + 2), summed("words", n_words + 1))
    return {r.lang: {part: [x / sum(r[part]) for x in r[part]] for part in ("classes", "words")} for r in sums.collect()}


def distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram from shares."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def of(p: Column) -> Column:
        parts = F.zip_with(p, F.array(*(F.lit(float(q)) for q in reference)), lambda a, b: term(a, (a + b) / 2) / 2 + term(b, (a + b) / 2) / 2)
        return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))

    total = lambda c: F.greatest(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(1))
    shares = let(F.struct(counts.alias("c"), total(counts).alias("n")), lambda s: F.transform(s.c, lambda x: x / s.n))
    return let(shares, of)


def judge(documents: DataFrame, *, text: str = "text", lang: str = "lang", least_words: int = 50, limits: dict[str, float] = LIMITS, common: int = COMMON, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """documents without their texts, with BASE, `js_classes` and `js_words` (of the nearest language) and `kept`.

    Texts are read twice: once for the common words, once to be measured. What is measured, some hundred bytes a document,
    is written to the checkpoint folder, and both the references and the verdicts come from there.
    """
    shared = common_words(documents, lang, text, common, least_documents)
    vocabulary = sorted({w for ws in shared.values() for w in ws})
    df = checkpoint(_histograms(_based(_packed(documents, text, lang)), vocabulary).drop("t", "ws", "rare"))
    known = references(df, list(shared), len(vocabulary))
    if known:
        pairs = [F.struct(distance(F.col("classes"), r["classes"]).alias("classes"), distance(F.col("words"), r["words"]).alias("words")) for _, r in sorted(known.items())]
        each = [let(p, lambda d: F.struct(F.greatest(d.classes / limits["classes"], d.words / limits["words"]).alias("worst"), d.classes.alias("classes"), d.words.alias("words"))) for p in pairs]
        df = df.withColumn("near", F.array_min(F.array(*each)))
    else:
        df = df.withColumn("near", F.expr("named_struct('worst', 0D, 'classes', 0D, 'words', 0D)"))
    foreign = F.coalesce(~F.col("lang").isin(list(shared)), F.lit(False))
    kept = ~F.col("base_failed") & ((F.col("n_words") < least_words) | foreign | (F.col("near.worst") <= 1))
    df = df.withColumns({"js_classes": F.col("near.classes"), "js_words": F.col("near.words"), "kept": kept})
    return _unpacked(df, documents, text, [*BASE, "js_classes", "js_words", "kept"])


def query(documents: DataFrame) -> DataFrame:
    judged = judge(documents.select("doc_id", "lang", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """The query's rows in DuckDB's SQL."""
    classes = ", ".join(f"length(t) - length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))" for p in CLASSES.values())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tri AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 2), ' ') AS g FROM d, unnest(range(1, len(ws) - 1)) AS x(i)),
rep AS (SELECT r, count(DISTINCT p) AS n_rep FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM tri JOIN (SELECT r, g FROM tri GROUP BY r, g HAVING count(*) > 1) USING (r, g)) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
b AS (SELECT r, doc_id, lang, t, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words,
  len(ws) < 50 OR 100 * coalesce(n_rep, 0) > 50 * len(ws) AS base_failed FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
langs AS (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {LEAST_DOCUMENTS}),
spoken AS (SELECT r, lang, unnest(string_split_regex(lower(t), '[^\p{{L}}]+')) AS word FROM b),
cw AS (SELECT word FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(DISTINCT r) DESC, word) AS k FROM spoken JOIN langs USING (lang) WHERE word <> '' GROUP BY lang, word) WHERE k <= {COMMON} GROUP BY word),
c AS (SELECT r, list_concat([{classes}], [length(t) - word_chars]) AS ns, length(t) AS total FROM b),
v AS (SELECT r, word, count(*) AS n FROM spoken WHERE word IN (SELECT word FROM cw) GROUP BY r, word),
w AS (SELECT r, word, coalesce(n, 0) AS n FROM (SELECT r, word FROM b, cw) LEFT JOIN v USING (r, word)),
h AS (SELECT r, 'classes' AS part, CAST(k AS VARCHAR) AS k, n FROM (SELECT r, unnest(range(1, len(ns) + 1)) AS k, unnest(ns) AS n FROM c)
  UNION ALL SELECT r, 'classes', 'rest', total - list_sum(ns) FROM c UNION ALL SELECT r, 'words', word, n FROM w
  UNION ALL SELECT r, 'words', '', greatest(max(n_words) - sum(n), 0) FROM w JOIN b USING (r) GROUP BY r),
p AS (SELECT r, part, k, n / greatest(sum(n) OVER (PARTITION BY r, part), 1) AS p FROM h),
q AS (SELECT lang, part, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang, part) AS q FROM h JOIN b USING (r) JOIN langs USING (lang) WHERE n_words > 0 GROUP BY lang, part, k),
js AS (SELECT r, lang, part, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) / 2 ELSE 0 END), 0)) AS j FROM p JOIN q USING (part, k) GROUP BY r, lang, part),
near AS (SELECT r, min(worst) AS worst FROM (SELECT r, lang, max(j / CASE part WHEN 'classes' THEN {LIMITS["classes"]} ELSE {LIMITS["words"]} END) AS worst FROM js GROUP BY r, lang) GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND (coalesce(worst, 0) <= 1 OR coalesce(lang NOT IN (SELECT lang FROM langs), false)) AS kept FROM b LEFT JOIN near USING (r)
"""
