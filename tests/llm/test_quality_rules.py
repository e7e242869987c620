"""Quality rules: reference languages from the data, clashing columns, colliding hashes."""

import pytest
from pyspark.sql import functions as F
from test_text_operators import BASE, ODD, SF, measured, odd  # noqa: F401

from fathomline.llm import quality_rules


def test_every_language_of_the_table_gets_a_reference(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    assert {lang: ws[0] for lang, ws in quality_rules.common_words(docs).items()} == {"en": "the", "fr": "de", "de": "der", "es": "de"}
    # The same prose in a language that nobody listed: its letters are moved on by one.
    moved = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "bcdefghijklmnopqrstuvwxyza")
    new = docs.filter("lang = 'en'").select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("xx").alias("lang"), moved.alias("text"))
    both = docs.unionByName(new)
    assert quality_rules.common_words(both)["xx"][0] == "uif"
    kept = {r.doc_id: r.kept for r in quality_rules.judge(both).select("doc_id", "kept").collect()}
    alone = {r.doc_id: r.kept for r in quality_rules.judge(docs).select("doc_id", "kept").collect()}
    english = [r.doc_id for r in docs.filter("lang = 'en'").select("doc_id").collect()]
    assert sum(kept[-d - 1] == alone[d] for d in english) > 0.97 * len(english)
    unlisted = quality_rules.judge(docs.unionByName(new.withColumn("lang", F.lit(None).cast("string")))).filter("doc_id < 0")
    assert unlisted.agg(F.avg(F.col("kept").cast("int"))).first()[0] < 0.2


def test_too_few_documents_make_no_reference(spark):
    docs = spark.createDataFrame([(k, "en", "the cat and the dog " * 20 + str(k)) for k in range(9)], "doc_id long, lang string, text string")
    assert quality_rules.common_words(docs) == {} and quality_rules.judge(docs).filter("js_words <> 0").isEmpty()
    assert quality_rules.common_words(docs, least_documents=9, common=2) == {"en": ["and", "cat"]}


def test_columns_of_any_name_stay(spark, odd):  # noqa: F811
    names = ["_t", "_ws", "_near", "t", "ws", "row", "again", "classes", "words", "near"]
    d = odd.withColumns({c: F.lit(f"{c} mine") for c in names}).withColumn("n_words", F.lit(-1))
    out = quality_rules.judge(d)
    assert set(out.columns) == {*d.columns, *quality_rules.BASE, "js_classes", "js_words", "kept"} - {"text"}
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r[c] == f"{c} mine" for r in rows for c in names) and all(r.n_words >= 0 for r in rows)


@pytest.mark.parametrize("places", [1 << 17, 1 << 62])
def test_windows_whose_hashes_collide(spark, monkeypatch, places):
    """With 62 bits for places all hashes are equal, so that unlike windows stand between equal ones."""
    texts = ["a b c x a b c y a b c", "q w e r t y q w e", "a b c d e f g", "a a a a", "b a b a b a b z b a b"]
    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(quality_rules, "_PLACES", places)
    assert {r.doc_id: tuple(r[c] for c in BASE) for r in quality_rules.base(d).collect()} == {i: measured(x) for i, x in enumerate(texts)}
