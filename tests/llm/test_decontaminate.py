"""Decontamination: clashing columns, ids that are null, both ways to verify, very common passages."""

import hashlib

import pytest
from pyspark.sql import functions as F
from test_text_operators import ODD, hit_words, odd  # noqa: F401

from fathomline.llm import decontaminate

WAYS = [{}, {"max_table": 0}]


@pytest.mark.parametrize("options", WAYS)
def test_columns_of_any_name_stay(spark, odd, options):  # noqa: F811
    names = ["window", "items", "anchor", "off", "_n", "_row", "_items", "_c", "_found", "_sent", "_key", "_salt", "_spans", "h", "n", "words", "Spans", "i", "x_0"]
    d = odd.drop("_n").withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in names})
    b = spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string")
    kept = decontaminate.clean(d, b, **options)
    assert kept.columns == d.columns and kept.filter("doc_id = 5").isEmpty() and kept.count() == len(ODD) - 2
    rest = decontaminate.without_spans(d, b, **options)
    assert rest.columns == d.columns and rest.count() == len(ODD) and {r.text for r in rest.filter("doc_id = 5").collect()} == {"  c"}
    for out in (kept, rest):
        assert all(r[c] == f"{c} of {r.doc_id or 'none'}" for r in out.collect() for c in names)
    assert decontaminate.hits(d, b, **options).count() == len(ODD)
    assert decontaminate.clean(odd, b, **options).columns == odd.columns


@pytest.mark.parametrize("options", WAYS)
def test_an_item_without_an_id_counts_and_the_digest_leaves_it_out(spark, options):
    d = spark.createDataFrame([(1, "A b c d"), (None, "a b")], "doc_id long, text string")
    found = decontaminate.hits(d, spark.createDataFrame([(None, "a b"), (None, "A B"), (7, "c d")], "item_id long, text string"), **options)
    assert {r.doc_id: (r["_n"], r["_items"]) for r in found.collect()} == {1: (4, ["7", None]), None: (2, [None])}
    out = {r.doc_id: r for r in decontaminate.query(d, spark.createDataFrame([(None, "a b"), (7, "c d")], "item_id long, text string")).collect()}
    assert (out[1].n_hit, out[1].n_items, out[1].items_sha256) == (4, 2, hashlib.sha256(b"7").hexdigest())
    assert (out[None].n_items, out[None].items_sha256, out[None].contaminated) == (1, hashlib.sha256(b"").hexdigest(), True)


@pytest.mark.parametrize("options", WAYS)
def test_long_texts_and_copies_by_brute_force(spark, options):
    passage = " ".join(f"p{k}" for k in range(20))
    items = [(1, passage), (2, "p3 p4 p5"), (3, "the the")]
    texts = [(k, f"x{k} {passage} y") for k in range(40)] + [(100, passage)] * 30 + [(200, "the " * 4000 + passage), (201, f"z {passage} " * 300)]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.hits(d, b, **options).withColumn("p", decontaminate._positions()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.doc_id < 200:
            n, hit, found = hit_words(r.text, items)
            assert (r["_n"], set(r.p), r["_items"]) == (n, hit, found)
    assert {r.doc_id: (len(r.p), r["_items"]) for r in rows if r.doc_id >= 200} == {200: (4020, ["1", "2", "3"]), 201: (6000, ["1", "2"])}
