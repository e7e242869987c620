"""The learners' parts against plain versions, and what they take as input."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import SF

from fathomline.llm import toxicity
from fathomline.llm.common import sample


def test_risk_is_that_of_its_definition():
    rng = np.random.default_rng(0)
    zp, zu, prior = rng.normal(size=7), rng.normal(size=11), 0.3
    loss = lambda z, y: np.log(1 + np.exp(-y * z))
    on_positives = prior * np.mean([loss(z, 1) for z in zp])
    on_negatives = np.mean([loss(z, -1) for z in zu]) - prior * np.mean([loss(z, -1) for z in zp])
    assert toxicity.risk(zp, zu, prior) == pytest.approx((on_positives, on_negatives, on_positives + max(0, on_negatives)))
    assert toxicity.risk(zp + 9, zu - 9, 0.5)[1] < 0 < toxicity.risk(zp + 9, zu - 9, 0.5)[2]


@pytest.mark.parametrize("shift", [0, 6])
def test_slopes_are_those_of_the_risk(shift):
    rng = np.random.default_rng(1)
    zp, zu, prior = rng.normal(size=5) + shift, rng.normal(size=9) - shift, 0.4
    below = toxicity.risk(zp, zu, prior)[1] < 0
    assert below == (shift == 6)
    value = lambda p, u: -toxicity.risk(p, u, prior)[1] if below else sum(toxicity.risk(p, u, prior)[:2])
    gp, gu = toxicity.slopes(zp, zu, prior)
    step = 1e-6
    for i, g in enumerate(gp):
        e = np.eye(len(zp))[i] * step
        assert g == pytest.approx((value(zp + e, zu) - value(zp - e, zu)) / (2 * step), abs=1e-6)
    for i, g in enumerate(gu):
        e = np.eye(len(zu))[i] * step
        assert g == pytest.approx((value(zp, zu + e) - value(zp, zu - e)) / (2 * step), abs=1e-6)


def test_training_on_spark_is_the_fit_on_the_same_texts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    known = [r for r in labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).collect()]
    toxic = {r.doc_id for r in known if r.toxic == 1}
    texts = [r for r in docs.collect() if r.doc_id is not None and docs is not None]
    import zlib

    texts = [r for r in texts if zlib.crc32(str(r.doc_id).encode()) % 5]
    wanted = toxicity.fit_nnpu([r.text for r in texts if r.doc_id in toxic], [r.text for r in texts], len(toxic) / len(known))
    assert model.weights.keys() == wanted.weights.keys() and model.bias == pytest.approx(wanted.bias, rel=1e-4)
    assert all(model.weights[w] == pytest.approx(wanted.weights[w], rel=1e-3, abs=1e-4) for w in wanted.weights)


def test_clean_documents_keep_a_column_called_like_the_helper(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50).withColumns({"_toxicity": F.lit("mine"), "__toxicity": F.lit(1)})
    kept = toxicity.keep_clean(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept.columns == docs.columns and kept.filter("_toxicity <> 'mine'").isEmpty() and kept.count() > 0


def test_samples_are_bounded_and_the_same_on_every_run(spark):
    rows = spark.range(20000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", "cast(id AS string) AS text")
    first, again = ({(r.doc_id, r.text) for r in sample(x, ["doc_id", "text"], 500).collect()} for x in (rows, rows.repartition(7)))
    assert first == again and len(first) == 500
    assert 100 < sum(d == 7 for d, _ in first) < 240 and sample(rows, ["doc_id", "text"], 10**6).count() == 20000
