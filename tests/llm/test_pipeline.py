"""The pipeline's stages, each against a plain version on its own input."""

import re

import corpus_pipeline
import pytest
from fathomline.llm import decontaminate, pii, toxicity
from test_corpus_operators import components
from test_text_operators import hit_words

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{k}")
        seen[name] = (docs, docs := spark.read.parquet(f"file://{tmp_path}/{k}"))
    before, after = seen["toxicity"]
    model = toxicity.train(before, labels)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if model.score(r.text) < 0.5}
    before, after = seen["ngram_join"]
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c in components([(r.doc_id, r.text) for r in before.collect()]).values()})
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    counted = {r.doc_id: hit_words(r.text, items) for r in before.collect()}
    assert {r.doc_id for r in after.collect()} == {i for i, (n, hit, _) in counted.items() if not (hit and 20 * len(hit) >= n)}
    before, after = seen["pii"]
    wanted = {r.doc_id: pii.redact(r.text, pii.all_spans(r.text, pii.base_spans(r.text))) for r in before.collect()}
    assert {r.doc_id: r.text for r in after.collect()} == wanted and all(len(r.text) == r.n_chars for r in after.collect())
    assert not any(re.search(r"@mail\d\.example\.com", x) for x in wanted.values())
    before, after = seen["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    assert after.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").isEmpty()


def test_stage_names_and_entry():
    import __spark_entry__ as entry

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "pii", "packing"]
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in entry.queries() if re.match(r"op\d+_", k)} and "pipeline" in entry.queries()
    assert decontaminate.ORACLE == entry.oracle_sql()["op2_decontaminate"]


def test_a_stage_that_fails_leaves_no_files(spark, monkeypatch):
    from fathomline.llm.common import shared_folder

    def broken(spark, docs, sf_dir):
        raise ValueError("broken")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", lambda spark, docs, sf_dir: docs.limit(5)), ("second", broken), ("third", broken)])
    with pytest.raises(ValueError, match="broken"):
        corpus_pipeline.run(spark, SF)
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    left = [f.getPath().getName() for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    assert not [name for name in left if name.startswith("pipeline-")]
