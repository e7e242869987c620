import threading
import time

import pytest
from pyspark.sql import functions as F

from fathomline.operators import cascade, graph, stored_graph
from fathomline.plans import details, queries, scan
from fathomline.sources import schemas
from fathomline.sources.store import Store


def inputs(spark):
    objects = spark.createDataFrame([(o[4], *o[:4]) for o in queries._RULE_OBJECTS], "db string, object_id long, schema string, name string, kind string")
    deps = spark.createDataFrame([("Port", a, 0, *rest) for a, *rest in queries._RULE_DEPS], "db string, referencing_id long, referencing_minor_id int, referenced_id long, referenced_server_name string, referenced_database_name string, referenced_schema_name string, referenced_entity_name string, is_caller_dependent boolean, is_ambiguous boolean")
    none = spark.createDataFrame([], "db string, object_id long, parent_id long")
    required = {"objects": objects, "dependencies": deps, "foreign_keys": spark.createDataFrame([], "db string, parent_object_id long, referenced_object_id long"), "triggers": none, "synonyms": spark.createDataFrame([], "db string, object_id long, base_object_name string")}
    return required, spark.createDataFrame([("Port", "Deck"), ("Sea", "dbo")], "db string, schema string")


def test_a_scan_is_stored_with_its_warnings(spark, tmp_path):
    required, selected = inputs(spark)
    late = F.udf(lambda i: 1 // 0, "long")  # fails only once it is written
    stats = {"table_stats": lambda: spark.createDataFrame([("Port", 14, 10), ("Port", 18, 20)], "db string, object_id long, row_count long"), "proc_stats": lambda: 1 / 0, "index_usage": lambda: spark.createDataFrame([("Port", 14)], "db string, object_id long").withColumn("seeks", late("object_id"))}
    store, progress = Store(spark, f"file://{tmp_path}"), scan.Progress()
    warnings = scan.scan(store, 1, "Local", required, stats, selected, progress, server_name="harbourmaster")
    assert warnings[0] == "proc_stats: ZeroDivisionError" and warnings[1].startswith("index_usage: ") and len(warnings) == 2
    rows = {r.object_key: r.scope for r in store.read("objects", 1).collect()}
    assert rows["Local|Port|deck|Crane"] == "in_scope" and rows["Local|Sea|tide|Gauge"] == "cascaded" and rows["external|Lighthouse|Moon|dbo|Lamp"] == "external"
    assert [r.row_count for r in store.read("table_stats", 1).collect()] == [10]
    assert store.read("warnings", 1).count() == 2 and store.scans().first().status == "succeeded" and progress.phase == "finalize"
    assert all(store.read(t, 1).columns == [f.split()[0] for f in schemas.SCHEMAS[t].split(", ")] for t in ("objects", "dependencies", "externals", "table_stats"))


def test_a_scan_keeps_its_flow_edges_until_it_is_deleted(spark, tmp_path):
    required, selected = inputs(spark)
    store = Store(spark, f"file://{tmp_path}")
    with pytest.raises(LookupError):
        store.graph(4)
    scan.scan(store, 4, "Local", required, {}, selected, server_name="harbourmaster")
    ids = {r.object_key.rsplit("|", 1)[1]: r.id for r in store.read("objects", 4).collect()}
    made, again = store.graph(4), store.graph(4)
    assert (made.folder, made.buckets, made.rows) == (again.folder, again.buckets, again.rows)
    walked = stored_graph.ego(again, spark.createDataFrame([(ids["vBerths"],)], "node long"), graph.Ego("up", 1)).reached
    nodes = store.read("objects", 4).select(F.col("id").alias("node"), "kind", "schema", "scope")
    uses = store.read("dependencies", 4).select(F.monotonically_increasing_id().alias("id"), F.col("of_source").alias("source"), F.col("of_target").alias("target"), "kind")
    plain = graph.ego_graph(nodes, graph.flow_edges(nodes, uses), spark.createDataFrame([(ids["vBerths"],)], "node long"), graph.Ego("up", 1)).reached
    assert {tuple(r) for r in walked.collect()} == {tuple(r) for r in plain.collect()} and walked.count() > 2
    scan.scan(store, 5, "LOCAL", required, {}, selected, progress := scan.Progress(), server_name="harbourmaster")
    assert [(r.scans, r.latest) for r in details.info(store).collect()] == [(2, 5)]
    status = details.scan_status(store, 5, progress)
    assert (status["status"], status["phase"], status["tables"]) == ("succeeded", "finalize", len(scan.TABLES)) and details.scan_status(store, 6) is None
    defined = store.read("objects", 4).withColumn("definition", F.when(F.col("kind") == "view", F.concat(F.lit("AS "), "name")))
    assert [tuple(r) for r in details.definition(defined, "local|PORT|Deck|vberths").collect()] == [("Local|Port|deck|vBerths", "AS vBerths")]
    assert details.definition(defined, "local|port|deck|crane").isEmpty() and details.definition(defined, "odd").isEmpty()
    store.delete([4], list(scan.TABLES))
    with pytest.raises(LookupError):
        store.graph(4)
    assert not store._exists(made.folder)


def test_scans_that_fail_run_or_are_cancelled(spark, tmp_path):
    required, selected = inputs(spark)
    store = Store(spark, f"file://{tmp_path}")
    broken = required | {"dependencies": required["dependencies"].drop("is_ambiguous")}
    with pytest.raises(Exception):  # noqa: B017
        scan.scan(store, 1, "Local", broken, {}, selected)
    row = store.scans().first()
    assert (row.scan, row.status) == (1, "failed") and "is_ambiguous" in row.error and row.finished is not None

    def meanwhile():
        with pytest.raises(RuntimeError):
            scan.scan(store, 3, "LOCAL", required, {}, selected)
        with pytest.raises(RuntimeError):
            store.delete([2], ["objects"])
        assert {r.scan: r.status for r in store.scans().collect()} == {1: "failed", 2: "running"}
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        scan.scan(store, 2, "Local", required, {"table_stats": meanwhile}, selected)
    assert {r.scan: r.status for r in store.scans().collect()} == {1: "failed", 2: "cancelled"}
    store.delete([1, 2], ["objects"])
    assert store.scans().isEmpty()


def test_the_jobs_of_a_scan_carry_the_tag_that_cancel_interrupts(spark, tmp_path):
    required, selected = inputs(spark)
    store, seen = Store(spark, f"file://{tmp_path}"), []
    scan.scan(store, 7, "Local", required, {"table_stats": lambda: seen.append(spark.getTags()) or 1 / 0}, selected)
    assert seen == [{"scan-7"}] and "scan-7" not in spark.getTags() and not scan.cancel(store, 7)


def test_a_scan_that_waits_in_a_python_worker_is_counted_and_cancelled(spark, tmp_path):
    required, selected = inputs(spark)
    store, progress, seen = Store(spark, f"file://{tmp_path}"), scan.Progress(), []

    def sleeps(i):
        time.sleep(120)
        return i

    def other():
        for _ in range(600):
            counts = progress.counts(store, 9)
            if progress.phase == "stats" and counts["active"]:
                seen.append((counts, progress.tables))
                return scan.cancel(store, 9)
            time.sleep(0.1)

    watcher = threading.Thread(target=other)
    watcher.start()
    began = time.time()
    with pytest.raises(Exception):  # noqa: B017
        scan.scan(store, 9, "Local", required, {"table_stats": lambda: spark.createDataFrame([("Port", 14)], "db string, object_id long").withColumn("row_count", F.udf(sleeps, "long")("object_id"))}, selected, progress)
    watcher.join()
    assert time.time() - began < 100 and store.scans().first().status == "cancelled"
    counts, tables = seen[0]
    assert counts["jobs"] > 1 and counts["tasks"] >= counts["done"] + counts["active"] > 0 and tables >= 3 and "objects written" in progress.log
    for _ in range(100):  # nothing of it runs on
        if not progress.counts(store, 9)["active"]:
            break
        time.sleep(0.1)
    assert progress.counts(store, 9)["active"] == 0 and "scan-9" not in spark.getTags()


def test_closure_options(spark):
    objects = spark.createDataFrame([("Farm", 1, "Field", "Hay", "table"), ("Farm", 2, "Field", "onHay", "trigger"), ("Farm", 3, "Barn", "Cow", "table"), ("Farm", 4, "Barn", "onCow", "trigger")], "db string, object_id long, schema string, name string, kind string")
    deps = spark.createDataFrame([], "db string, referencing_id long, referencing_minor_id int, referenced_id long, referenced_server_name string, referenced_database_name string, referenced_schema_name string, referenced_entity_name string, is_caller_dependent boolean, is_ambiguous boolean")
    fks = spark.createDataFrame([("Farm", 1, 3), ("Farm", 1, 1)], "db string, parent_object_id long, referenced_object_id long")
    triggers = spark.createDataFrame([("Farm", 2, 1), ("Farm", 4, 3)], "db string, object_id long, parent_id long")
    synonyms = spark.createDataFrame([], "db string, object_id long, base_object_name string")
    selected = spark.createDataFrame([("Farm", "Field")], "db string, schema string")

    def run(**options):
        c = cascade.compute_closure(objects, deps, fks, triggers, synonyms, selected, **options)
        return {r.key: r.scope for r in c.scope.collect()}, {(r.source, r.target, r.kind) for r in c.edges.collect()}

    scope, edges = run()
    assert scope == {"farm#1": "in_scope", "farm#2": "in_scope", "farm#3": "cascaded", "farm#4": "cascaded"}
    assert edges == {("farm#1", "farm#3", "fk"), ("farm#1", "farm#1", "fk"), ("farm#2", "farm#1", "trigger"), ("farm#4", "farm#3", "trigger")}
    assert run(triggers_of_cascaded=False)[0] == {"farm#1": "in_scope", "farm#2": "in_scope", "farm#3": "cascaded"}
    assert run(follow_foreign_keys=False) == ({"farm#1": "in_scope", "farm#2": "in_scope"}, {("farm#2", "farm#1", "trigger")})
