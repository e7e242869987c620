import datetime

import pytest
from pyspark.sql import functions as F

from fathomline.functions import scalar
from fathomline.operators import lineage, tsql
from fathomline.sources import catalog, config
from fathomline.sources.store import Store
from fathomline.streaming import snapshots


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_index_ddl(spark):
    c = scalar.suggested_index(F.lit("Sales"), F.lit("T"), F.lit("[a], [b]"), F.lit(None).cast("string"), F.lit("[c]"))
    assert one(spark, c) == "CREATE INDEX [IX_T_a_b] ON [Sales].[T] ([a], [b]) INCLUDE ([c]);"


@pytest.mark.parametrize(("low", "high", "wanted"), [("NONE", "NONE", "NONE"), ("NONE", "PAGE", "MIXED"), (None, None, None)])
def test_compression(spark, low, high, wanted):
    assert one(spark, scalar.compression(F.lit(low).cast("string"), F.lit(high).cast("string"))) == wanted


def test_average_and_sizes(spark):
    assert one(spark, scalar.average(F.lit(4001), F.lit(4))) == 1000
    assert one(spark, scalar.average(F.lit(4), F.lit(0))) is None
    null = F.lit(None).cast("long")
    assert one(spark, scalar.total_size_kb(null, F.lit(3), null)) == 3 and one(spark, scalar.total_size_kb(null, null, null)) is None


def test_configuration():
    raw = {"connections": [{"name": "Local", "url": "${URL}", "databases": [{"name": "W", "schemas": ["Sales"]}]}]}
    assert config.connections(raw, {"URL": "jdbc:x"})["local"].selected() == [("W", "Sales")]
    with pytest.raises(KeyError):
        config.connections(raw, {})
    with pytest.raises(ValueError):
        config.connections({"connections": [*raw["connections"], {**raw["connections"][0], "name": "LOCAL"}]}, {"URL": ""})


def test_a_family_that_fails_gives_a_warning(spark):
    found, warnings = catalog.attempted(good=lambda: spark.range(1), bad=lambda: 1 / 0)
    assert list(found) == ["good"] and warnings == ["bad: ZeroDivisionError"]


def test_snapshots_are_written_followed_and_pruned(spark, tmp_path):
    store, now = Store(spark, f"file://{tmp_path}/store"), datetime.datetime(2026, 1, 1)
    for scan in (1, 2, 3):
        store.write(scan, "Local", now, now, {"objects": spark.range(scan).withColumnRenamed("id", "node")})
    assert store.scans().count() == 3 and store.read("objects", 2).count() == 2
    seen = []
    q = snapshots.follow(spark, f"file://{tmp_path}/store", "objects", "node long", lambda rows, _: seen.append(rows.count()), f"file://{tmp_path}/seen")
    q.awaitTermination()
    assert sum(seen) == 6
    assert store.prune(1, ["objects"]) in ([1, 2], [2, 1]) and [r.scan for r in store.scans().collect()] == [3]
    with store.single_flight("A"), pytest.raises(RuntimeError), store.single_flight("a"):
        pass


def test_statement_offsets_give_the_text(spark):
    body = "SET NOCOUNT ON\nSELECT a FROM t\nUPDATE t SET a = 1"
    rows = tsql.statements(spark.createDataFrame([("m", body), ("e", ""), ("n", None)], "module string, body string")).collect()
    assert len(rows) == 3 and all(body[r.start : r.end] == r.text for r in rows)


def test_edges_are_stored_by_name(spark):
    objects = spark.createDataFrame([("t", "W", "dbo", "T", "table"), ("v", "W", "Sales", "V", "view")], "node string, db string, schema string, name string, kind string")
    columns = spark.createDataFrame([("t.a", "t", "A"), ("v.a", "v", "A")], "column string, node string, name string")
    rows = [("v", "W", "sales.v", "a", "T", "a", "exact", "passthrough", 0), ("v", "W", "Sales.V", "A", "t", "A", "exact", "passthrough", 0), ("v", "W", "Sales.V", "a", "gone", "x", "unresolved", "passthrough", 0), ("v", "W", "nowhere", "a", "T", "a", "exact", "passthrough", 0), ("v", "W", "Sales.V", "zz", "T", "a", "exact", "passthrough", 0)]
    edges = spark.createDataFrame(rows, "owner string, db string, target string, target_column string, source string, source_column string, confidence string, transform string, statement int")
    kept, issues = lineage.stored_edges(edges, objects, columns)
    assert {(r.source_id, r.source_name, r.target_id) for r in kept.collect()} == {("t.a", None, "v.a"), (None, "gone.x", "v.a")} and kept.count() == 2
    assert [(r.owner, r.name) for r in issues.collect()] == [("v", "nowhere")]
    computed = lineage.computed_columns(spark.createDataFrame([("t", "t.b", "([A]*(2))")], "node string, column string, definition string"), columns)
    assert [(r.source, r.target) for r in computed.collect()] == [("t.a", "t.b")]


def test_lineage_of_every_target_kind(spark):
    objects = spark.createDataFrame([("t", "W", "dbo", "T", "table"), ("f", "W", "dbo", "F", "scalar_function"), ("v", "W", "Sales", "V", "view"), ("x", "W", "dbo", "X", "external")], "node string, db string, schema string, name string, kind string")
    columns = spark.createDataFrame([("t.a", "t", "A"), ("v.a", "v", "a")], "column string, node string, name string")
    rows = [
        ("v", "W", "self", None, "A", None, "T", "a", "exact", 0), ("v", "W", "self", None, "none", None, "T", "a", "exact", 0),
        ("f", "W", "self", None, "R", None, "#T", "b", "exact", 1), ("v", "W", "temp", "#T", "B", None, "T", "a", "exact", 1),
        ("v", "W", "temp", "#t", "b", None, "T", "a", "inferred", 1), ("v", "W", "table", "X", "a", None, "T", "a", "exact", 2),
        ("v", "W", "table", "x", "b", None, "T", "a", "exact", 1), ("v", "W", "resultset", None, "S", 1, None, "@v", "exact", 3),
        ("v", "W", "tablevar", "@r", None, None, "T", "a", "exact", 4), ("v", "W", "table", "t", "a", None, "X", "q", "exact", 5),
    ]
    edges = spark.createDataFrame(rows, "owner string, db string, target_kind string, target string, target_column string, resultset int, source string, source_column string, confidence string, statement int").withColumn("transform", F.lit("passthrough"))
    found = lineage.stored_lineage(edges, objects, columns)
    assert {(r.owner, r.source_node, r.source_id, r.source_name, r.target_id, r.via_object, r.confidence) for r in found.edges.collect()} == {
        ("v", "t", "t.a", None, "v.a", None, "exact"), ("f", "f|#t", "f|#t|b", None, "f|r", None, "exact"), ("v", "t", "t.a", None, "v|#t|b", "v", "exact"),
        ("v", None, None, "@v", "v|#rs1|s", None, "exact"), ("v", None, None, "X.q", "t.a", "v", "exact"),
    }
    assert {(r.node, r.name, r.parent) for r in found.objects.collect()} == {("f|#t", "#T", "f"), ("v|#t", "#T", "v")}
    assert {(r.column, r.name, r.column_kind, r.resultset, r.ordinal) for r in found.columns.collect()} == {("f|#t|b", "b", "column", None, 1), ("v|#t|b", "B", "column", None, 1), ("f|r", "R", "return_value", None, 1), ("v|#rs1|s", "S", "resultset", 1, 1)}
    assert [(r.owner, r.name, r.statement) for r in found.issues.collect()] == [("v", "x", 1)]
    none = lineage.stored_lineage(edges.limit(0), objects, columns)
    assert all(part.isEmpty() for part in none)
