"""Bodies with very long tokens, bodies that can't be told apart, dense ids, and sources over JDBC."""

import pytest
from pyspark.sql import functions as F

from fathomline.functions.scalar import multipart
from fathomline.operators import columns, keys, tsql, variables
from fathomline.plans import details
from fathomline.sources import catalog

MILLION = 1_000_000


def bodies(spark, rows):
    return spark.createDataFrame(rows, "module string, body string")


@pytest.mark.parametrize("name, token", [("literal", f"'{'x' * MILLION}'"), ("quotes", f"'{chr(39) * 2 * MILLION}'"), ("bracket", f"[{'n' * MILLION}]"), ("brackets", f"[{']]' * 300_000}]"), ("double", '"' + '""' * 300_000 + '"'), ("word", "w" * MILLION), ("unicode", "N'" + "é" * MILLION + "'")])
def test_a_token_of_any_length_stands_beside_others(spark, name, token):
    found = tsql.statements(bodies(spark, [("long", f"SELECT {token} FROM log.leg EXEC log.sail"), ("short", "PRINT 1 RETURN")])).select("module", "index", "kind", F.length("text").alias("n")).collect()
    assert sorted((r.module, r["index"], r.kind) for r in found) == [("long", 0, "select"), ("long", 1, "exec"), ("short", 0, "print"), ("short", 1, "return")]
    assert next(r.n for r in found if r.kind == "select") == len(f"SELECT {token} FROM log.leg")
    refs = tsql.module_references(bodies(spark, [("long", f"SELECT {token} FROM log.leg EXEC log.sail")]))
    assert {(r["index"], r.ref, r.name) for r in refs.collect()} == {(0, "read", "log.leg"), (1, "exec", "log.sail")}


def test_comments_and_blanks_of_any_length(spark):
    text = f"/*{'* ' * 300_000}*/ SELECT 1 --{'-' * MILLION}\n{' ' * MILLION}EXEC log.sail /*{'x' * MILLION}"
    assert [r.kind for r in tsql.statements(bodies(spark, [("m", text)])).orderBy("index").collect()] == ["select", "exec"]


def test_bodies_without_an_end_are_set_apart(spark):
    rows = [("a", "SELECT 'open EXEC x"), ("b", "  exec log.sail [never closed"), ("c", 'odd "name'), ("d", "SELECT 'it''s' EXEC log.sail"), ("e", "SELECT N'" + "q" * MILLION), ("f", None), ("g", ""), ("h", "UPDATE t SET a = ''''")]
    out = {(r.module, r["index"], r.kind, r.text) for r in tsql.statements(bodies(spark, rows)).collect()}
    assert {x for x in out if x[0] in "abc"} == {("a", 0, "select", rows[0][1]), ("b", 0, "exec", rows[1][1]), ("c", 0, "other", rows[2][1])}
    assert {x[:3] for x in out if x[0] in "defgh"} == {("d", 0, "select"), ("d", 1, "exec"), ("e", 0, "select"), ("h", 0, "update")}
    issues = {(r.module, r.issue): r.message for r in tsql.broken_modules(bodies(spark, rows)).collect()}
    assert set(issues) == {(m, "parse_error") for m in "abce"} and issues["a", "parse_error"] == "no end of 'open EXEC x" and len(issues["e", "parse_error"]) == 210
    assert {r.module for r in tsql.module_references(bodies(spark, rows)).collect()} == {"d", "h"}


def test_long_names_are_parsed(spark):
    row = spark.createDataFrame([(f"[{'a]]' * 100_000}].b",), ("x" * MILLION,), ("a.b.c.d.e",)], "n string").select(multipart(F.col("n")).alias("p")).collect()
    assert len(row[0].p.schema) == 200_000 and row[1].p.name == "x" * MILLION and row[2].p is None


def test_names_at_the_edges_of_lists(spark):
    text = "INSERT t (a) SELECT COUNT(DISTINCT x) FROM u WHERE y > 1; INSERT t (a, b) SELECT TOP 3 v.a, b = v.c FROM v ORDER BY d; UPDATE t SET a = 1; INSERT t (a) SELECT @v; INSERT t (a) SELECT u.* FROM u"
    edges, issues = columns.column_edges(bodies(spark, [("m", text), ("n", None), ("o", "INSERT"), ("p", "UPDATE SET"), ("q", "MERGE ("), ("r", "INSERT t SELECT")]))
    assert {(r.module, r.statement, r.target_column, r.source, r.source_column, r.transform) for r in edges.collect()} == {("m", 0, "a", "u", "x", "aggregate"), ("m", 1, "a", "v", "a", "passthrough"), ("m", 1, "b", "v", "c", "passthrough"), ("m", 4, "a", "u", "*", "passthrough")}
    assert issues.isEmpty()


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_dense_ids_do_not_depend_on_partitions(spark, parts):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(parts)
    out = keys.dense_ids(rows, "k").collect()
    assert sorted((r.k, r.id) for r in out) == [(k, k + 1) for k in range(1000)]
    assert keys.dense_ids(rows.limit(0), "k").isEmpty() and [r.id for r in keys.dense_ids(rows.limit(1), "k", first=5).collect()] == [5]


def test_look_ups(spark):
    ids = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, 1)], "id long, name string, n int")
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 1)], "name string, n int")
    on = [(F.col("name"), "name"), (F.col("n"), "n")]
    assert {(r.name, r.n, r.of) for r in keys.looked_up(rows, ids, on, "of").collect()} == {("a", 1, 1)}
    assert {(r.name, r.n, r.of) for r in keys.looked_up(rows, ids, on, "of", required=False).collect()} == {("a", 1, 1), ("b", 2, None), (None, 1, None)}


def test_a_jdbc_table_is_read_in_ranges_with_filters_pushed(spark):
    url = "jdbc:derby:memory:harbour;create=true"
    rows = spark.range(1, 101).select(F.col("id").cast("int").alias("K"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("NAME")).unionByName(spark.createDataFrame([(None, "none")], "K int, NAME string"))
    rows.coalesce(1).write.format("jdbc").options(url=url, dbtable="BERTH").mode("overwrite").save()
    found = catalog.jdbc_table(spark, url, "BERTH", "K", partitions=5)
    assert found.rdd.getNumPartitions() == 5 and max(len(p) for p in found.rdd.glom().collect()) <= 22 and found.count() == 101
    some = found.filter("K > 90").select("NAME")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(K,90)" in plan.replace(" ", "") and "ReadSchema: struct<NAME:string>" in plan and some.count() == 10
    assert catalog.jdbc_table(spark, url, "BERTH").rdd.getNumPartitions() == 1
    few = catalog.jdbc_table(spark, url, "(SELECT * FROM BERTH WHERE K <= 2) b", "K", partitions=50)
    assert few.rdd.getNumPartitions() == 2 and few.count() == 2
    assert catalog.jdbc_table(spark, url, "(SELECT * FROM BERTH WHERE K > 1000) b", "K").count() == 0


def test_a_family_that_is_refused_is_a_warning(spark):
    found, warnings = catalog.attempted(berths=lambda: catalog.jdbc_table(spark, "jdbc:derby:memory:harbour", "NO_SUCH_TABLE", "K"), rest=lambda: spark.range(1))
    assert list(found) == ["rest"] and len(warnings) == 1 and warnings[0].startswith("berths: ")


def test_parts_are_gathered_by_one_shuffle(spark):
    objects = spark.createDataFrame([("a", "x"), ("b", "y")], "node string, name string")
    parts = {f"p{k}": spark.createDataFrame([("a", k, "u"), ("a", 0, None), ("c", 1, "lost")], "node string, n int, node_name string") for k in range(19)}
    out = details.object_parts(objects, **parts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    rows = {r.node: r for r in out.collect()}
    assert set(rows) == {"a", "b"} and [(x.n, x.node_name) for x in rows["a"].p7] == [(0, None), (7, "u")] and rows["b"].p3 == []


def returned(spark, *bodies):
    rows = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "module string, body string")
    return {(r.module, r.source, r.source_column, r.transform) for r in variables.returned_edges(rows).collect()}


def test_variables_flow_forward_only_and_within_their_module(spark):
    found = returned(
        spark,
        "SET @b = @a SELECT @a = x FROM dbo.t RETURN @b",  # assigned too early
        "SELECT @a = x FROM dbo.t SET @b = @A SET @a = @b RETURN @a + @c",  # a cycle
        "RETURN @a",  # another module's name
        "SELECT @a = MIN(x) FROM dbo.t SET @b = (SELECT y FROM dbo.u WHERE z = @a) RETURN @b",
        None, "", "SELECT @a = 1 RETURN @a",
        "SELECT @a = x FROM dbo.t RETURN (SELECT w FROM dbo.v)",
        "SELECT @a = * FROM dbo.t SET @a = @a RETURN '@a'",
    )
    assert found == {("1", "dbo.t", "x", "expression"), ("3", "dbo.t", "x", "aggregate"), ("3", "dbo.u", "y", "expression"), ("7", "dbo.v", "w", "passthrough")}
    assert returned(spark) == set()


def test_declared_tables_of_odd_bodies(spark):
    rows = spark.createDataFrame([(1, "CREATE TABLE dbo.real (a int)"), (2, "DECLARE @t TABLE (a int) DECLARE @t TABLE (b int, a int)"), (3, None), (4, "DECLARE @t TABLE (")], "module int, body string")
    assert {(r.module, r.statement, r.name, r.ordinal, r.column) for r in variables.declared_tables(rows).collect()} == {(2, 0, "@t", 1, "a"), (2, 1, "@t", 1, "b"), (2, 1, "@t", 2, "a")}


def test_snippets_and_expressions_are_cut(spark):
    long = "x" * 3000
    rows = spark.createDataFrame([("m", f"EXEC ('{long}') INSERT INTO dbo.t (a) SELECT b + '{long}' FROM dbo.u")], "module string, body string")
    snippet = tsql.dynamic_sql(tsql.statements(rows)).first().snippet
    assert len(snippet) == 200 and snippet.startswith("EXEC ('xxx")
    expression = columns.column_edges(rows)[0].first().expression
    assert len(expression) == 2000 and expression.startswith("b + 'xxx")
