"""Steps that have to stay bounded for each task, whatever the tables' size."""

import re

import pytest
from pyspark.sql import functions as F

from fathomline.operators import columns, graph, lineage, stored_graph, tsql, variables
from fathomline.plans import queries, scope_queries, snapshot_queries, sql_queries
from fathomline.plans.estate import table
from fathomline.session import shared_folder


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_catalogs_of_the_closure_are_not_broadcast(spark):
    """Spark takes exploded rows for as few as their table has; what it broadcasts then fills the driver."""
    found = scope_queries._rules(spark, "/root/testdata/sf0.001")
    assert "BroadcastExchange" not in plan(found.edges) and "BroadcastExchange" not in plan(found.externals)


def test_only_the_class_that_a_cap_cuts_is_ranked(spark, tmp_path, monkeypatch):
    """A focus with 3 near and 60 far nodes, cut among the near ones: degrees are asked of those alone."""
    deps = [("f", f"a{k}", "parsed_write") for k in range(3)] + [(f"a{k % 3}", f"b{k}", "parsed_write") for k in range(60)] + [("a2", f"c{k}", "parsed_write") for k in range(5)]
    names = sorted({x for a, b, _ in deps for x in (a, b)})
    nodes = spark.createDataFrame([(n, "table", "dbo", "in_scope") for n in names], "node string, kind string, schema string, scope string")
    g = stored_graph.store(nodes, spark.createDataFrame([("+".join(d), *d) for d in deps], "id string, source string, target string, kind string"), f"file://{tmp_path}/g", buckets=4)
    asked, at = [], stored_graph.StoredGraph.at
    monkeypatch.setattr(stored_graph.StoredGraph, "at", lambda self, way, near, buckets: asked.append(near.count()) or at(self, way, near, buckets))
    found = stored_graph.ego(g, spark.createDataFrame([("f",)], "node string"), graph.Ego("down", 2, max_nodes=3))
    assert found.total == 69 and {r.node for r in found.hops.collect()} == {"f", "a2", "a0"}
    assert max(asked) == 3
    whole = stored_graph.ego(g, spark.createDataFrame([("f",)], "node string"), graph.Ego("down", 2, max_nodes=4))
    assert {r.node for r in whole.hops.collect()} == {"f", "a0", "a1", "a2"}


def test_bodies_are_dealt_before_they_become_rows(spark, monkeypatch):
    """One shuffle, of bodies, in parts of equal text: no task's token rows grow with the table."""
    bodies = spark.createDataFrame([(str(k), "WITH c AS (SELECT a FROM log.leg) SELECT a FROM c, log.foot") for k in range(40)], "module string, body string")
    monkeypatch.setattr(tsql, "PART_CHARS", 100)
    found = tsql.module_references(bodies)
    assert tsql.parts(bodies) == 24
    assert re.findall(r"Exchange (\w+)\(module#\d+, (\d+)\)", plan(found)) == [("hashpartitioning", "24")] and plan(found).count("Exchange") == 1
    assert found.rdd.getNumPartitions() == 24
    assert found.filter("name = 'log.foot'").count() == 40 and found.filter("name = 'c'").count() == 0


def test_variables_uses_are_written_once(spark, monkeypatch):
    """Each level of the fixpoint joined assignments that it made anew from all tokens."""
    wide, cut = [], variables.checkpoint
    monkeypatch.setattr(variables, "checkpoint", lambda df: wide.append(plan(df)) or cut(df))
    rows = spark.createDataFrame([("m", "SELECT @a = x FROM dbo.t SET @b = @a SET @c = @b RETURN @c")], "module string, body string")
    assert [r.source_column for r in variables.returned_edges(rows).collect()] == ["x"]
    levels = [p for p in wide if "since" in p and "LeftAnti" in p]
    assert len(levels) == 3 and not any("Window" in p for p in levels)


def test_rows_without_a_name_are_spread(spark):
    """All rows whose name is null went to one task, and so did all without a node where columns are looked up."""
    objects = spark.createDataFrame([("a", "shop", "dbo", "leg"), ("b", "shop", "dbo", "Leg"), (None, "shop", "dbo", "nil")], "node string, db string, schema string, name string")
    rows = spark.range(4000).select(F.lit("shop").alias("db"), F.when(F.col("id") < 2, "LEG").when(F.col("id") == 2, "nil").when(F.col("id") == 3, "a..").alias("name"), "id")
    for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(key, value)
    try:
        found = lineage.named_objects(rows, objects)
        assert max(r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.max("node")).collect()) < 2000  # without node no join
        assert found.columns == ["db", "name", "id", "node"]
        assert {tuple(r) for r in found.groupBy("name", "node").count().collect()} == {("LEG", "a", 2), ("nil", None, 1), ("a..", None, 1), (None, None, 3996)}
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(key)


def test_generated_methods_are_small_enough_to_compile(spark):
    """Java interprets methods of over 8000 bytes for good; two steps on token rows had 11202 and 14426."""
    bodies = spark.createDataFrame([("m", "SELECT a FROM log.leg")], "module string, body string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for found in (tsql.module_references(bodies), columns.column_edges(bodies)[0], variables.declared_tables(bodies), tsql.statements(bodies)):
            code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(found._jdf.queryExecution().executedPlan())
            assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_blanks_and_parts_of_names_are_no_rows(spark):
    rows = spark.createDataFrame([("m", "SELECT  [a b] . c , d.e.f /* x */ FROM\n dbo.t ;. u")], "module string, body string")
    found = tsql.runs(tsql.statement_tokens(tsql.name_tokens(rows))).orderBy("i")
    assert [(r.token, r.size) for r in found.collect()] == [("SELECT", 1), ("[a b].c", 3), (",", 1), ("d.e.f", 5), ("FROM", 1), ("dbo.t", 3)]


def test_few_tokens_bound_statements(spark):
    """All tokens went through all windows, though a few words decide where statements begin and end."""
    body = "  SELECT a , b , CASE WHEN c THEN d END FROM log.leg WHERE x = 1 ; ; EXEC  log.sail 1 , 2 /* no */  "
    rows = spark.createDataFrame([("m", body)], "module string, body string")
    assert [(r.kind, body[r.start : r.end]) for r in tsql.statements(rows).orderBy("index").collect()] == [("select", "SELECT a , b , CASE WHEN c THEN d END FROM log.leg WHERE x = 1"), ("exec", "EXEC  log.sail 1 , 2")]
    assert tsql.statement_tokens(tsql.tokens(rows), bounds=True).count() == 5  # SELECT, CASE, END, EXEC and the last


def test_sources_that_are_no_tables_are_spread(spark):
    """Edges without a known table went to one task where their columns are looked up; so did rows without a key where ids are never null."""
    for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(key, value)
    try:
        joins = re.findall(r"SortMergeJoin \[(.*)\], \[(.*)\], LeftOuter", plan(sql_queries._resolved(spark, "/root/testdata/sf0.001")))
        assert len(joins) == 2 and all(re.search(r"\b_v#", left) and re.search(r"\b_k#", right) for left, right in joins)
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(key)


def test_declarations_are_found_without_joins(spark, monkeypatch):
    """Edges of open lists met definitions in joins, in partitions that grew with the table, and bodies were cut into tokens several times."""
    body = "DECLARE @t TABLE (a int, b int) INSERT @t SELECT x, y FROM log.leg DECLARE @T TABLE (B int, c int, d int) INSERT @t SELECT y AS b, z FROM log.leg INSERT @late SELECT v FROM log.leg DECLARE @late TABLE (e int) INSERT @t EXEC log.unload INSERT dbo.u SELECT w FROM log.leg"
    bodies = spark.createDataFrame([(str(k), body) for k in range(20)], "module string, body string")
    monkeypatch.setattr(tsql, "PART_CHARS", 1000)
    edges, issues = variables.declared_edges(bodies)
    for found in (edges, issues):
        assert "Join" not in plan(found) and "regexp_extract_all" not in plan(found)
        assert set(re.findall(r"Exchange (\w+)\(([a-z_]+)#\d+(.*?)\)", plan(found))) == {("hashpartitioning", "module", f", {tsql.parts(bodies)}")}
    rows = edges.groupBy("statement", "target", "target_column", "source_column").count().collect()
    assert {tuple(r) for r in rows} == {(1, "@t", "a", "x", 20), (1, "@t", "b", "y", 20), (3, "@t", "B", "y", 20), (4, "@late", None, "v", 20), *((6, "@t", c, "*", 20) for c in "Bcd"), (7, "dbo.u", None, "w", 20)}
    assert {tuple(r) for r in issues.select("statement", "issue", "message").distinct().collect()} == {(3, "column_count_mismatch", "query has 2 output columns but the object has 3")} and issues.count() == 20


def test_columns_of_modules_are_grouped_in_parts(spark, monkeypatch):
    """What modules make went through all look-ups, and was grouped and numbered in partitions that grew with the table."""
    for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(key, value)
    try:
        monkeypatch.setattr(lineage, "PART_ROWS", 1000)
        made = snapshot_queries._made(spark, "/root/testdata/sf0.001")
        assert made.among == lineage.parts(table(spark, "/root/testdata/sf0.001", "lineitem")) > 3
        found = plan(made.columns)
        last = found.split("Exchange")[1]  # the top of the plan is its last step
        assert f"hashpartitioning(node#{re.search(r'node#([0-9]+)', last)[1]}, {2 * made.among})" in last and "Window" in found.split("Exchange")[0]
        of_results = plan(made.mentioned.filter("column_kind = 'resultset'"))
        assert set(re.findall(r"SortMergeJoin .*?(Left\w+|Inner)", of_results)) == {"LeftSemi"}  # of line items with orders
        assert made.columns.rdd.getNumPartitions() == 2 * made.among
        spread = lineage.stored_lineage(made.given, *snapshot_queries._made_catalog(spark, "/root/testdata/sf0.001")).columns  # as without known parts
        assert spread.exceptAll(made.columns).isEmpty() and made.columns.exceptAll(spread).isEmpty()
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(key)


def test_variables_are_joined_by_shuffles(spark, monkeypatch):
    """Spark took assignments, made of a small table of bodies, for few, and collected all of them on the driver to broadcast them at each level."""
    wide, cut = [], variables.checkpoint
    monkeypatch.setattr(variables, "checkpoint", lambda df: wide.append(plan(df)) or cut(df))
    rows = spark.createDataFrame([("m", "SELECT @a = x FROM dbo.t SET @b = @a SET @b = (SELECT y FROM dbo.u) RETURN @b")], "module string, body string")
    found = variables.returned_edges(rows)
    assert {r.source_column for r in found.collect()} == {"x", "y"}
    assert not any("Broadcast" in p for p in [*wide, plan(found)])


def test_token_rows_are_written_without_their_neighbours(spark, monkeypatch):
    """Rows of tokens were written uncompressed, with all that they say of the rows around them, and shuffled so."""
    cut, held = columns.written, []
    monkeypatch.setattr(columns, "written", lambda df: held.append(cut(df)) or held[-1])
    body = "INSERT dbo.u (a) SELECT w FROM log.leg"
    found = columns.statement_rows(spark.createDataFrame([("m", body)], "module string, body string"), columns.MARKS)
    assert [(r.name, r.before, r.after) for r in found.orderBy("i").collect()][:2] == [("INSERT", None, "dbo.u"), ("dbo.u", "INSERT", "(")]
    assert "FileScan parquet" in plan(held[0]) and not {"before", "after", "word1"} & set(held[0].columns)


def test_neighbourhoods_write_only_edges_they_meet(spark):
    """The first neighbourhood of a session stored all edges twice, and shuffled them five times for that."""
    top = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    held = lambda: {f.getPath().toString() for f in files.listStatus(top)}
    before = held()
    assert queries.ORACLES["ego_edges"] and queries.QUERIES["ego_edges"](spark, "/root/testdata/sf0.001").count() > 0
    assert (new := held() - before) and all("/rows-" in f for f in new)
    assert max(spark.read.parquet(f).count() for f in new) < table(spark, "/root/testdata/sf0.001", "lineitem").count() / 2


@pytest.mark.parametrize("few", [65_536, 1])
def test_graphs_without_a_store_are_those_of_all_edges(spark, monkeypatch, few):
    """few: also with more nodes than are broadcast; 64 bits let through some edges that aren't at them."""
    monkeypatch.setattr(stored_graph, "FEW", few)
    monkeypatch.setattr(stored_graph, "BITS", 64)
    deps = [(1, "f", "a", "parsed_write"), (2, "f", "a", "parsed_write"), (3, "a", "b", "parsed_write"), (4, "c", "a", "fk"), (5, "d", "a", "fk"), (6, "d", "e", "parsed_write"), (7, "d", "lost", "parsed_write"), (8, "lost", "f", "parsed_write"), (9, "b", "b", "fk")]
    deps += [(10 + k, f"x{k}", f"y{k}", "trigger") for k in range(200)]
    uses = spark.createDataFrame(deps, "id int, source string, target string, kind string")
    names = sorted({x for _, *ends, _ in deps for x in ends} - {"lost"})
    nodes = spark.createDataFrame([(n, "view" if n == "d" else "table", "dbo", "external" if n == "c" else "in_scope") for n in names], "node string, kind string, schema string, scope string")
    rows = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    for focus, options in (("f", {"depth": 3}), ("f", {"direction": "down", "depth": 3, "max_nodes": 3}), ("e", {"direction": "up", "external": False})):
        at = spark.createDataFrame([(focus,)], "node string")
        a, b = graph.ego_graph(nodes, graph.flow_edges(nodes, uses), at, graph.Ego(**options)), stored_graph.ego(stored_graph.LiveGraph(nodes, uses), at, graph.Ego(**options))
        assert a.total == b.total and all(rows(getattr(a, part)) == rows(getattr(b, part)) for part in ("reached", "hops", "edges", "more"))
    at = spark.createDataFrame([("lost",)], "node string")
    alone = stored_graph.ego(stored_graph.LiveGraph(nodes, uses), at, graph.Ego())
    assert rows(alone.reached) == [(0, "lost")] and rows(alone.more) == [(0, 0, "lost")] and alone.edges.isEmpty()
