"""Queries for the sources and the summaries of a snapshot, over the test tables, and the same rows in DuckDB's SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import improvement_measure
from ..operators import graph, lineage, overlay, summaries
from ..sources import catalog
from . import details, estate
from .estate import SQL, ident, table
from .queries import query

# The source's system tables: parts are objects, line items their columns, indexes and parameters, nations the types.
_CODE = "CASE p_size % 4 WHEN 0 THEN 'U' WHEN 1 THEN 'V' WHEN 2 THEN 'P' ELSE 'TF' END"
_SHIPPED = "p_partkey % 10 = 0"
_COLUMN_ID = "l_orderkey * 10 + l_linenumber"
_KEPT = ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
_ONE = f"SELECT l_orderkey, l_linenumber, {', '.join(f'min({c}) AS {c}' for c in _KEPT)} FROM lineitem GROUP BY l_orderkey, l_linenumber"
_LINES = f"SELECT *, {_COLUMN_ID} AS column_id FROM ({_ONE}) JOIN part ON p_partkey = l_partkey WHERE NOT ({_SHIPPED})"


def _one(s, d) -> DataFrame:
    """Line items, one for each number of an order."""
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in _KEPT))


def _objects(s, d) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("object_id"), F.concat(F.expr(_CODE), F.lit(" ")).alias("type"), F.expr(_SHIPPED).alias("is_ms_shipped"))


def _types(s, d) -> DataFrame:
    return table(s, d, "nation").select(F.col("n_nationkey").alias("user_type_id"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 5 == 0).alias("is_user_defined"), F.col("n_regionkey").alias("schema_id"))


def _lines(s, d) -> DataFrame:
    return _one(s, d).select(
        F.col("l_partkey").alias("object_id"), F.expr(_COLUMN_ID).alias("column_id"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("name"), (F.col("l_suppkey") % 25).cast("int").alias("user_type_id"), (F.col("l_orderkey") % 30).cast("int").alias("system_type_id"),
        F.col("l_quantity").cast("int").alias("max_length"), F.col("l_linenumber").alias("precision"), F.lit(0).alias("scale"), F.when(F.col("l_orderkey") % 4 == 0, F.col("l_orderkey")).otherwise(-1).alias("default_object_id"), "l_returnflag", "l_linenumber",
    )


@query(f"""SELECT l_partkey AS object_id, column_id, n.n_name AS type_name, m.n_name AS system_type_name, n.n_nationkey % 5 = 0 AS is_user_defined, CASE WHEN n.n_nationkey % 5 = 0 THEN n.n_name ELSE lower(n.n_name) END AS shown_type,
 CASE WHEN l_returnflag = 'R' THEN 'a + ' || l_linenumber END AS computed_definition, CASE WHEN l_returnflag = 'R' THEN l_linenumber = 1 END AS is_persisted, o_orderpriority AS default_name, CASE WHEN l_returnflag = 'A' THEN l_linenumber END AS seed_value
 FROM ({_LINES}) JOIN nation n ON n.n_nationkey = l_suppkey % 25 LEFT JOIN nation m ON m.n_nationkey = l_orderkey % 30 LEFT JOIN orders ON o_orderkey = l_orderkey AND l_orderkey % 4 = 0 WHERE p_size % 4 <> 2""")
def src_columns(s, d):
    lines = _lines(s, d)
    computed = lines.filter("l_returnflag = 'R'").select("object_id", "column_id", F.concat(F.lit("a + "), F.col("l_linenumber").cast("string")).alias("definition"), (F.col("l_linenumber") == 1).alias("is_persisted"))
    defaults = table(s, d, "orders").select(F.col("o_orderkey").alias("object_id"), F.col("o_orderpriority").alias("name"), F.lit("(0)").alias("definition"))
    identities = lines.filter("l_returnflag = 'A'").select("object_id", "column_id", F.col("l_linenumber").alias("seed_value"), F.lit(1).alias("increment_value"))
    out = catalog.columns(lines, _objects(s, d), _types(s, d), computed, defaults, identities)
    return out.select("object_id", "column_id", "type_name", "system_type_name", "is_user_defined", "shown_type", "computed_definition", "is_persisted", "default_name", "seed_value")


@query(f"SELECT l_partkey AS object_id, l_linenumber - 1 AS parameter_id, n_name AS type_name, l_linenumber = 1 AS is_return_value FROM ({_LINES}) JOIN nation ON n_nationkey = l_suppkey % 25")
def src_parameters(s, d):
    out = catalog.parameters(_lines(s, d).withColumn("parameter_id", F.col("l_linenumber") - 1), _objects(s, d), _types(s, d))
    return out.select("object_id", "parameter_id", "type_name", "is_return_value")


@query(f"SELECT l_partkey AS object_id, l_linenumber - 1 AS index_id, column_id, r_name AS data_space_name FROM ({_LINES}) LEFT JOIN region ON r_regionkey = l_suppkey % 7 WHERE l_linenumber > 1 AND p_size % 4 IN (0, 1)")
def src_indexes(s, d):
    rows = _one(s, d).select(F.col("l_partkey").alias("object_id"), (F.col("l_linenumber") - 1).alias("index_id"), F.expr(_COLUMN_ID).alias("column_id"), (F.col("l_suppkey") % 7).cast("int").alias("data_space_id"))
    spaces = table(s, d, "region").select(F.col("r_regionkey").alias("data_space_id"), F.col("r_name").alias("name"), F.lit("FG").alias("type"))
    return catalog.indexes(rows, _objects(s, d), spaces).select("object_id", "index_id", "column_id", "data_space_name")


@query(f"SELECT l_partkey AS object_id, l_linenumber - 1 AS index_id, column_id, 'c' || l_linenumber AS column_name FROM ({_LINES}) WHERE l_linenumber > 1 AND l_returnflag <> 'N'")
def src_index_columns(s, d):
    lines = _lines(s, d)
    rows = _one(s, d).filter("l_returnflag <> 'N'").select(F.col("l_partkey").alias("object_id"), (F.col("l_linenumber") - 1).alias("index_id"), F.expr(_COLUMN_ID).alias("column_id"))
    return catalog.index_columns(rows, _objects(s, d), lines)


@query("SELECT o_orderkey AS object_id, 'fk' AS source FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'check' FROM orders WHERE o_custkey % 3 <> 0")
def src_constraints(s, d):
    o = table(s, d, "orders")
    keys = catalog.foreign_keys(o.select(F.col("o_orderkey").alias("object_id"), (F.col("o_orderkey") % 3 == 0).alias("is_ms_shipped")))
    checks = catalog.check_constraints(o.select(F.col("o_orderkey").alias("object_id"), (F.col("o_custkey") % 3 == 0).alias("is_ms_shipped")))
    return keys.select("object_id", F.lit("fk").alias("source")).unionByName(checks.select("object_id", F.lit("check").alias("source")))


@query("SELECT l_linenumber AS class, l_partkey AS major_id, l_suppkey AS minor_id, 'MS_Description' AS name, l_returnflag AS value FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber IN (1, 2, 3, 7)")
def src_extended_properties(s, d):
    name = F.when(F.col("l_linestatus") == "O", "MS_Description").otherwise("note")
    return catalog.extended_properties(table(s, d, "lineitem").select(F.col("l_linenumber").alias("class"), F.col("l_partkey").alias("major_id"), F.col("l_suppkey").alias("minor_id"), name.alias("name"), F.col("l_returnflag").alias("value")))


@query(f"SELECT p_partkey AS object_id, p_name AS text, 'module' AS source FROM part WHERE NOT ({_SHIPPED}) UNION ALL SELECT s_suppkey, s_name, 'synonym' FROM supplier UNION ALL SELECT l_orderkey, l_returnflag, 'dependency' FROM lineitem WHERE l_linenumber = 1")
def src_modules_synonyms_dependencies(s, d):
    tagged = lambda rows, text, source: rows.select("object_id", F.col(text).alias("text"), F.lit(source).alias("source"))
    modules = catalog.modules(table(s, d, "part").select(F.col("p_partkey").alias("object_id"), F.col("p_name").alias("definition")), _objects(s, d))
    synonyms = catalog.synonyms(table(s, d, "supplier").select(F.col("s_suppkey").alias("object_id"), F.col("s_name").alias("name"), F.col("s_name").alias("base_object_name"), "s_acctbal"))
    named = catalog.dependencies(table(s, d, "lineitem").select(F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("referencing_class"), F.col("l_returnflag").alias("referenced_entity_name")))
    return reduce(DataFrame.unionByName, [tagged(modules, "definition", "module"), tagged(synonyms, "name", "synonym"), tagged(named, "referenced_entity_name", "dependency")])


@query("SELECT n_nationkey AS database_id, n_name AS name, true AS view_server_state, n_regionkey >= 0 AS view_database_state, false AS view_definition FROM nation WHERE lower(n_name) = (SELECT lower(min(n_name)) FROM nation)")
def src_database_and_permissions(s, d):
    n = table(s, d, "nation")
    first = n.agg(F.min("n_name")).first()[0]
    info = catalog.database_info(n.select(F.col("n_nationkey").alias("database_id"), F.col("n_name").alias("name"), F.lit("C").alias("collation_name"), F.lit(160).alias("compatibility_level"), F.lit("ONLINE").alias("state_desc"), F.lit(False).alias("is_read_only")), first.upper())
    granted = s.createDataFrame([("Ann", "view server state"), ("ann", "VIEW DATABASE STATE"), ("Bob", "VIEW DEFINITION")], "principal string, permission string")
    return info.select("database_id", "name").withColumn("_one", F.lit(1)).join(catalog.permissions(granted, "ANN").withColumn("_one", F.lit(1)), "_one").drop("_one")


# Summaries ------------------------------------------------------------------------------------------------------

_STATS = "SELECT 'p:' || l_partkey AS node, count(*) AS row_count, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS reserved_kb FROM lineitem GROUP BY l_partkey"
_EXECS = "SELECT 's:' || l_suppkey AS node, count(*) AS executions FROM lineitem GROUP BY l_suppkey"
_ISSUES = "SELECT 'c:' || c_custkey AS node, c_mktsegment AS issue FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 's:' || s_suppkey, 'unsupported' FROM supplier WHERE s_acctbal < 0"


def _stats(s, d) -> DataFrame:
    return table(s, d, "lineitem").groupBy(ident("p", "l_partkey").alias("node")).agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col("l_quantity").cast("long")).alias("reserved_kb"))


def _execs(s, d) -> DataFrame:
    return table(s, d, "lineitem").groupBy(ident("s", "l_suppkey").alias("node")).agg(F.count(F.lit(1)).alias("executions"))


def _issues(s, d) -> DataFrame:
    c = table(s, d, "customer").filter("c_acctbal < 0").select(ident("c", "c_custkey").alias("node"), F.col("c_mktsegment").alias("issue"))
    return c.unionByName(table(s, d, "supplier").filter("s_acctbal < 0").select(ident("s", "s_suppkey").alias("node"), F.lit("unsupported").alias("issue")))


@query(f"""WITH {SQL} SELECT count(DISTINCT CASE WHEN scope <> 'external' THEN db || '.' || schema END) AS schemas, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'view') AS views, count(*) FILTER (kind = 'procedure') AS procedures,
 count(*) FILTER (kind LIKE '%function' OR kind = 'inline_tvf') AS functions, count(*) FILTER (kind = 'trigger') AS triggers, count(*) FILTER (kind = 'synonym') AS synonyms, count(*) FILTER (kind = 'external') AS externals, count(*) FILTER (scope = 'cascaded') AS cascaded,
 (SELECT count(*) FROM region) AS databases, (SELECT count(*) FROM lineitem) AS columns, (SELECT count(*) FROM deps) AS edges_object, (SELECT count(*) FROM lineitem) AS edges_column, (SELECT count(*) FROM ({_ISSUES})) AS lineage_issues, (SELECT count(*) FROM nation) AS warnings FROM nodes""")
def scan_counts(s, d):
    line = table(s, d, "lineitem")
    return summaries.scan_counts(estate.objects(s, d), databases=table(s, d, "region"), columns=line, edges_object=estate.dependencies(s, d), edges_column=line, lineage_issues=_issues(s, d), warnings=table(s, d, "nation"))


@query(f"WITH {SQL} SELECT (SELECT count(*) FROM ({_ISSUES})) AS lineage_issues, (SELECT count(*) FROM part WHERE p_size % 3 = 0) AS unused_indexes, (SELECT count(*) FROM nation) AS missing_index_suggestions, count(*) FILTER (scope = 'external') AS external_refs FROM nodes")
def warnings_summary(s, d):
    return summaries.warnings_summary(estate.objects(s, d), _issues(s, d), table(s, d, "part").select((F.col("p_size") % 3 == 0).alias("is_unused")), table(s, d, "nation"))


@query(f"""WITH {SQL}, per AS (SELECT db, schema, kind, count(*) AS n FROM nodes WHERE scope <> 'external' GROUP BY db, schema, kind),
 each AS (SELECT db, schema, string_agg(kind || '=' || n, ';' ORDER BY kind) AS kinds FROM per GROUP BY db, schema)
 SELECT 'Shop' AS db, true AS is_configured, string_agg(schema || CASE WHEN schema = 'geo' THEN '*' ELSE '' END || '(' || kinds || ')', ',' ORDER BY schema) AS tree FROM each UNION ALL SELECT 'Empty', false, ''""")
def overview(s, d):
    databases = s.createDataFrame([("Shop", True, ["GEO"]), ("Empty", False, ["geo"])], "db string, is_configured boolean, selected array<string>")
    out = summaries.overview(estate.objects(s, d), databases)
    kinds = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ";")
    shown = F.transform("schemas", lambda x: F.concat(x["name"], F.when(x.is_selected, "*").otherwise(""), F.lit("("), kinds(x.counts_by_kind), F.lit(")")))
    return out.select("db", "is_configured", F.array_join(shown, ",").alias("tree"))


@query(f"WITH {SQL} SELECT (SELECT count(*) FROM nodes) AS objects, {', '.join(f'count(*) FILTER (kind = {k!r}) AS {k}' for k in graph.EDGE_KINDS)}, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS exact, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A') AS inferred, 0 AS unresolved, (SELECT count(DISTINCT node) FROM ({_ISSUES})) AS objects_with_issues FROM deps")
def lineage_totals(s, d):
    flag = F.col("l_returnflag")
    edges = table(s, d, "lineitem").select(F.when(flag == "R", "exact").when(flag == "A", "inferred").alias("confidence"))
    return summaries.lineage_summary(estate.objects(s, d), estate.dependencies(s, d), edges, _issues(s, d))


@query("SELECT 'o:' || l_orderkey AS node, count(*) AS columns FROM lineitem GROUP BY l_orderkey")
def column_totals(s, d):
    return summaries.column_totals(table(s, d, "lineitem").select(ident("o", "l_orderkey").alias("node")))


@query(f"WITH {SQL} SELECT nodes.*, row_count, executions, node IN (SELECT node FROM ({_ISSUES})) AS has_issues FROM nodes LEFT JOIN ({_STATS}) USING (node) LEFT JOIN ({_EXECS}) USING (node)", name="graph_nodes")
def graph_nodes(s, d):
    return summaries.graph_nodes(estate.objects(s, d), _stats(s, d), _execs(s, d), _issues(s, d)).select("node", "name", "kind", "schema", "scope", "db", "row_count", "executions", "has_issues")


@query(f"WITH {SQL} SELECT node, issue, db, schema, name, kind AS object_kind FROM ({_ISSUES}) JOIN nodes USING (node)")
def issue_list(s, d):
    return summaries.issue_list(estate.objects(s, d), _issues(s, d)).select("node", "issue", "db", "schema", "name", "object_kind")


def _grid(name: str, sorts: dict[str, str], sort: str, descending: bool, column: str):
    order = f"{column} {'DESC' if descending else 'ASC'} NULLS LAST"

    @query(f"WITH {SQL} SELECT node, name, row_count, count(*) OVER () AS total FROM (SELECT node, row_count, reserved_kb FROM ({_STATS}) WHERE row_count > 1) JOIN nodes USING (node) WHERE lower(schema) = 'supply' ORDER BY {order}, lower(schema), lower(name), node LIMIT 20 OFFSET 5", name=name)
    def grid(s, d):
        return summaries.grid(_stats(s, d).filter("row_count > 1"), estate.objects(s, d), sorts, sort=sort, descending=descending, limit=20, offset=5, schema="Supply").select("node", "name", "row_count", "total")


_grid("grid_tables_by_rows", summaries.TABLE_SORTS, "rows", True, "row_count")
_grid("grid_tables_by_name", summaries.TABLE_SORTS, "name", False, "lower(name)")
_grid("grid_tables_default", summaries.TABLE_SORTS, "no such key", True, "reserved_kb")


# Grids of the other statistics: one page for each sort name.

_RUNS = "SELECT 's:' || l_suppkey AS node, count(*) AS executions, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_elapsed, max(CAST(l_quantity AS BIGINT)) AS max_elapsed, CAST(floor(sum(CAST(l_quantity AS BIGINT)) / count(*)) AS BIGINT) AS avg_elapsed, CAST(sum(l_linenumber) AS BIGINT) AS total_cpu, CAST(sum(l_partkey) AS BIGINT) AS total_reads, max(l_shipdate) AS last_run FROM lineitem GROUP BY l_suppkey"
_USED = "SELECT 'p:' || l_partkey AS node, 'IX' || l_linenumber AS index_name, count(*) AS seeks, CAST(sum(l_suppkey) AS BIGINT) AS scans, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lookups, max(l_orderkey) AS updates FROM lineitem GROUP BY l_partkey, l_linenumber"
_LACKING = "SELECT 'c:' || o_custkey AS node, min(o_orderkey) AS handle, CAST(floor(sum(o_totalprice)) AS BIGINT) % 100 AS impact, count(*) AS seeks, max(o_orderkey) % 50 AS cost FROM orders GROUP BY o_custkey"


def _runs(s, d) -> DataFrame:
    """Line items as runs of their supplier's procedure."""
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("object_id"), F.lit(1).cast("long").alias("executions"), F.col("l_quantity").cast("long").alias("elapsed"), F.col("l_linenumber").cast("long").alias("cpu"), F.col("l_partkey").cast("long").alias("reads"), F.col("l_shipdate").alias("last_run"), F.col("l_shipdate").alias("cached"))
    return catalog.execution_stats(procedure=rows.filter("cpu > 2"), trigger=rows.filter("cpu <= 2")).withColumn("kind", F.lit("any"))


@query("SELECT l_suppkey AS object_id, CASE WHEN l_linenumber > 2 THEN 'procedure' ELSE 'trigger' END AS kind, count(*) AS executions, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_elapsed, CAST(floor(sum(CAST(l_quantity AS BIGINT)) / count(*)) AS BIGINT) AS avg_elapsed, CAST(sum(l_linenumber) AS BIGINT) AS total_cpu, CASE WHEN l_linenumber > 2 THEN CAST(sum(l_partkey) AS BIGINT) END AS total_reads FROM lineitem GROUP BY l_suppkey, l_linenumber > 2")
def src_execution_totals(s, d):
    """Two sources, of which one knows no reads."""
    rows = table(s, d, "lineitem").select("l_linenumber", F.col("l_suppkey").alias("object_id"), F.lit(1).cast("long").alias("executions"), F.col("l_quantity").cast("long").alias("elapsed"), F.col("l_linenumber").cast("long").alias("cpu"), F.col("l_partkey").cast("long").alias("reads"), F.col("l_shipdate").alias("last_run"), F.col("l_shipdate").alias("cached"))
    out = catalog.execution_stats(procedure=rows.filter("l_linenumber > 2"), trigger=rows.filter("l_linenumber <= 2").drop("reads"))
    return out.select("object_id", "kind", "executions", "total_elapsed", "avg_elapsed", "total_cpu", "total_reads")


def _all_sorts(stats: str, sorts: dict[str, str], spelled: dict[str, str], tie: str, ties: str) -> str:
    """A page of each sort name, descending; spelled: SQL for columns that the grid makes."""
    one = lambda name, c: f"(SELECT '{name}' AS sort, node, {tie} AS tie, count(*) OVER () AS total FROM ({stats}) JOIN nodes USING (node) ORDER BY {spelled.get(c, c)} DESC NULLS LAST, lower(schema), lower(name), node{ties} LIMIT 7 OFFSET 2)"
    return f"WITH {SQL} " + " UNION ALL ".join(one(name, c) for name, c in sorts.items())


def _pages(stats: DataFrame, objects: DataFrame, sorts: dict[str, str], tie: str, ties: tuple[str, ...] = ()) -> DataFrame:
    pages = [summaries.grid(stats, objects, sorts, sort=name, limit=7, offset=2, ties=ties).select(F.lit(name).alias("sort"), "node", F.col(tie).alias("tie"), "total") for name in sorts]
    return reduce(DataFrame.unionByName, pages)


@query(_all_sorts(_RUNS, summaries.PROC_SORTS, {"_name": "lower(name)"}, "executions", ""))
def grid_procs(s, d):
    runs = _runs(s, d).withColumn("node", ident("s", "object_id"))
    whole = runs.groupBy("node").agg(F.sum("executions").alias("executions"), F.sum("total_elapsed").alias("total_elapsed"), F.max("max_elapsed").alias("max_elapsed"), F.sum("total_cpu").alias("total_cpu"), F.sum("total_reads").alias("total_reads"), F.max("last_run").alias("last_run"))
    whole = whole.withColumn("avg_elapsed", F.floor(F.col("total_elapsed") / F.col("executions")))
    return _pages(whole, estate.objects(s, d), summaries.PROC_SORTS, "executions")


@query(_all_sorts(_USED, summaries.INDEX_SORTS, {"_name": "lower(name)", "_index": "lower(index_name)"}, "index_name", ", index_name"))
def grid_indexes(s, d):
    used = table(s, d, "lineitem").groupBy(ident("p", "l_partkey").alias("node"), F.concat(F.lit("IX"), F.col("l_linenumber").cast("string")).alias("index_name")).agg(F.count(F.lit(1)).alias("seeks"), F.sum("l_suppkey").alias("scans"), F.sum(F.col("l_quantity").cast("long")).alias("lookups"), F.max("l_orderkey").alias("updates"))
    return _pages(used, estate.objects(s, d), summaries.INDEX_SORTS, "index_name", ("index_name",))


@query(_all_sorts(f"SELECT *, cost * impact * seeks AS improvement FROM ({_LACKING})", summaries.MISSING_SORTS, {"_name": "lower(name)"}, "handle", ", handle"))
def grid_missing_indexes(s, d):
    lacking = table(s, d, "orders").groupBy(ident("c", "o_custkey").alias("node")).agg(F.min("o_orderkey").alias("handle"), (F.floor(F.sum("o_totalprice")) % 100).alias("impact"), F.count(F.lit(1)).alias("seeks"), (F.max("o_orderkey") % 50).alias("cost"))
    lacking = lacking.withColumn("improvement", improvement_measure(F.col("cost"), F.col("impact"), F.col("seeks"), F.lit(0)))
    return _pages(lacking, estate.objects(s, d), summaries.MISSING_SORTS, "handle", ("handle",))


def _objects_by(sort: str, descending: bool, column: str):
    @query(f"WITH {SQL}, o AS (SELECT nodes.*, TIMESTAMP '2020-01-01' + INTERVAL (length(name) * 7 % 40) DAY AS modified FROM nodes) SELECT node, count(*) OVER () AS total FROM o LEFT JOIN ({_STATS}) USING (node) LEFT JOIN ({_EXECS}) USING (node) ORDER BY {column} {'DESC' if descending else 'ASC'} NULLS LAST, lower(schema), lower(name), node LIMIT 30", name=f"objects_by_{sort}")
    def objects_by(s, d):
        o = estate.objects(s, d).withColumn("modified", F.expr("timestampadd(DAY, length(name) * 7 % 40, TIMESTAMP_NTZ '2020-01-01')"))
        return summaries.object_page(o, _stats(s, d), _execs(s, d), sort=sort, descending=descending, limit=30).select("node", "total")


_objects_by("size", True, "reserved_kb")
_objects_by("execs", True, "executions")
_objects_by("modified", False, "modified")


@query(f"""WITH {SQL} SELECT 'uses' AS role, target AS other, deps.kind, name AS other_name FROM deps LEFT JOIN nodes ON node = target WHERE source = 's:3' UNION ALL SELECT 'used_by', source, deps.kind, name FROM deps JOIN nodes ON node = source WHERE target = 's:3' AND source <> 's:3' UNION ALL SELECT 'uses', 's:3', 'parsed_exec', name FROM nodes WHERE node = 's:3'""")
def uses_and_used_by(s, d):
    deps = estate.dependencies(s, d).unionByName(s.createDataFrame([("x", "s:3", "s:3", "parsed_exec"), ("y", "s:3", "s:3", "parsed_exec")], "id string, source string, target string, kind string"))
    deps = deps.withColumns({"resolution": F.lit("resolved"), "referenced_name": F.lit(None).cast("string")})
    return summaries.uses(estate.objects(s, d), deps, "s:3").select("role", "other", "kind", "other_name")


@query("SELECT 'c:' || c_custkey AS node, 'out' AS side, 'n:' || c_nationkey AS other, n_name AS other_name, 'fk' || c_custkey AS name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 2 = 0 UNION ALL SELECT 'n:' || c_nationkey, 'in', 'c:' || c_custkey, c_name, 'fk' || c_custkey FROM customer WHERE c_custkey % 2 = 0")
def foreign_key_sides(s, d):
    far = F.when(F.col("c_custkey") % 2 == 0, ident("n", "c_nationkey")).otherwise("n:none")
    keys = table(s, d, "customer").select(F.concat(F.lit("fk"), F.col("c_custkey").cast("string")).alias("name"), ident("c", "c_custkey").alias("parent"), far.alias("referenced"))
    return summaries.foreign_keys_of(estate.objects(s, d), keys)


@query("SELECT o_orderkey AS scan, CASE WHEN o_orderstatus <> 'P' THEN o_custkey * 1000 + 5 END AS duration_ms FROM orders")
def scan_durations(s, d):
    took = F.expr("timestampadd(MICROSECOND, o_custkey * 1000000 + 5999, started)")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("scan"), F.col("o_orderdate").cast("timestamp_ntz").alias("started"), "o_custkey", "o_orderstatus")
    return summaries.scans_newest_first(o.withColumn("finished", F.when(F.col("o_orderstatus") != "P", took))).select("scan", "duration_ms")


_PLANNED = "SELECT 'p:' || p_partkey AS node, ['trigger', 'table', 'view', 'procedure'][p_size % 4 + 1] AS kind, p_brand AS schema, p_name AS name, CASE WHEN p_partkey % 50 = 0 THEN 500001 ELSE 9 END AS n FROM part"


@query(f"SELECT node, CASE kind WHEN 'view' THEN 1 WHEN 'procedure' THEN 4 ELSE 5 END AS kind_place, row_number() OVER (PARTITION BY kind ORDER BY schema, name, node) AS n, CASE WHEN n > 500000 THEN 'skipped' ELSE 'pending' END AS status FROM ({_PLANNED}) WHERE kind <> 'table'")
def analysis_plan(s, d):
    kind = F.element_at(F.array(*map(F.lit, ("trigger", "table", "view", "procedure"))), (F.col("p_size") % 4 + 1).cast("int"))
    body = F.repeat(F.lit("x"), F.when(F.col("p_partkey") % 50 == 0, 500_001).otherwise(9))
    modules = table(s, d, "part").select(ident("p", "p_partkey").alias("node"), kind.alias("kind"), F.col("p_brand").alias("schema"), F.col("p_name").alias("name"), body.alias("definition"))
    return summaries.analysis_plan(modules).select("node", F.col("place.kind").alias("kind_place"), F.col("place.n").alias("n"), "status")


@query(f"WITH i AS ({_ISSUES}) SELECT 'c:' || c_custkey AS node, CASE WHEN c_custkey % 7 = 0 THEN 'failed' WHEN 'c:' || c_custkey IN (SELECT node FROM i) THEN 'partial' ELSE 'ok' END AS status FROM customer")
def module_status(s, d):
    return summaries.module_status(table(s, d, "customer").select(ident("c", "c_custkey").alias("node"), (F.col("c_custkey") % 7 == 0).alias("failed")), _issues(s, d))


@query("SELECT 'c:' || c_custkey AS node, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS catalog_description, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS user_description, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS description FROM customer")
def natural_description(s, d):
    c = table(s, d, "customer").withColumn("node", ident("c", "c_custkey"))
    return summaries.natural_description(c.select("node"), c.filter("c_custkey % 2 = 0").select("node", F.col("c_mktsegment").alias("value")), c.filter("c_custkey % 3 = 0").select("node", F.col("c_name").alias("description")))


@query("SELECT 'o:' || o AS node, name, c + CASE WHEN name = 'Extra' THEN 1 ELSE 2 END AS ordinal FROM (SELECT l_orderkey AS o, count(*) AS c FROM lineitem GROUP BY 1), (VALUES ('Extra'), ('rest')) t(name)")
def pseudo_columns(s, d):
    old = table(s, d, "lineitem").select(ident("o", "l_orderkey").alias("node"), F.concat(F.lit("C"), F.col("l_linenumber").cast("string")).alias("name"))
    new = old.select("node").distinct().select("node", F.explode(F.array(*map(F.lit, ("rest", "Extra", "extra")))).alias("name")).unionByName(old)
    return summaries.pseudo_columns(old, new)


@query("WITH e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) SELECT 's:' || s_suppkey AS object, (SELECT count(*) FROM e WHERE s = s_suppkey) AS more FROM supplier WHERE s_nationkey = 1")
def column_more(s, d):
    lines = table(s, d, "lineitem").select(ident("p", "l_partkey").alias("source"), ident("s", "l_suppkey").alias("target"))
    columns = table(s, d, "part").select(ident("p", "p_partkey").alias("column")).unionByName(table(s, d, "supplier").select(ident("s", "s_suppkey").alias("column"))).withColumn("object", F.col("column"))
    return summaries.column_more(columns, lines, table(s, d, "supplier").filter("s_nationkey = 1").select(ident("s", "s_suppkey").alias("object")))


@query("SELECT 'p:' || p_partkey AS column FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1) UNION ALL SELECT 's:' || s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 1)")
def participating(s, d):
    lines = table(s, d, "lineitem").filter("l_linenumber = 1").select(ident("p", "l_partkey").alias("source"), ident("s", "l_suppkey").alias("target"))
    columns = table(s, d, "part").select(ident("p", "p_partkey").alias("column")).unionByName(table(s, d, "supplier").select(ident("s", "s_suppkey").alias("column"))).unionByName(table(s, d, "nation").select(ident("n", "n_nationkey").alias("column")))
    return graph.participating(columns, lines)


@query("SELECT 'view' AS kind, 'Local|' || c_name AS key FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT 'view', 'Local|' || c_name FROM customer WHERE c_custkey % 2 = 0 AND c_custkey <> (SELECT min(c_custkey) FROM customer WHERE c_custkey % 2 = 0)")
def annotation_removed(s, d):
    c = table(s, d, "customer")
    rows = c.select(F.lit("view").alias("kind"), F.concat(F.lit("Local|"), "c_name").alias("key"))
    gone = c.filter("c_custkey % 2 = 0").orderBy("c_custkey").first()
    left, removed = overlay.removed(rows, "view", f"LOCAL|{gone.c_name}".upper())
    assert removed.first()[0]
    return left


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Local|' || c_name ELSE lower('Local|' || c_name) END AS key FROM customer")
def keys_spelled_as_in_the_catalog(s, d):
    key = F.concat(F.lit("Local|"), "c_name")
    return overlay.spelled_as_in(table(s, d, "customer").select(F.lower(key).alias("key")), table(s, d, "customer").filter("c_custkey % 2 = 0").select(key.alias("key")))


# Stored lineage: modules (orders) write suppliers' columns from customers' columns; every fifth target isn't known.
@query("""WITH e AS (SELECT DISTINCT o_orderkey AS o, o_custkey AS c, o_orderkey % 7 AS t FROM orders)
 SELECT 'o:' || o AS owner, CASE WHEN c % 3 <> 0 THEN 'c:' || c || '.A' END AS source_id, CASE WHEN c % 3 = 0 THEN 'sales.c' || c || '.z' END AS source_name, 's:' || t || '.B' AS target_id FROM e WHERE t IN (SELECT s_suppkey FROM supplier) AND t <> 5""")
def stored_column_edges(s, d):
    edges, objects, columns = _column_facts(s, d)
    return lineage.stored_edges(edges, objects, columns)[0].select("owner", "source_id", "source_name", "target_id")


@query("SELECT 'o:' || o_orderkey AS owner, 'dbo.S' || o_orderkey % 7 AS name, 'unresolved_ref' AS issue FROM orders WHERE o_orderkey % 7 = 5 OR o_orderkey % 7 NOT IN (SELECT s_suppkey FROM supplier)")
def stored_column_issues(s, d):
    edges, objects, columns = _column_facts(s, d)
    return lineage.stored_edges(edges, objects, columns)[1]


def _column_facts(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(s, d, "orders").withColumn("t", F.col("o_orderkey") % 7)
    edges = o.select(
        ident("o", "o_orderkey").alias("owner"), F.lit("shop").alias("db"), F.concat(F.lit("dbo.S"), F.col("t").cast("string")).alias("target"), F.lit("b").alias("target_column"), F.concat(F.lit("sales.c"), F.col("o_custkey").cast("string")).alias("source"),
        F.when(F.col("o_custkey") % 3 == 0, "z").otherwise("a").alias("source_column"), F.lit("exact").alias("confidence"), F.lit("passthrough").alias("transform"), F.col("o_orderkey").alias("statement"),
    )
    c, u = table(s, d, "customer"), table(s, d, "supplier").filter("s_suppkey <> 5")
    named = lambda rows, x, k, schema: rows.select(ident(x, k).alias("node"), F.lit("shop").alias("db"), F.lit(schema).alias("schema"), F.concat(F.lit(x), F.col(k).cast("string")).alias("name"))
    objects = named(c, "c", "c_custkey", "Sales").unionByName(named(u, "s", "s_suppkey", "dbo"))
    col = lambda rows, x, k, name: rows.select(F.concat(ident(x, k), F.lit(f".{name}")).alias("column"), ident(x, k).alias("node"), F.lit(name).alias("name"))
    return edges, objects, col(c, "c", "c_custkey", "A").unionByName(col(u, "s", "s_suppkey", "B"))


@query("SELECT DISTINCT 'o:' || l_orderkey || '.q' AS source, 'o:' || l_orderkey || '.total' AS target, 'inferred' AS confidence, 'computed' AS transform FROM lineitem WHERE l_linenumber = 1")
def computed_column_edges(s, d):
    one = table(s, d, "lineitem").filter("l_linenumber = 1").select(ident("o", "l_orderkey").alias("node")).distinct()
    column = lambda n: one.select("node", F.lit(n).alias("name"), F.concat("node", F.lit(f".{n}")).alias("column"))
    definitions = one.select("node", F.concat("node", F.lit(".total")).alias("column"), F.lit("([Q] * 2 + missing + [total])").alias("definition"))
    return lineage.computed_columns(definitions, column("q").unionByName(column("total")))


# Lineage with every kind of target: orders are modules (even ones scalar functions), their lines edges; the line's number says what kind.
_MADE = """WITH o AS (SELECT DISTINCT o_orderkey AS k, 'o:' || o_orderkey AS owner, o_orderkey % 2 = 0 AS fn FROM orders),
 l AS (SELECT DISTINCT l_linenumber AS n, l_partkey AS p, l_suppkey AS s, o.* FROM lineitem JOIN o ON l_orderkey = k)"""


@query(_MADE + """ SELECT DISTINCT owner, 'p:' || p AS source_node, 'p:' || p || '.a' AS source_id, NULL AS source_name, owner || '|#hold' AS target_node, owner || '|#hold|q' AS target_id, owner AS via_object FROM l WHERE n = 1
 UNION SELECT owner, owner || '|#hold', owner || '|#hold|q', NULL, 's:' || s, 's:' || s || '.b', owner FROM l WHERE n = 2
 UNION SELECT owner, owner || '|@seen', NULL, '*', owner, owner || '|#rs' || p % 2 || '|r', NULL FROM l WHERE n = 3
 UNION SELECT owner, NULL, NULL, 'lost.z', owner, owner || '|return_value', NULL FROM l WHERE n = 4 AND fn
 UNION SELECT owner, 'p:' || p, NULL, 'z', owner || '|@seen', owner || '|@seen|k', owner FROM l WHERE n = 5""")
def stored_lineage_edges(s, d):
    return _made(s, d).edges.select("owner", "source_node", "source_id", "source_name", "target_node", "target_id", "via_object")


@query(_MADE + " SELECT DISTINCT owner || '|#hold' AS node, CASE WHEN owner IN (SELECT owner FROM l WHERE n = 1) THEN '#Hold' ELSE '#hold' END AS name, 'temp_table' AS kind, owner AS parent, 'shop' AS db, 'dbo' AS schema FROM l WHERE n IN (1, 2) UNION ALL SELECT DISTINCT owner || '|@seen', '@seen', 'temp_table', owner, 'shop', 'dbo' FROM l WHERE n IN (3, 5)")
def stored_pseudo_objects(s, d):
    return _made(s, d).objects


@query(_MADE + """ SELECT DISTINCT owner || '|#hold' AS node, CASE WHEN owner IN (SELECT owner FROM l WHERE n = 1) THEN 'q' ELSE 'Q' END AS name, 'column' AS column_kind, NULL::INT AS resultset, owner || '|#hold|q' AS column, 1 AS ordinal FROM l WHERE n IN (1, 2)
 UNION ALL SELECT DISTINCT owner || '|@seen', 'k', 'column', NULL::INT, owner || '|@seen|k', 1 FROM l WHERE n = 5
 UNION ALL SELECT DISTINCT owner, 'r', 'resultset', (p % 2)::INT, owner || '|#rs' || p % 2 || '|r', 1 FROM l WHERE n = 3
 UNION ALL SELECT DISTINCT owner, 'RETURN_VALUE', 'return_value', NULL::INT, owner || '|return_value', 1 FROM l WHERE n = 4 AND fn""")
def stored_pseudo_columns(s, d):
    return _made(s, d).columns


@query(_MADE + " SELECT owner, 'gone.T' || s AS name, 6 AS statement, 'unresolved_ref' AS issue FROM l WHERE n > 5 GROUP BY owner, s")
def stored_lineage_issues(s, d):
    return _made(s, d).issues


def _made(s, d) -> lineage.Stored:
    n, text = F.col("l_linenumber"), lambda start, k: F.concat(F.lit(start), F.col(k).cast("string"))
    by = lambda *rows: F.element_at(F.array(*(r if isinstance(r, Column) else F.lit(r) for r in rows)), F.least(n, F.lit(6)).cast("int"))
    lines = table(s, d, "lineitem")
    among = lineage.parts(lines)
    line = lines.repartition(among, "l_orderkey").join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).repartition(among, "l_orderkey"), "l_orderkey", "left_semi")
    part, supplier = text("sales.p", "l_partkey"), text("dbo.s", "l_suppkey")
    edges = line.select(
        ident("o", "l_orderkey").alias("owner"), F.lit("shop").alias("db"), by("temp", "table", "resultset", "self", "tablevar", "table").alias("target_kind"), by("#Hold", supplier, None, None, "@seen", text("gone.T", "l_suppkey")).alias("target"),
        by("q", "b", "r", "RETURN_VALUE", "k", "a").alias("target_column"), F.when(n == 3, F.col("l_partkey") % 2).cast("int").alias("resultset"), by(part, "#hold", "@seen", "lost", part, part).alias("source"), by("A", "Q", "*", "z", "z", "a").alias("source_column"),
        F.lit("exact").alias("confidence"), F.lit("passthrough").alias("transform"), F.least(n, F.lit(6)).cast("int").alias("statement"),
    )
    return lineage.stored_lineage(edges, *_made_catalog(s, d), among)


def _made_catalog(s, d) -> tuple[DataFrame, DataFrame]:
    p, u, o = table(s, d, "part"), table(s, d, "supplier"), table(s, d, "orders")
    named = lambda rows, x, k, schema, kind: rows.select(ident(x, k).alias("node"), F.lit("shop").alias("db"), F.lit(schema).alias("schema"), F.concat(F.lit(x), F.col(k).cast("string")).alias("name"), kind.alias("kind"))
    modules = named(o, "o", "o_orderkey", "dbo", F.when(F.col("o_orderkey") % 2 == 0, "scalar_function").otherwise("procedure"))
    objects = named(p, "p", "p_partkey", "Sales", F.lit("table")).unionByName(named(u, "s", "s_suppkey", "dbo", F.lit("table"))).unionByName(modules)
    col = lambda rows, x, k, name: rows.select(F.concat(ident(x, k), F.lit(f".{name}")).alias("column"), ident(x, k).alias("node"), F.lit(name).alias("name"))
    return objects, col(p, "p", "p_partkey", "a").unionByName(col(u, "s", "s_suppkey", "b"))


# All parts of all customers and suppliers, each part as one text.

_PARTS = {
    "columns": "SELECT 's:' || l_suppkey AS node, 'c' || l_orderkey || '.' || l_linenumber AS text FROM lineitem",
    "parameters": "SELECT 'c:' || o_custkey AS node, '@p' || o_orderkey AS text FROM orders WHERE o_orderstatus = 'F'",
    "indexes": "SELECT 's:' || l_suppkey AS node, 'IX' || l_partkey AS text FROM lineitem WHERE l_linenumber = 1",
    "index_usage": "SELECT 's:' || l_suppkey AS node, l_linenumber || '=' || count(*) AS text FROM lineitem GROUP BY l_suppkey, l_linenumber",
    "keys_out": "SELECT 'c:' || c_custkey AS node, 'n:' || c_nationkey AS text FROM customer UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier",
    "keys_in": "SELECT 'c:' || o_custkey AS node, 'o:' || o_orderkey AS text FROM orders",
    "checks": "SELECT 'c:' || c_custkey AS node, 'balance > 0' AS text FROM customer WHERE c_acctbal > 0",
    "triggers": "SELECT 'c:' || o_custkey AS node, 'after ' || o_orderpriority AS text FROM orders WHERE o_orderkey % 2 = 0",
    "uses": "SELECT DISTINCT 's:' || l_suppkey AS node, 'p:' || l_partkey AS text FROM lineitem",
    "used_by": "SELECT DISTINCT 's:' || l_suppkey AS node, 'o:' || l_orderkey AS text FROM lineitem",
    "statistics": "SELECT 's:' || l_suppkey AS node, 'rows ' || count(*) AS text FROM lineitem GROUP BY l_suppkey",
    "executions": "SELECT 'c:' || o_custkey AS node, 'runs ' || count(*) AS text FROM orders GROUP BY o_custkey",
    "missing": "SELECT 'c:' || o_custkey AS node, 'lacks ' || min(o_orderkey) AS text FROM orders GROUP BY o_custkey",
    "issues": "SELECT 'c:' || c_custkey AS node, c_mktsegment AS text FROM customer WHERE c_acctbal < 0",
    "annotations": "SELECT 's:' || s_suppkey AS node, 'see ' || s_name AS text FROM supplier WHERE s_suppkey % 2 = 0",
    "tags": "SELECT 'c:' || c_custkey AS node, lower(c_mktsegment) AS text FROM customer",
    "synonyms": "SELECT 's:' || s_suppkey AS node, 'syn' || s_suppkey AS text FROM supplier WHERE s_suppkey % 3 = 0",
    "lineage_in": "SELECT 's:' || l_suppkey AS node, 'p' || l_partkey || '.' || l_returnflag AS text FROM lineitem WHERE l_linenumber > 5",
    "properties": "SELECT 'c:' || c_custkey AS node, c_name AS text FROM customer WHERE c_custkey % 5 = 0",
}
_GATHERED = ", ".join(f"coalesce(string_agg(text, ';' ORDER BY text) FILTER (part = '{p}'), '') AS {p}" for p in _PARTS)


@query(f"WITH {SQL}, parts AS ({' UNION ALL '.join(f'SELECT node, text, {chr(39)}{p}{chr(39)} AS part FROM ({sql})' for p, sql in _PARTS.items())}) SELECT node, kind, {_GATHERED} FROM nodes LEFT JOIN parts USING (node) WHERE kind IN ('view', 'procedure') GROUP BY node, kind")
def object_parts(s, d):
    """The parts' own SQL means the same in both engines."""
    for t in ("lineitem", "orders", "customer", "supplier"):
        table(s, d, t).createOrReplaceTempView(f"_parts_{t}")
    named = lambda sql: reduce(lambda x, t: x.replace(f"FROM {t}", f"FROM _parts_{t}"), ("lineitem", "orders", "customer", "supplier"), sql)
    found = details.object_parts(estate.objects(s, d).filter("kind IN ('view', 'procedure')").select("node", "kind"), **{p: s.sql(named(sql)) for p, sql in _PARTS.items()})
    return found.select("node", "kind", *(F.array_join(F.transform(p, lambda x: x.text), ";").alias(p) for p in _PARTS))
