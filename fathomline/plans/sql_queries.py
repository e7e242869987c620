"""Queries for stored SQL: bodies of any length, tables behind commas, column edges; and the same rows in DuckDB's SQL.

Bodies are made of the test tables' rows: documents as literals, customers as modules that name tables of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import columns, lineage, tsql
from .estate import ident, table
from .queries import query, values_sql

# Documents as literals, names, comments, and literals without an end -------------------------------------------

_DOUBLED = "replace(text, '''', '''''')"
_BODY = f"""CASE doc_id % 4 WHEN 0 THEN 'SELECT ''' || {_DOUBLED} || ''' AS t FROM log.leg EXEC log.sail 1'
 WHEN 1 THEN 'EXEC log.sail [' || replace(text, ']', ']]') || '] PRINT 2' WHEN 2 THEN 'PRINT 1 /*' || replace(text, '*/', '') || '*/ ; RETURN'
 ELSE 'EXEC log.sail PRINT ''' || {_DOUBLED} END"""
_BODIES = f"SELECT doc_id, text, {_BODY} AS body FROM documents WHERE text IS NOT NULL"


def _quoted(s, d) -> DataFrame:
    text = F.col("text")
    doubled = F.replace(text, F.lit("'"), F.lit("''"))
    body = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("SELECT '"), doubled, F.lit("' AS t FROM log.leg EXEC log.sail 1")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("EXEC log.sail ["), F.replace(text, F.lit("]"), F.lit("]]")), F.lit("] PRINT 2")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("PRINT 1 /*"), F.replace(text, F.lit("*/"), F.lit("")), F.lit("*/ ; RETURN")))
        .otherwise(F.concat(F.lit("EXEC log.sail PRINT '"), doubled))
    )
    return table(s, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("module"), body.alias("body"))


#: kind, and what follows the statement: its end counts from the end of the body. The first begins the body.
_CUTS = [(0, 0, "select", 16), (0, 1, "exec", 0), (1, 0, "exec", 8), (1, 1, "print", 0), (2, 0, "print", None), (2, 1, "return", 0), (3, 0, "exec", 0)]


@query(f"""WITH b AS ({_BODIES}), c AS ({values_sql(_CUTS, "m, i, kind, back")}),
 e AS (SELECT doc_id, body, i, kind, CASE WHEN back IS NULL THEN 7 ELSE length(body) - back END AS stop, CASE WHEN i = 0 THEN 0 WHEN kind = 'exec' THEN length(body) - 15 WHEN kind = 'print' THEN length(body) - 7 ELSE length(body) - 6 END AS begin FROM b JOIN c ON doc_id % 4 = m)
 SELECT doc_id AS module, CAST(i AS INTEGER) AS index, kind, CAST(begin AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", md5(substring(body, CAST(begin AS INTEGER) + 1, CAST(stop - begin AS INTEGER))) AS digest FROM e""")
def quoted_bodies(s, d):
    return tsql.statements(_quoted(s, d)).select("module", "index", "kind", "start", "end", F.md5("text").alias("digest"))


@query(f"SELECT doc_id AS module, 'parse_error' AS issue, 'no end of ' || substring('''' || {_DOUBLED}, 1, 200) AS message FROM documents WHERE text IS NOT NULL AND doc_id % 4 = 3")
def broken_bodies(s, d):
    return tsql.broken_modules(_quoted(s, d))


# Customers as modules ----------------------------------------------------------------------------------------------


def _of_customers(s, d, text: str, where: str = "true") -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return table(s, d, "customer").filter(where).select(F.concat(F.lit("m"), key).alias("module"), F.replace(F.lit(text), F.lit("{k}"), key).alias("body"))


def _expected(rows: list[tuple], names: str, texts: tuple[str, ...], where: str = "true") -> str:
    """Each row for each customer, with the customer's key in the named texts."""
    shown = ", ".join(f"replace({n}, '{{k}}', CAST(c_custkey AS VARCHAR)) AS {n}" if n in texts else f'{n} AS "{n}"' for n in names.split(", "))
    return f"SELECT 'm' || c_custkey AS module, {shown} FROM customer, ({values_sql(rows, names)}) WHERE {where}"


_COMMAS = "SELECT a, b FROM leg{k}, log.foot{k} f, [log].[hand {k}] AS h JOIN arm{k} ON f.id IN (h.id, 2), eye{k} WHERE EXISTS (SELECT 1 FROM ear{k}, jaw WITH (NOLOCK), lip) AND c IN (d, e) ORDER BY a, b DELETE f FROM foot{k} f, toe WHERE f.a = toe.b"
_COMMA_REFS = [(0, "read", x) for x in ("leg{k}", "log.foot{k}", "log.hand {k}", "arm{k}", "eye{k}", "ear{k}", "jaw", "lip")] + [(1, "read", "foot{k}"), (1, "read", "toe"), (1, "write", "foot{k}")]


@query(_expected(_COMMA_REFS, "index, ref, name", ("name",)))
def comma_reads(s, d):
    return tsql.module_references(_of_customers(s, d, _COMMAS))


_INSERT = (
    "INSERT INTO store.bale{k} (id, [total], note, day, w) SELECT DISTINCT TOP (5) l.id, SUM(l.price * b.rate) AS t, 'x', DATEDIFF(day, b.[from day], l.made), CAST(l.w AS int) FROM log.leg{k} l JOIN harbour.berth AS b ON b.id = l.id GROUP BY l.id, l.made "
    "INSERT store.tally WITH (TABLOCK) (id) SELECT id FROM #hold UNION ALL SELECT CASE WHEN k > 1 THEN k ELSE 0 END FROM log.foot{k} "
    "INSERT INTO store.few (id, b) SELECT id, a, x AS b FROM log.leg{k} INSERT INTO store.none (id) VALUES (1)"
)
_INSERTED = [
    (0, "store.bale{k}", "id", "log.leg{k}", "id", "passthrough"), (0, "store.bale{k}", "total", "log.leg{k}", "price", "aggregate"), (0, "store.bale{k}", "total", "harbour.berth", "rate", "aggregate"),
    (0, "store.bale{k}", "day", "harbour.berth", "from day", "expression"), (0, "store.bale{k}", "day", "log.leg{k}", "made", "expression"), (0, "store.bale{k}", "w", "log.leg{k}", "w", "expression"),
    (1, "store.tally", "id", "#hold", "id", "passthrough"), (1, "store.tally", "id", "log.foot{k}", "k", "expression"), (2, "store.few", "id", "log.leg{k}", "id", "passthrough"), (2, "store.few", "b", "log.leg{k}", "x", "passthrough"),
]
_EDGE = "statement, target, target_column, source, source_column, transform"
_SHOWN = ["module", *_EDGE.split(", ")]


@query(_expected(_INSERTED, _EDGE, ("target", "source")))
def insert_select_edges(s, d):
    return columns.column_edges(_of_customers(s, d, _INSERT))[0].select(*_SHOWN)


@query("SELECT 'm' || c_custkey AS module, CAST(2 AS INTEGER) AS statement, 'column_count_mismatch' AS issue, 'query has 3 output columns but the list has 2' AS message FROM customer")
def insert_select_issues(s, d):
    return columns.column_edges(_of_customers(s, d, _INSERT))[1]


_SETS = (
    "UPDATE l SET mast = b.h + 1, l.keel = CASE WHEN b.x > 1 THEN l.y ELSE (SELECT MAX(z) FROM sea) END, @v = 3, hull += 1 FROM log.leg{k} l, harbour.berth b WHERE l.id = b.id UPDATE store.bale{k} SET total = id, [odd name] = 2 "
    "MERGE INTO store.tally AS t USING log.leg{k} AS s ON t.id = s.id WHEN MATCHED THEN UPDATE SET n = s.n, m = t.m + COUNT(s.n) WHEN NOT MATCHED THEN INSERT (id, n) VALUES (s.id, s.n);"
)
_SET_EDGES = [
    (0, "log.leg{k}", "mast", "harbour.berth", "h", "expression"), (0, "log.leg{k}", "keel", "harbour.berth", "x", "aggregate"), (0, "log.leg{k}", "keel", "log.leg{k}", "y", "aggregate"),
    (1, "store.bale{k}", "total", "store.bale{k}", "id", "passthrough"), (2, "store.tally", "n", "log.leg{k}", "n", "passthrough"), (2, "store.tally", "m", "store.tally", "m", "aggregate"),
    (2, "store.tally", "m", "log.leg{k}", "n", "aggregate"), (2, "store.tally", "id", "log.leg{k}", "id", "passthrough"),
]


@query(_expected(_SET_EDGES, _EDGE, ("target", "source")))
def set_and_merge_edges(s, d):
    """Names that a sub-select adds (`z`) stay guesses among the statement's tables and are left out here."""
    return columns.column_edges(_of_customers(s, d, _SETS))[0].filter("NOT guess").select(*_SHOWN)


# INSERT without a list: customers are tables of two columns, or three where their key is even.


def _owned(s, d, text: str) -> DataFrame:
    """Modules of customers that write their own table: module, owner, db, body."""
    k = F.col("c_custkey").cast("string")
    return table(s, d, "customer").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("module"), ident("o", "c_custkey").alias("owner"), F.lit("shop").alias("db"), F.replace(F.lit(text), F.lit("{c}"), k).alias("body"))


def _catalog(s, d) -> tuple[DataFrame, DataFrame]:
    """Customers' tables `dbo.C<key>` (id, total, and note for even keys) and `log.leg` (id, w)."""
    k = F.col("c_custkey")
    own = table(s, d, "customer").select(ident("c", "c_custkey").alias("node"), F.lit("shop").alias("db"), F.lit("dbo").alias("schema"), F.concat(F.lit("C"), k.cast("string")).alias("name"), (k % 2 == 0).alias("even"))
    leg = s.createDataFrame([("leg", "shop", "log", "Leg", None), ("foot", "shop", "log", "foot", None)], "node string, db string, schema string, name string, even boolean")
    names = F.when(F.col("even"), F.array(*map(F.lit, ("Id", "total", "note")))).when(~F.col("even"), F.array(*map(F.lit, ("Id", "total")))).when(F.col("node") == "leg", F.array(*map(F.lit, ("id", "w")))).otherwise(F.array(*map(F.lit, ("id", "toes"))))
    objects = own.unionByName(leg)
    cols = objects.select("node", F.posexplode(names).alias("ordinal", "name")).select(F.concat_ws(".", "node", F.lower("name")).alias("column"), "node", "name", (F.col("ordinal") + 1).alias("ordinal"))
    return objects.drop("even"), cols


_OPEN = "INSERT dbo.c{c} SELECT l.id, SUM(l.w) AS total, l.n AS note FROM log.leg l"


def _opened(s, d):
    m = _owned(s, d, _OPEN)
    return columns.catalog_targets(columns.column_edges(m)[0], m, *_catalog(s, d))


@query("SELECT 'm' || c_custkey AS module, 'dbo.c' || c_custkey AS target, c AS target_column, x AS source_column FROM customer, (VALUES ('Id', 'id'), ('total', 'w'), ('note', 'n')) AS v(c, x) WHERE (c <> 'note' OR c_custkey % 2 = 0)")
def catalog_order_edges(s, d):
    return _opened(s, d)[0].select("module", "target", "target_column", "source_column")


@query("SELECT 'm' || c_custkey AS module, CAST(0 AS INTEGER) AS statement, 'column_count_mismatch' AS issue, 'query has 3 output columns but the object has 2' AS message FROM customer WHERE c_custkey % 2 = 1")
def catalog_order_issues(s, d):
    return _opened(s, d)[1]


_EXECS = "INSERT INTO dbo.c{c} EXEC log.unload 3 INSERT INTO store.two (a, [b b]) EXEC @r = log.unload"


@query("SELECT 'm' || c_custkey AS module, statement, replace(target, '{c}', CAST(c_custkey AS VARCHAR)) AS target, c AS target_column, 'log.unload' AS source, '*' AS source_column, 'pseudo' AS transform FROM customer, (VALUES (CAST(0 AS INTEGER), 'dbo.c{c}', 'Id'), (0, 'dbo.c{c}', 'total'), (0, 'dbo.c{c}', 'note'), (1, 'store.two', 'a'), (1, 'store.two', 'b b')) AS v(statement, target, c) WHERE c <> 'note' OR c_custkey % 2 = 0")
def insert_exec_edges(s, d):
    m = _owned(s, d, _EXECS)
    edges = columns.catalog_targets(columns.column_edges(m)[0], m, *_catalog(s, d))[0]
    return edges.select("module", "statement", "target", "target_column", "source", "source_column", "transform")


_TRIGGER = "INSERT INTO store.audit (id, w) SELECT i.id, d.w - i.w FROM inserted i JOIN deleted AS d ON d.id = i.id UPDATE t SET n = inserted.n FROM store.tally t, inserted"


@query("SELECT 'm' || c_custkey AS module, statement, target, c AS target_column, CASE WHEN c_custkey % 2 = 0 THEN 'log.leg' || c_custkey ELSE x END AS source, y AS source_column, CASE WHEN c_custkey % 2 = 0 THEN x END AS via FROM customer, (VALUES (CAST(0 AS INTEGER), 'store.audit', 'id', 'inserted', 'id'), (0, 'store.audit', 'w', 'deleted', 'w'), (0, 'store.audit', 'w', 'inserted', 'w'), (1, 'store.tally', 'n', 'inserted', 'n')) AS v(statement, target, c, x, y)")
def trigger_edges(s, d):
    """Modules with even keys are triggers."""
    m = _owned(s, d, _TRIGGER)
    parents = table(s, d, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("module"), F.concat(F.lit("log.leg"), F.col("c_custkey").cast("string")).alias("parent"))
    return columns.through_trigger_tables(columns.column_edges(m)[0], parents).select("module", "statement", "target", "target_column", "source", "source_column", "via")


_RESOLVE = "INSERT INTO dbo.c{c} (id, total) SELECT l.id, toes + l.w FROM log.leg l, log.foot INSERT INTO dbo.c{c} (id, total) SELECT x.id, l.other FROM elsewhere x, log.leg l INSERT INTO #hold (a, b) SELECT *, w FROM log.leg, log.foot UPDATE dbo.c{c} SET total = #hold.a FROM #hold"
_RESOLVED = [
    (0, "dbo.c{c}", "id", "log.leg", "id", "exact", "passthrough"), (0, "dbo.c{c}", "total", "log.foot", "toes", "inferred", "expression"), (0, "dbo.c{c}", "total", "log.leg", "w", "inferred", "expression"),
    (1, "dbo.c{c}", "id", "elsewhere", "id", "unresolved", "passthrough"), (1, "dbo.c{c}", "total", "log.leg", "other", "inferred", "passthrough"),
    (2, "#hold", "a", None, "*", "unresolved", "star"), (2, "#hold", "b", "log.leg", "w", "exact", "passthrough"), (3, "dbo.c{c}", "total", "#hold", "a", "inferred", "temp"),
]


def _resolved(s, d) -> DataFrame:
    m = _owned(s, d, _RESOLVE)
    return columns.resolved(columns.column_edges(m)[0], m, *_catalog(s, d))


@query(f"SELECT 'o:' || c_custkey AS owner, CAST(statement AS INTEGER) AS statement, replace(target, '{{c}}', CAST(c_custkey AS VARCHAR)) AS target, target_column, source, source_column, confidence, transform FROM customer, ({values_sql(_RESOLVED, 'statement, target, target_column, source, source_column, confidence, transform')})")
def resolved_columns(s, d):
    return _resolved(s, d).select("owner", "statement", "target", "target_column", "source", "source_column", "confidence", "transform")


@query("SELECT min('o:' || c_custkey) AS owner, CASE WHEN x THEN 'leg.id' END AS source_id, 'c:' || c_custkey || '.id' AS target_id, CASE WHEN x THEN 'exact' ELSE 'unresolved' END AS confidence FROM customer, (VALUES (true), (false)) AS v(x) GROUP BY c_custkey, x")
def columns_to_lineage(s, d):
    """From bodies to stored edges: those that fill a customer's `id`; of equal edges the smallest owner's stays."""
    objects, cols = _catalog(s, d)
    objects = objects.withColumn("kind", F.lit("table")).unionByName(table(s, d, "customer").select(ident("o", "c_custkey").alias("node"), F.lit("shop").alias("db"), F.lit("dbo").alias("schema"), ident("o", "c_custkey").alias("name"), F.lit("procedure").alias("kind")))
    stored = lineage.stored_lineage(_resolved(s, d), objects, cols.select("column", "node", "name"))
    return stored.edges.filter("target_id LIKE 'c:%.id'").select("owner", "source_id", "target_id", "confidence")
