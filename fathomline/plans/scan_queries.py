"""Queries for a snapshot with ids: customers of every third key are selected, their nations and regions follow by foreign keys."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cascade import compute_closure
from ..session import shared_folder
from ..sources.store import Store
from . import scan, snapshot
from .estate import table
from .queries import query

_DB = "'shop' AS db"


def _objects(s, d) -> DataFrame:
    """All customers, nations, regions and suppliers; a customer's parent is its nation."""
    one = lambda t, k, n, letter, schema, parent: table(s, d, t).select(F.expr(_DB), (F.col(k) * 10 + n).cast("long").alias("object_id"), schema.alias("schema"), F.concat(F.lit(letter), F.col(k).cast("string")).alias("name"), F.lit("table").alias("kind"), parent.cast("long").alias("parent_object_id"))
    none = F.lit(None)
    parts = [
        one("customer", "c_custkey", 1, "c", F.when(F.col("c_custkey") % 3 == 0, "People").otherwise("other"), F.col("c_nationkey") * 10 + 2),
        one("nation", "n_nationkey", 2, "N", F.lit("geo"), none),
        one("region", "r_regionkey", 3, "r", F.lit("geo"), none),
        one("supplier", "s_suppkey", 4, "s", F.lit("supply"), none),
    ]
    return reduce(DataFrame.unionByName, parts)


def _keys(s, d) -> DataFrame:
    fk = lambda t, a, x, b, y: table(s, d, t).select(F.expr(_DB), (F.col(a) * 10 + 5 + x).cast("long").alias("object_id"), F.concat(F.lit("FK_"), F.col(a).cast("string")).alias("name"), (F.col(a) * 10 + x).cast("long").alias("parent_object_id"), (F.col(b) * 10 + y).cast("long").alias("referenced_object_id"), F.lit(False).alias("is_disabled"))
    return reduce(DataFrame.unionByName, [fk("customer", "c_custkey", 1, "c_nationkey", 2), fk("nation", "n_nationkey", 2, "n_regionkey", 3), fk("supplier", "s_suppkey", 4, "s_nationkey", 2)])


def _required(s, d) -> dict[str, DataFrame]:
    empty = lambda columns: s.createDataFrame([], f"db string, {columns}")
    deps = empty("referencing_id long, referencing_minor_id int, referenced_id long, referenced_server_name string, referenced_database_name string, referenced_schema_name string, referenced_entity_name string, is_caller_dependent boolean, is_ambiguous boolean")
    return {"objects": _objects(s, d), "dependencies": deps, "foreign_keys": _keys(s, d), "triggers": empty("object_id long, parent_id long"), "synonyms": empty("object_id long, base_object_name string")}


def _details(s, d) -> dict[str, DataFrame]:
    """Each object has two columns and an index on the first; line items' flags stand for checks of their suppliers' and customers' tables."""
    o = _objects(s, d)
    cols = o.select("db", "object_id", F.posexplode(F.array(F.lit("id"), F.lit("Name"))).alias("column_id", "name")).withColumn("column_id", F.col("column_id") + 1)
    index = o.select("db", "object_id", F.lit(1).alias("index_id"), F.concat(F.lit("IX_"), "name").alias("name"), F.lit(False).alias("is_primary_key"))
    keys = _keys(s, d)
    return {
        "databases": s.createDataFrame([("shop", 1)], "db string, database_id int"),
        "columns": cols, "parameters": cols.filter("column_id = 2").withColumnRenamed("column_id", "parameter_id"), "indexes": index,
        "index_columns": index.select("db", "object_id", "index_id", F.lit(1).alias("column_id"), F.lit("id").alias("column_name"), F.lit(1).alias("key_ordinal")),
        "foreign_keys": keys, "foreign_key_columns": keys.select("db", F.col("object_id").alias("constraint_object_id"), F.lit("id").alias("parent_column"), F.lit("id").alias("referenced_column"), F.lit(1).alias("ordinal")),
        "check_constraints": o.select("db", (F.col("object_id") + 5).alias("object_id"), F.concat(F.lit("CK_"), "name").alias("name"), F.col("object_id").alias("parent_object_id"), F.lit("(id > 0)").alias("definition")),
        "modules": o.filter("object_id % 10 = 2").select("db", "object_id", F.lit("SELECT 1").alias("definition")),
    }


def _usage(s, d) -> DataFrame:
    """Each order seeks its customer's index once."""
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("seeks")).select(F.expr(_DB), (F.col("o_custkey") * 10 + 1).cast("long").alias("object_id"), F.lit(1).alias("index_id"), "seeks")


def _keyed(s, d) -> dict[str, DataFrame]:
    required, details = _required(s, d), _details(s, d)
    closure = compute_closure(*required.values(), s.createDataFrame([("Shop", "PEOPLE")], "db string, schema string"))
    found = snapshot.objects("Local", required["objects"], closure, details.pop("modules"))
    return {"objects": found} | snapshot.keyed(details | {"index_usage": _usage(s, d)}, found, closure)


_IDS = """o AS (SELECT c_custkey * 10 + 1 AS oid, 'People' AS schema, 'c' || c_custkey AS name, c_nationkey * 10 + 2 AS parent FROM customer WHERE c_custkey % 3 = 0
 UNION ALL SELECT n_nationkey * 10 + 2, 'geo', 'N' || n_nationkey, NULL FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 3 = 0)
 UNION ALL SELECT r_regionkey * 10 + 3, 'geo', 'r' || r_regionkey, NULL FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 3 = 0))),
 ids AS (SELECT *, 'Local|shop|' || schema || '|' || name AS object_key, row_number() OVER (ORDER BY lower('Local|shop|' || schema || '|' || name)) AS id FROM o),
 fk AS (SELECT c_custkey * 10 + 1 AS a, c_nationkey * 10 + 2 AS b, 'FK_' || c_custkey AS name FROM customer UNION ALL SELECT n_nationkey * 10 + 2, n_regionkey * 10 + 3, 'FK_' || n_nationkey FROM nation)"""


@query(f"WITH {_IDS} SELECT i.id, i.object_key, p.id AS parent_id, CASE WHEN i.oid % 10 = 2 THEN 'SELECT 1' END AS definition FROM ids i LEFT JOIN ids p ON p.oid = i.parent")
def snapshot_objects(s, d):
    return _keyed(s, d)["objects"].select("id", "object_key", "parent_id", "definition")


@query(f"WITH {_IDS} SELECT (id - 1) * 2 + n AS id, id AS of_object, CASE n WHEN 1 THEN 'id' ELSE 'Name' END AS name FROM ids, (VALUES (1), (2)) AS v(n)")
def snapshot_columns(s, d):
    return _keyed(s, d)["columns"].select("id", "of_object", "name")


@query(f"WITH {_IDS} SELECT id AS of_object, id AS of_index, id * 2 - 1 AS of_column FROM ids")
def snapshot_index_columns(s, d):
    return _keyed(s, d)["index_columns"].select("of_object", "of_index", "of_column")


@query(f"WITH {_IDS} SELECT row_number() OVER (ORDER BY x.id, y.id, lower(fk.name)) AS id, x.id AS of_parent, y.id AS of_referenced, fk.name FROM fk JOIN ids x ON x.oid = a JOIN ids y ON y.oid = b")
def snapshot_foreign_keys(s, d):
    return _keyed(s, d)["foreign_keys"].select("id", "of_parent", "of_referenced", "name")


@query(f"WITH {_IDS} SELECT id AS of_index, coalesce(n, 0) AS seeks, coalesce(n, 0) = 0 AS is_unused FROM ids LEFT JOIN (SELECT o_custkey * 10 + 1 AS oid, count(*) AS n FROM orders GROUP BY o_custkey) USING (oid)")
def snapshot_index_usage(s, d):
    return _keyed(s, d)["index_usage"].select("of_index", "seeks", "is_unused")


@query(f"WITH {_IDS} SELECT x.id AS of_source, y.id AS of_target, 'fk' AS kind FROM fk JOIN ids x ON x.oid = a JOIN ids y ON y.oid = b")
def snapshot_dependencies(s, d):
    return _keyed(s, d)["dependencies"].select("of_source", "of_target", "kind")


@query(f"""WITH {_IDS}, n AS (SELECT count(*) AS n FROM ids), k AS (SELECT count(*) AS k FROM fk JOIN ids x ON x.oid = a JOIN ids y ON y.oid = b)
 SELECT t AS "table", CASE w WHEN 'k' THEN k WHEN '1' THEN 1 WHEN '2' THEN 2 * n WHEN 'n' THEN n ELSE 0 END AS n_rows FROM n, k, (VALUES ('databases', '1'), ('objects', 'n'), ('columns', '2'), ('parameters', 'n'), ('indexes', 'n'), ('index_columns', 'n'), ('foreign_keys', 'k'), ('foreign_key_columns', 'k'),
 ('check_constraints', 'n'), ('dependencies', 'k'), ('externals', '0'), ('column_lineage', 'n'), ('table_stats', '0'), ('index_usage', 'n'), ('proc_stats', '0'), ('missing_indexes', '0'), ('lineage_issues', '0'), ('warnings', '1')) AS v(t, w)""")
def snapshot_tables(s, d):
    """A whole scan into a store of its own; one family of statistics can't be read. Every column `Name` comes from its object's `id`."""
    required, details = _required(s, d), _details(s, d)
    store = Store(s, f"{shared_folder(s)}/snapshot-{uuid.uuid4().hex}")

    def lineage(objects: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
        ends = columns.groupBy("of_object").agg(F.min_by("id", "column_id").alias("a"), F.max_by("id", "column_id").alias("b"))
        edges = ends.select(F.col("a").cast("string").alias("source_id"), F.col("b").cast("string").alias("target_id"), F.lit("exact").alias("confidence"))
        return edges, s.createDataFrame([], "node string")

    scan.scan(store, 1, "Local", required, {"index_usage": lambda: _usage(s, d), "proc_stats": lambda: 1 / 0}, s.createDataFrame([("shop", "people")], "db string, schema string"), details=details, lineage=lineage)
    counts = [store.read(t, 1).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table"), "n_rows") for t in scan.TABLES]
    return reduce(DataFrame.unionByName, counts)
