"""A snapshot's tables with ids of their own: every rowset of a scan, looked up against the scan's objects.

A row that names an object outside the closure goes where it can't do without it (a column, an index, either end of a foreign
key), and keeps a null where it can (the target of a dependency). Ids are dense, in the order of the names that rows go by,
so they are the same whenever the same estate is scanned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import display, is_unused, object_key
from ..operators.cascade import Closure, key
from ..operators.keys import dense_ids, looked_up

#: Rowsets of objects' details, and what their rows are ordered by within an object.
DETAILS = {"columns": ("column_id", "name"), "parameters": ("parameter_id", "name"), "indexes": ("index_id", "name")}
STATISTICS = ("table_stats", "proc_stats", "missing_indexes")


def objects(connection: str, rows: DataFrame, closure: Closure, modules: DataFrame | None = None, descriptions: DataFrame | None = None) -> DataFrame:
    """The closure's objects and externals with `id` and `parent_id`. rows: db, object_id, schema, name, kind, parent_object_id;
    modules: db, object_id, definition; descriptions: db, object_id, description."""
    node = key(F.col("db"), F.col("object_id"))
    parent = F.col("parent_object_id") if "parent_object_id" in rows.columns else F.lit(None).cast("long")
    own = rows.withColumn("node", node).join(closure.scope.withColumnRenamed("key", "node"), "node").withColumn("parent", key(F.col("db"), parent))
    for extra, column in ((modules, "definition"), (descriptions, "description")):
        if extra is not None:
            own = own.drop(column).join(extra.select(node.alias("node"), column).dropDuplicates(["node"]), "node", "left")
    kept = [c for c in ("definition", "description", "modified") if c in own.columns]
    own = own.select("node", "object_id", object_key(F.lit(connection), F.col("db"), F.col("schema"), F.col("name")).alias("object_key"), "db", "schema", "name", "kind", "scope", "parent", *kept)
    outside = closure.externals.select(F.col("external_key").alias("node"), F.col("external_key").alias("object_key"), "db", "schema", display(F.col("server"), F.col("db"), F.col("schema"), F.col("name")).alias("name"), F.lit("external").alias("kind"), F.lit("external").alias("scope"))
    made = dense_ids(own.unionByName(outside, allowMissingColumns=True), F.lower("object_key"), "object_key", "node")
    return looked_up(made, made.select("id", "node"), [(F.col("parent"), "node")], "parent_id", required=False).drop("parent")


def keyed(tables: dict[str, DataFrame], found: DataFrame, closure: Closure) -> dict[str, DataFrame]:
    """The given rowsets of found (objects()) with their ids. Each has db; of_object, of_parent and the like are ids of the snapshot."""
    ids = found.select("id", "node")
    of = lambda rows, column, new, required=True: looked_up(rows, ids, [(key(F.col("db"), F.col(column)), "node")], new, required)
    out: dict[str, DataFrame] = {}
    for name, order in DETAILS.items():
        if name in tables:
            out[name] = dense_ids(of(tables[name], "object_id", "of_object"), "of_object", *(c for c in order if c in tables[name].columns))
    if "index_columns" in tables:
        rows = of(tables["index_columns"], "object_id", "of_object")
        if "indexes" in out:
            rows = looked_up(rows, out["indexes"], [(F.col("of_object"), "of_object"), (F.col("index_id"), "index_id")], "of_index")
        if "columns" in out:
            rows = looked_up(rows, out["columns"], [(F.col("of_object"), "of_object"), (F.col("column_id"), "column_id")], "of_column", required=False)
        out["index_columns"] = rows
    if "foreign_keys" in tables:
        rows = of(of(tables["foreign_keys"], "parent_object_id", "of_parent"), "referenced_object_id", "of_referenced")
        out["foreign_keys"] = dense_ids(rows, "of_parent", "of_referenced", F.lower("name"), "name", "object_id")
    if "foreign_key_columns" in tables and "foreign_keys" in out:
        names = out["foreign_keys"].select("id", key(F.col("db"), F.col("object_id")).alias("node"))
        out["foreign_key_columns"] = looked_up(tables["foreign_key_columns"], names, [(key(F.col("db"), F.col("constraint_object_id")), "node")], "of_key")
    if "check_constraints" in tables:
        out["check_constraints"] = of(tables["check_constraints"], "parent_object_id", "of_parent")
    for name in STATISTICS:
        if name in tables:
            out[name] = of(tables[name], "object_id", "of_object")
    if "index_usage" in tables:
        out["index_usage"] = usage(tables["index_usage"], out["indexes"]) if "indexes" in out else of(tables["index_usage"], "object_id", "of_object")
    edges = closure.edges.select("source", F.coalesce("target", "external_key").alias("target"), "kind", "resolution", "minor_id", "referenced_name")
    edges = looked_up(looked_up(edges, ids, [(F.col("source"), "node")], "of_source"), ids, [(F.col("target"), "node")], "of_target", required=False)
    return out | {"dependencies": edges, "externals": closure.externals}


def usage(counters: DataFrame, indexes: DataFrame) -> DataFrame:
    """A row for each index, with zeros where nothing was counted, and whether it is unused."""
    counted = ["seeks", "scans", "lookups", "updates"]
    have = [c for c in counted if c in counters.columns]
    flags = [c for c in ("is_primary_key", "is_unique_constraint", "type_code") if c in indexes.columns]
    rows = indexes.select("db", "object_id", "index_id", "of_object", F.col("id").alias("of_index"), *flags)
    sums = counters.groupBy(F.lower("db").alias("_db"), F.col("object_id").alias("_o"), F.col("index_id").alias("_i")).agg(*(F.sum(c).alias(c) for c in have))
    out = rows.join(sums, (F.lower("db") == F.col("_db")) & (F.col("object_id") == F.col("_o")) & (F.col("index_id") == F.col("_i")), "left").drop("_db", "_o", "_i")
    out = out.withColumns({c: F.coalesce(F.col(c) if c in have else F.lit(None), F.lit(0)).cast("long") for c in counted})
    flag = lambda c: F.col(c) if c in flags else F.lit(False)
    code = F.col("type_code") if "type_code" in flags else F.lit(2)
    return out.withColumn("is_unused", is_unused(flag("is_primary_key"), flag("is_unique_constraint"), code, F.col("seeks"), F.col("scans"), F.col("lookups"))).drop(*flags)
