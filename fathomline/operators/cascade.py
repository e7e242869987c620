"""Scope closure: which objects of an estate are documented, starting from the selected schemas.

Every dependency row is resolved once, up front, by joins; what is left is reachability over a fixed edge list. A level
joins the frontier with the edges and anti-joins what is known. Only triggers depend on how a table came in; a table that
is selected is level 0, so its scope is known before any edge is walked.

objects: db, object_id, schema, name, kind, parent_object_id. Keys of objects are (db, object_id) as `db#id` strings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import external_key, multipart
from ..session import checkpoint

EDGE = ["source", "target", "kind", "resolution", "minor_id", "referenced_name", "external_key"]


@dataclass
class Closure:
    scope: DataFrame  # key, scope
    edges: DataFrame  # EDGE
    externals: DataFrame  # external_key, server, db, schema, name


def even(rows: DataFrame) -> DataFrame:
    """rows, to be joined by a shuffle: they grow with the catalog, and what Spark guesses of their size before they are made may be far too little to send them to all tasks."""
    return rows.hint("merge")


def key(db: Column, object_id: Column) -> Column:
    return F.concat(F.lower(db), F.lit("#"), object_id.cast("string"))


def _resolve(refs: DataFrame, objects: DataFrame, databases: DataFrame, server_name: str | None) -> DataFrame:
    """refs with `target`, `resolution`, `external_key`. refs: db, kind_of_source, referenced_id, r_server, r_db, r_schema, r_name, caller, ambiguous."""
    by_id = objects.select(F.lower("db").alias("_idb"), F.col("object_id").alias("_iid"), key(F.col("db"), F.col("object_id")).alias("_by_id"))
    by_name = objects.select(F.lower("db").alias("_ndb"), F.lower("schema").alias("_ns"), F.lower("name").alias("_nn"), "object_id").groupBy("_ndb", "_ns", "_nn").agg(F.min_by(key(F.col("_ndb"), F.col("object_id")), "object_id").alias("_by_name"))  # of equal names the smallest id
    known = databases.select(F.lower("db").alias("_kdb"), F.lit(True).alias("_known")).distinct()
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    # An empty part counts as none, and the own server's name adds nothing to a name.
    server = F.when(F.lower("r_server") != F.lit((server_name or "").lower()), given("r_server"))
    rows = refs.withColumns({"r_server": server, "r_db": given("r_db"), "r_schema": given("r_schema")})
    other_server = F.col("r_server").isNotNull()
    caller = F.col("caller") & F.col("r_db").isNull()  # looked up in dbo, whatever schema is named
    rows = rows.withColumn("_db", F.lower(F.coalesce("r_db", "db"))).withColumn("_schema", F.when(caller, "dbo").otherwise(F.lower(F.coalesce("r_schema", F.lit("dbo")))))
    rows = rows.join(even(by_id), (F.lower("db") == F.col("_idb")) & (F.col("referenced_id") == F.col("_iid")), "left")
    rows = rows.join(even(by_name), (F.col("_db") == F.col("_ndb")) & (F.col("_schema") == F.col("_ns")) & (F.lower("r_name") == F.col("_nn")), "left")
    rows = rows.join(known, F.col("_db") == F.col("_kdb"), "left")
    external = other_server | (F.col("r_db").isNotNull() & F.col("_known").isNull())
    resolution = (
        F.when(F.col("referenced_id").isNotNull(), F.when(F.col("_by_id").isNotNull(), "resolved").otherwise("unresolved"))
        .when(F.col("ambiguous"), "ambiguous")
        .when(caller, F.when(F.col("_by_name").isNotNull(), "caller_dependent").otherwise("unresolved"))
        .when(external, "external")
        .otherwise(F.when(F.col("_by_name").isNotNull(), "resolved").otherwise("unresolved"))
    )
    target = F.when(F.col("referenced_id").isNotNull(), F.col("_by_id")).when(F.col("ambiguous") | (~caller & external), None).otherwise(F.col("_by_name"))
    rows = rows.withColumns({"target": target, "resolution": resolution})
    rows = rows.withColumn("external_key", F.when(F.col("resolution") == "external", external_key(F.col("r_server"), F.col("r_db"), F.col("r_schema"), F.col("r_name"))))
    pseudo = (F.col("kind_of_source") == "trigger") & F.col("referenced_id").isNull() & ~F.col("ambiguous") & F.col("r_schema").isNull() & F.lower("r_name").isin("inserted", "deleted")
    return rows.filter(~pseudo).drop("_idb", "_iid", "_by_id", "_ndb", "_ns", "_nn", "_by_name", "_kdb", "_known", "_db", "_schema")


def resolved_edges(objects: DataFrame, dependencies: DataFrame, foreign_keys: DataFrame, triggers: DataFrame, synonyms: DataFrame, databases: DataFrame, *, server_name: str | None = None, follow_foreign_keys: bool = True) -> tuple[DataFrame, DataFrame]:
    """All edges with `visit` (the end that has to be reached for the edge to count) and `next` (what it reaches), and the externals' parts."""
    kinds = objects.select(F.lower("db").alias("_odb"), F.col("object_id").alias("_oid"), F.col("kind").alias("kind_of_source"))
    deps = dependencies.join(even(kinds), (F.lower("db") == F.col("_odb")) & (F.col("referencing_id") == F.col("_oid")))
    deps = deps.select(
        key(F.col("db"), F.col("referencing_id")).alias("source"), "db", "kind_of_source", "referenced_id",
        F.col("referenced_server_name").alias("r_server"), F.col("referenced_database_name").alias("r_db"), F.col("referenced_schema_name").alias("r_schema"), F.col("referenced_entity_name").alias("r_name"),
        F.coalesce("is_caller_dependent", F.lit(False)).alias("caller"), F.coalesce("is_ambiguous", F.lit(False)).alias("ambiguous"), F.col("referencing_minor_id").alias("minor_id"), F.lit("catalog").alias("kind"),
    )
    base = synonyms.withColumn("_p", multipart(F.col("base_object_name"))).filter("_p IS NOT NULL")
    syn = base.select(
        key(F.col("db"), F.col("object_id")).alias("source"), "db", F.lit("synonym").alias("kind_of_source"), F.lit(None).cast("long").alias("referenced_id"),
        F.col("_p.server").alias("r_server"), F.col("_p.db").alias("r_db"), F.col("_p.schema").alias("r_schema"), F.col("_p.name").alias("r_name"),
        F.lit(False).alias("caller"), F.lit(False).alias("ambiguous"), F.lit(0).alias("minor_id"), F.lit("synonym").alias("kind"),
    )
    named = _resolve(deps.unionByName(syn), objects, databases, server_name).filter("target IS NULL OR source <> target")
    externals = named.filter("external_key IS NOT NULL").select("source", "external_key", F.col("r_server").alias("server"), F.col("r_db").alias("db"), F.col("r_schema").alias("schema"), F.col("r_name").alias("name"))
    edges = named.select("source", "target", "kind", "resolution", "minor_id", F.col("r_name").alias("referenced_name"), "external_key", F.col("source").alias("visit"), F.col("target").alias("next"))
    fixed = lambda rows, source, target, kind, visit, after: rows.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), F.lit("resolved").alias("resolution"), F.lit(0).alias("minor_id"), F.lit(None).cast("string").alias("referenced_name"), F.lit(None).cast("string").alias("external_key"), visit.alias("visit"), after.alias("next"))
    if follow_foreign_keys:
        a, b = key(F.col("db"), F.col("parent_object_id")), key(F.col("db"), F.col("referenced_object_id"))
        edges = edges.unionByName(fixed(foreign_keys, a, b, "fk", a, b))
    t, p = key(F.col("db"), F.col("object_id")), key(F.col("db"), F.col("parent_id"))
    edges = edges.unionByName(fixed(triggers, t, p, "trigger", t, p))
    # A table brings its triggers in: the same edge, reached from the other end.
    edges = edges.unionByName(fixed(triggers, t, p, "trigger_of", p, t))
    return edges, externals


def compute_closure(objects: DataFrame, dependencies: DataFrame, foreign_keys: DataFrame, triggers: DataFrame, synonyms: DataFrame, selected: DataFrame, *, server_name: str | None = None, follow_foreign_keys: bool = True, triggers_of_cascaded: bool = True) -> Closure:
    """selected: db, schema. Scope, edges and externals of everything that the selected schemas' objects use."""
    edges, externals = resolved_edges(objects, dependencies, foreign_keys, triggers, synonyms, selected.select("db"), server_name=server_name, follow_foreign_keys=follow_foreign_keys)
    chosen = selected.select(F.lower("db").alias("_d"), F.lower("schema").alias("_s")).distinct()
    seed = objects.join(chosen, (F.lower("db") == F.col("_d")) & (F.lower("schema") == F.col("_s")), "left_semi").select(key(F.col("db"), F.col("object_id")).alias("key")).distinct()
    scope = checkpoint(seed.withColumn("scope", F.lit("in_scope")))
    if not triggers_of_cascaded:
        own = scope.select(F.col("key").alias("visit"))
        edges = edges.filter("kind <> 'trigger_of'").unionByName(edges.filter("kind = 'trigger_of'").join(even(own), "visit", "left_semi").select(edges.columns))
    edges = checkpoint(edges)
    exists = objects.select(key(F.col("db"), F.col("object_id")).alias("key"))
    frontier, levels = scope.select("key"), 0
    while True:
        reached = edges.join(even(frontier.withColumnRenamed("key", "visit")), "visit", "left_semi").filter("next IS NOT NULL").select(F.col("next").alias("key")).distinct()
        frontier = checkpoint(reached.join(even(exists), "key", "left_semi").join(even(scope), "key", "left_anti"))
        if frontier.isEmpty():
            break
        # Each level is written once; only every 16th gathers them, so that a deep closure's plan stays short.
        scope, levels = scope.unionByName(frontier.withColumn("scope", F.lit("cascaded"))), levels + 1
        if levels % 16 == 0:
            scope = checkpoint(scope)
    visited = scope.select(F.col("key").alias("visit"))
    found = edges.join(even(visited), "visit", "left_semi").withColumn("kind", F.when(F.col("kind") == "trigger_of", "trigger").otherwise(F.col("kind")))
    outside = externals.join(even(scope.select(F.col("key").alias("source"))), "source", "left_semi").drop("source").dropDuplicates(["external_key"])
    return Closure(scope, found.select(EDGE).distinct(), outside)
