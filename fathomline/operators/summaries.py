"""Summaries and lists over a snapshot's tables: counts, grids, lists of uses and foreign keys. All lazy.

objects: node, db, schema, name, kind, scope; other tables refer to `node`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import CONFIDENCE
from .graph import EDGE_KINDS
from .keys import dense_ids
from .reads import page

FUNCTIONS = ("scalar_function", "inline_tvf", "table_function", "clr_function")
# Sort names of each grid and their columns; the first is the default.
TABLE_SORTS = {"reserved_kb": "reserved_kb", "rows": "row_count", "data_kb": "data_kb", "index_kb": "index_kb", "size": "reserved_kb", "partitions": "partition_count", "name": "_name"}
INDEX_SORTS = {"updates": "updates", "seeks": "seeks", "scans": "scans", "lookups": "lookups", "name": "_index", "table": "_name"}
PROC_SORTS = {"exec_count": "executions", "total_ms": "total_elapsed", "avg_ms": "avg_elapsed", "max_ms": "max_elapsed", "cpu": "total_cpu", "reads": "total_reads", "last_exec": "last_run", "name": "_name"}
MISSING_SORTS = {"improvement": "improvement", "seeks": "seeks", "impact": "impact", "cost": "cost", "name": "_name"}
OBJECT_SORTS = {"name": "_name", "kind": "kind", "schema": "_schema", "rows": "row_count", "size": "reserved_kb", "execs": "executions", "modified": "modified"}
# End of fixed values.


def _count(test: Column | None = None) -> Column:
    return F.count(F.lit(1) if test is None else F.when(test, 1))


def _side_by_side(parts: list[DataFrame]) -> DataFrame:
    """Tables of one row each as one row."""
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    return reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")


def scan_counts(objects: DataFrame, **tables: DataFrame) -> DataFrame:
    """One row: databases, schemas, objects by kind, and how many rows each of the other tables has."""
    kind = lambda *k: _count(F.col("kind").isin(*k))
    of_objects = objects.agg(
        F.countDistinct(F.when(F.col("scope") != "external", F.concat("db", F.lit("."), "schema"))).alias("schemas"),
        kind("table").alias("tables"), kind("view").alias("views"), kind("procedure").alias("procedures"), kind(*FUNCTIONS).alias("functions"), kind("trigger").alias("triggers"),
        kind("synonym").alias("synonyms"), kind("external").alias("externals"), _count(F.col("scope") == "cascaded").alias("cascaded"),
    )
    return _side_by_side([of_objects, *(t.agg(_count().alias(name)) for name, t in tables.items())])


def warnings_summary(objects: DataFrame, issues: DataFrame, index_usage: DataFrame, missing: DataFrame) -> DataFrame:
    return _side_by_side([
        issues.agg(_count().alias("lineage_issues")), index_usage.agg(_count(F.col("is_unused")).alias("unused_indexes")),
        missing.agg(_count().alias("missing_index_suggestions")), objects.agg(_count(F.col("scope") == "external").alias("external_refs")),
    ])


def overview(objects: DataFrame, databases: DataFrame) -> DataFrame:
    """A row for each database (db, is_configured, selected: schema names): its schemas, each with whether it is selected and counts by kind."""
    own = objects.filter("scope <> 'external'").withColumns({"_db": F.lower("db"), "schema": F.coalesce("schema", F.lit(""))})
    by_kind = own.groupBy("_db", "schema", "kind").agg(_count().alias("n"))
    by_schema = by_kind.groupBy("_db", "schema").agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("counts"))
    named = databases.withColumn("_db", F.lower("db")).join(by_schema, "_db", "left")
    selected = F.exists("selected", lambda x: F.lower(x) == F.lower("schema"))
    listed = named.withColumn("key", F.when(F.col("schema").isNotNull(), F.struct(F.lower("schema").alias("folded"), F.col("schema").alias("name"), F.coalesce(selected, F.lit(False)).alias("is_selected"), "counts")))
    made = listed.groupBy("db", "is_configured").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    return made.select("db", "is_configured", F.transform("keys", lambda k: F.struct(k["name"].alias("name"), k.is_selected.alias("is_selected"), F.map_from_entries(k.counts).alias("counts_by_kind"))).alias("schemas"))


def lineage_summary(objects: DataFrame, dependencies: DataFrame, column_edges: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: objects, edges of each kind, column edges of each confidence (all zero-filled), objects with issues."""
    return _side_by_side([
        objects.agg(_count().alias("objects")), dependencies.agg(*(_count(F.col("kind") == k).alias(k) for k in EDGE_KINDS)),
        column_edges.agg(*(_count(F.col("confidence") == c).alias(c) for c in CONFIDENCE)), issues.agg(F.countDistinct("node").alias("objects_with_issues")),
    ])


def column_totals(columns: DataFrame) -> DataFrame:
    return columns.groupBy("node").agg(_count().alias("columns"))


def graph_nodes(objects: DataFrame, table_stats: DataFrame, proc_stats: DataFrame, issues: DataFrame) -> DataFrame:
    """objects with row_count, executions and has_issues."""
    flagged = issues.select("node").distinct().withColumn("_issue", F.lit(True))
    out = objects.join(table_stats.select("node", "row_count"), "node", "left").join(proc_stats.select("node", "executions"), "node", "left").join(flagged, "node", "left")
    return out.withColumn("has_issues", F.col("_issue").isNotNull()).drop("_issue")


def issue_list(objects: DataFrame, issues: DataFrame) -> DataFrame:
    """issues with the db, schema, name and kind of their objects."""
    return issues.join(objects.select("node", "db", "schema", "name", F.col("kind").alias("object_kind")), "node")


def _folded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_name": F.lower("name"), "_schema": F.lower("schema")})


def grid(stats: DataFrame, objects: DataFrame, sorts: dict[str, str], *, sort: str | None = None, descending: bool = True, limit: int = 50, offset: int = 0, db: str | None = None, schema: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """One page of stats with their objects' names and the total; ties by schema, name, node (and `ties`). An unknown sort is the default."""
    rows = _folded(stats.join(objects.select("node", "db", "schema", "name"), "node"))
    if "index_name" in rows.columns:
        rows = rows.withColumn("_index", F.lower("index_name"))
    for column, value in (("db", db), ("schema", schema)):
        if value:
            rows = rows.filter(F.lower(column) == value.lower())
    default = next(iter(sorts))
    return page(rows, sorts, sort or default, descending, ["_schema", "_name", "node", *ties], limit, offset, default).drop("_name", "_schema", "_index")


def object_page(objects: DataFrame, table_stats: DataFrame, proc_stats: DataFrame, *, sort: str = "name", descending: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of objects (with `modified`) by one of OBJECT_SORTS; statistics are joined only for the sorts that need them."""
    rows = _folded(objects)
    if sort in ("rows", "size"):
        rows = rows.join(table_stats.select("node", "row_count", "reserved_kb"), "node", "left")
    elif sort == "execs":
        rows = rows.join(proc_stats.select("node", "executions"), "node", "left")
    return page(rows, OBJECT_SORTS, sort, descending, ["_schema", "_name", "node"], limit, offset).select(*objects.columns, "total")


def uses(objects: DataFrame, dependencies: DataFrame, node: str) -> DataFrame:
    """role (uses, used_by), other, other_name and the edge, for one object. A row that names itself counts under uses only; equal rows once."""
    d = dependencies.filter((F.col("source") == node) | (F.col("target") == node)).join(objects.select(F.col("node").alias("source")), "source", "left_semi")
    first = ["source", "target", "kind", "resolution", "referenced_name"]
    d = d.groupBy(*first).agg(F.min("id").alias("id"))
    out = d.filter(F.col("source") == node).select(F.lit("uses").alias("role"), F.col("target").alias("other"), *first[2:], "id")
    into = d.filter((F.col("target") == node) & (F.col("source") != node)).select(F.lit("used_by").alias("role"), F.col("source").alias("other"), *first[2:], "id")
    return out.unionByName(into).join(objects.select(F.col("node").alias("other"), F.col("name").alias("other_name")), "other", "left")


def foreign_keys_of(objects: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """node, side (out, in), other, name: each key at both of its ends, if both are known. foreign_keys: name, parent, referenced."""
    end = lambda c, name: objects.select(F.col("node").alias(c), F.col("name").alias(name))
    known = foreign_keys.join(end("parent", "parent_name"), "parent").join(end("referenced", "referenced_name"), "referenced")
    out = known.select(F.col("parent").alias("node"), F.lit("out").alias("side"), F.col("referenced").alias("other"), F.col("referenced_name").alias("other_name"), "name")
    return out.unionByName(known.select(F.col("referenced").alias("node"), F.lit("in").alias("side"), F.col("parent").alias("other"), F.col("parent_name").alias("other_name"), "name"))


def scans_newest_first(scans: DataFrame) -> DataFrame:
    """Scans with duration_ms, by start, then number; one that hasn't finished has none."""
    took = (F.unix_micros(F.col("finished").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1000
    return scans.withColumn("duration_ms", F.floor(took)).orderBy(F.desc("started"), F.desc("scan"))


# The kinds in the order in which they are analysed, and the longest body that is.
ANALYSIS_ORDER = ("view", "inline_tvf", "table_function", "procedure", "trigger", "scalar_function")
LONGEST_BODY = 500_000
# End of fixed values.


def analysis_plan(modules: DataFrame) -> DataFrame:
    """node, kind, schema, name, place (rank of the kind, number within it) and status of modules (with definition): skipped if the body is too long, else pending.

    Bodies stay where they are read, only their lengths go on; the order of all modules is made by ranges, not by one task a kind.
    """
    rank = F.array_position(F.array(*map(F.lit, ANALYSIS_ORDER)), F.col("kind"))
    status = F.when(F.length("definition") > LONGEST_BODY, "skipped").otherwise("pending")
    slim = modules.select("node", "kind", "schema", "name", rank.alias("_rank"), status.alias("status")).filter("_rank > 0")
    placed = dense_ids(slim, "_rank", F.coalesce("schema", F.lit("")), "name", "node", name="_id")
    first = placed.groupBy("_rank").agg(F.min("_id").alias("_first"))
    out = placed.join(F.broadcast(first), "_rank")  # a row a kind
    return out.select("node", "kind", "schema", "name", F.struct(F.col("_rank").alias("kind"), (F.col("_id") - F.col("_first") + 1).cast("int").alias("n")).alias("place"), "status")


def module_status(modules: DataFrame, issues: DataFrame) -> DataFrame:
    """node, status: failed if the analysis broke off (modules: node, failed), partial with any issue, else ok."""
    flagged = issues.select("node").distinct().withColumn("_issue", F.lit(True))
    status = F.when(F.col("failed"), "failed").when(F.col("_issue"), "partial").otherwise("ok")
    return modules.select("node", "failed").join(flagged, "node", "left").select("node", status.alias("status"))


def natural_description(objects: DataFrame, properties: DataFrame, annotations: DataFrame) -> DataFrame:
    """node, catalog_description, user_description and the one to show: the user's if there is one."""
    out = objects.select("node").join(properties.select("node", F.col("value").alias("catalog_description")), "node", "left")
    return out.join(annotations.select("node", F.col("description").alias("user_description")), "node", "left").withColumn("description", F.coalesce("user_description", "catalog_description"))


def pseudo_columns(columns: DataFrame, new: DataFrame) -> DataFrame:
    """new (node, name) with ordinals after those that their objects have, in order of name; names that are there already are left out."""
    known = columns.select("node", F.lower("name").alias("_n"))
    fresh = new.withColumn("_n", F.lower("name")).groupBy("node", "_n").agg(F.min("name").alias("name")).join(known, ["node", "_n"], "left_anti")
    counts = columns.groupBy("node").agg(_count().alias("_c"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("_n"))
    return fresh.join(counts, "node", "left").select("node", "name", (F.coalesce("_c", F.lit(0)) + place).alias("ordinal"))


def _shown(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def shown_nodes(hops: DataFrame, objects: DataFrame, tags: DataFrame | None = None, key: str = "node") -> DataFrame:
    """A graph's nodes as they are shown: by hop, then name; ids are `o:` and the node.

    tags: key, tag. A node's are those of its key (the column of objects so named), whatever the case, each once and sorted.
    """
    rows = hops.join(objects, "node")
    if tags is not None:
        of = tags.groupBy(F.lower("key").alias("_key")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
        rows = rows.withColumn("_key", F.lower(F.col(key))).join(of, "_key", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return rows.select(_shown("o:", "node").alias("id"), "hop", "name", "kind", "schema", *(["tags"] if tags is not None else [])).orderBy("hop", F.lower("name"), "id")


def shown_edges(edges: DataFrame, ends: str = "o:") -> DataFrame:
    """Edges as they are shown: ids `e:` and their own, ends `o:` and the object or `c:` and the column; other columns stay."""
    rest = [c for c in edges.columns if c not in ("id", "source", "target")]
    return edges.select(_shown("e:", "id").alias("id"), _shown(ends, "source").alias("source"), _shown(ends, "target").alias("target"), *rest).orderBy("source", "target", "id")


def column_more(columns: DataFrame, edges: DataFrame, returned: DataFrame) -> DataFrame:
    """node, more: for each returned object, how many objects outside of it any of its columns has an edge with. columns: column, object; returned: object."""
    at = lambda end, name: columns.select(F.col("column").alias(end), F.col("object").alias(name))
    pairs = edges.select("source", "target").join(at("source", "a"), "source").join(at("target", "b"), "target").select("a", "b").distinct()
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    inside = returned.select("object")
    outside = both.join(inside.withColumnRenamed("object", "a"), "a", "left_semi").join(inside.withColumnRenamed("object", "b"), "b", "left_anti")
    return inside.join(outside.groupBy(F.col("a").alias("object")).agg(_count().alias("more")), "object", "left").fillna(0, ["more"])
