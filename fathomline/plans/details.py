"""Composite reads: all that is stored about an object, as one row with nested parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reads import latest
from ..sources.store import Store
from .scan import Progress


def _parts(rows: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
    """One row for each key with its rows as a sorted array of structs."""
    return rows.groupBy(F.col(key).alias("node")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def object_detail(objects: DataFrame, columns: DataFrame, edges: DataFrame, statistics: DataFrame, annotations: DataFrame) -> DataFrame:
    """objects: node, name, kind, schema; columns: node, ordinal, column; edges: source, target, kind; statistics: node, row_count; annotations: node, description."""
    out = objects.select("node", "name", "kind", "schema")
    for part in (
        _parts(columns, "node", "columns", "ordinal", "column"),
        _parts(edges, "target", "upstream", "source", "kind"),
        _parts(edges, "source", "downstream", "target", "kind"),
        statistics.select("node", "row_count"),
        annotations.select("node", "description"),
    ):
        out = out.join(part, "node", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    return out.withColumns({c: empty(c) for c in ("columns", "upstream", "downstream")})


def object_parts(objects: DataFrame, **parts: DataFrame) -> DataFrame:
    """objects (with node) and, for each named part (rows with node), its rows as a sorted array of structs, empty where it has none.

    All parts are united, each in a column of its own, and gathered by one shuffle of the key, however many there are. Rows of
    objects that aren't listed are left out; equal rows of a part are all kept.
    """
    own = objects.select("node", F.struct(*(F.col(f"`{c}`") for c in objects.columns)).alias("_object"))
    rows = [p.select("node", F.struct(*(F.col(f"`{c}`") for c in p.columns if c != "node")).alias(name)) for name, p in parts.items()]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [own, *rows])
    found = every.groupBy("node").agg(F.first("_object", True).alias("_object"), *(F.array_sort(F.collect_list(name)).alias(name) for name in parts))
    return found.filter("_object IS NOT NULL").select("_object.*", *parts)


def lookup(objects: DataFrame, key: str) -> DataFrame:
    """The object that a key (connection|db|schema|name) names, whatever its case."""
    parts = key.split("|")
    if len(parts) != 4:
        return objects.limit(0)
    return objects.filter((F.lower("db") == parts[1].lower()) & (F.lower("schema") == parts[2].lower()) & (F.lower("name") == parts[3].lower()))


def definition(objects: DataFrame, key: str) -> DataFrame:
    """object_key, definition of the object that a key names; no row if there is none or it has no definition."""
    return lookup(objects, key).filter("definition IS NOT NULL").select("object_key", "definition")


def info(store: Store) -> DataFrame:
    """connection, scans (of any state), and number and end of the latest that succeeded; names of connections are one whatever their case."""
    scans = store.scans()
    counted = scans.groupBy(F.lower("connection").alias("_c")).agg(F.min("connection").alias("connection"), F.count(F.lit(1)).alias("scans"))
    last = latest(scans).select(F.lower("connection").alias("_c"), F.col("scan").alias("latest"), "finished")
    return counted.join(last, "_c", "left").drop("_c")


def scan_status(store: Store, number: int, progress: Progress | None = None) -> dict | None:
    """A scan's state, and, of one that this process runs, its phase, messages, tables and Spark's counts. None if there is no such scan."""
    row = store.scans().filter(F.col("scan") == number).first()
    if row is None:
        return None
    running = progress is not None and row.status == "running"
    told = {"phase": progress.phase, "log": list(progress.log), "tables": progress.tables} if progress else {}
    return row.asDict() | told | (progress.counts(store, number) if running else {})
