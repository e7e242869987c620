"""Reads over a snapshot: filters, sorted pages, search, counts. All lazy; the caller decides what runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same(column: str | Column, value: str) -> Column:
    """Equality without case."""
    return F.lower(column) == value.lower()


def holds(column: str | Column, needle: str) -> Column:
    return F.contains(F.lower(column), F.lit(needle.lower()))


def in_csv(column: str, csv: str | None) -> Column:
    """Membership in a comma-separated list; an empty list is no filter."""
    values = [v.strip() for v in (csv or "").split(",") if v.strip()]
    return F.col(column).isin(*values) if values else F.lit(True)


def list_objects(objects: DataFrame, *, db: str | None = None, schema: str | None = None, kinds: str | None = None, scope: str | None = None, q: str | None = None, tagged: DataFrame | None = None, issues: DataFrame | None = None, has_issues: bool | None = None) -> DataFrame:
    """objects (node, db, schema, name, kind, scope) under all given filters; tagged, issues: node."""
    tests = [in_csv("kind", kinds), in_csv("scope", scope)]
    tests += [same(c, v) for c, v in (("db", db), ("schema", schema)) if v] + ([holds("name", q)] if q else [])
    out = objects.filter(reduce(lambda a, b: a & b, tests))
    if tagged is not None:
        out = out.join(tagged.select("node").distinct(), "node", "left_semi")
    if issues is not None and has_issues is not None:
        out = out.join(issues.select("node").distinct(), "node", "left_semi" if has_issues else "left_anti")
    return out


def page(rows: DataFrame, keys: dict[str, str], sort: str, descending: bool, ties: list[str], limit: int, offset: int = 0, default: str = "name") -> DataFrame:
    """One page of rows with `total`, nulls last either way. keys: sort name -> column; an unknown name sorts by the default."""
    column = F.col(keys.get(sort, keys[default]))
    order = column.desc_nulls_last() if descending else column.asc_nulls_last()
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    top = rows.orderBy(order, *(F.col(t).asc_nulls_last() for t in ties)).offset(offset).limit(limit)
    return top.join(F.broadcast(total))  # one row


def search(rows: DataFrame, column: str, needle: str, limit: int, ident: str = "node") -> DataFrame:
    """The shortest names that hold the needle (a top-k report)."""
    return rows.filter(holds(column, needle)).orderBy(F.length(column), F.lower(column), ident).limit(limit)


def search_filled(named: DataFrame, defined: DataFrame, needle: str, limit: int) -> DataFrame:
    """Hits by name, then hits by definition among the others, up to a limit. named: node, name; defined: node, name, definition."""
    first = search(named, "name", needle, limit).select("node", "name", F.lit(0).alias("place"))
    rest = defined.filter(holds("definition", needle)).join(first.select("node"), "node", "left_anti").select("node", "name", F.lit(1).alias("place"))
    return first.unionByName(rest).orderBy("place", F.length("name"), F.lower("name"), "node").limit(limit)


def latest(scans: DataFrame) -> DataFrame:
    """Each connection's last finished scan that succeeded."""
    order = Window.partitionBy(F.lower("connection")).orderBy(F.desc("finished"), F.desc("scan"))
    return scans.filter("status = 'succeeded'").withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def prunable(scans: DataFrame, keep: int) -> DataFrame:
    """Scans beyond the newest `keep` of their connection; one that still runs is never among them."""
    order = Window.partitionBy(F.lower("connection")).orderBy(F.desc("scan"))
    return scans.withColumn("_r", F.row_number().over(order)).filter((F.col("_r") > keep) & (F.col("status") != "running")).drop("_r")


def first_wins(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def coverage(statuses: DataFrame) -> DataFrame:
    """Share of analysed modules that are ok or partial; null without any."""
    known = F.count(F.when(F.col("status") != "n/a", 1))
    good = F.count(F.when(F.col("status").isin("ok", "partial"), 1))
    return statuses.agg(F.try_divide(good, known).alias("coverage"), known.alias("modules"))


def column_counts(edges: DataFrame) -> DataFrame:
    """column, upstream, downstream: edges at each column (source, target)."""
    both = edges.select(F.col("target").alias("column"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("source").alias("column"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return both.filter("column IS NOT NULL").groupBy("column").agg(F.sum("up").alias("upstream"), F.sum("down").alias("downstream"))


def confidence_histogram(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("target").alias("column"), "confidence").unionByName(edges.select(F.col("source").alias("column"), "confidence"))
    return both.filter("column IS NOT NULL").groupBy("column").agg(*(F.count(F.when(F.col("confidence") == c, 1)).alias(c) for c in ("exact", "inferred", "unresolved")))
