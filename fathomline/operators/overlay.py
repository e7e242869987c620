"""Annotations and tags: an overlay that outlives scans. Every change gives the new table; storing it is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .reads import page

FIELDS = ("description", "notes", "owner")


def upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """current: kind, key, FIELDS. changes: the same with `set_<field>` flags; an unset field keeps its value, a set null clears it.

    Keys are compared without case; the stored spelling stays.
    """
    c = current.select("kind", "key", *FIELDS, F.lower("key").alias("_k"))
    n = changes.select(F.col("kind").alias("kind"), F.col("key").alias("_new"), *(F.col(f).alias(f"new_{f}") for f in FIELDS), *(F.col(f"set_{f}") for f in FIELDS), F.lower("key").alias("_k"))
    merged = c.join(n, ["kind", "_k"], "full_outer")
    pick = [F.when(F.coalesce(F.col(f"set_{f}"), F.lit(False)), F.col(f"new_{f}")).otherwise(F.col(f)).alias(f) for f in FIELDS]
    return merged.select("kind", F.coalesce("key", "_new").alias("key"), *pick)


def wanted_tags(tags: DataFrame, known: DataFrame) -> DataFrame:
    """tags: kind, key, place, tag. Trimmed, without empty ones and repeats (first spelling wins); a known tag's spelling is reused."""
    clean = tags.select("kind", "key", "place", F.trim("tag").alias("tag")).filter("tag <> ''")
    first = Window.partitionBy("kind", F.lower("key"), F.lower("tag")).orderBy("place")
    clean = clean.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "place")
    spelled = known.select(F.lower("tag").alias("_t"), F.col("tag").alias("_known")).dropDuplicates(["_t"])
    return clean.join(spelled, F.lower("tag") == F.col("_t"), "left").select("kind", "key", F.coalesce("_known", "tag").alias("tag"))


def set_tags(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """All assignments after the targets in `wanted` got exactly the tags there."""
    touched = wanted.select("kind", F.lower("key").alias("_k")).distinct()
    others = current.withColumn("_k", F.lower("key")).join(touched, ["kind", "_k"], "left_anti").drop("_k")
    return others.select("kind", "key", "tag").unionByName(wanted.select("kind", "key", "tag"))


def remove(current: DataFrame, kind: str, key: str) -> DataFrame:
    return current.filter(~((F.col("kind") == kind) & (F.lower("key") == key.lower())))


def removed(current: DataFrame, kind: str, key: str) -> tuple[DataFrame, DataFrame]:
    """What is left without a target, and one row (removed): whether anything went."""
    found = current.filter((F.col("kind") == kind) & (F.lower("key") == key.lower())).agg((F.count(F.lit(1)) > 0).alias("removed"))
    return remove(current, kind, key), found


def listed(annotations: DataFrame, assignments: DataFrame, *, connection: str | None = None, tag: str | None = None, q: str | None = None) -> DataFrame:
    """Annotated or tagged targets: kind, key, description, notes, tags (sorted, comma-joined)."""
    tags = assignments.groupBy("kind", F.lower("key").alias("_k")).agg(F.min("key").alias("_tagged"), F.array_sort(F.collect_set("tag")).alias("_tags"))
    out = annotations.withColumn("_k", F.lower("key")).join(tags, ["kind", "_k"], "full_outer")
    out = out.select("kind", F.coalesce("key", "_tagged").alias("key"), "description", "notes", F.coalesce("_tags", F.array().cast("array<string>")).alias("_tags"))
    if connection:
        out = out.filter(F.startswith(F.lower("key"), F.lit(connection.lower() + "|")))
    if tag:
        out = out.filter(F.exists("_tags", lambda t: F.lower(t) == tag.lower()))
    if q:
        out = out.filter(F.contains(F.lower(F.concat_ws("\n", "key", "description", "notes")), F.lit(q.lower())))
    return out.select("kind", "key", "description", "notes", F.array_join("_tags", ",").alias("tags"))


def page_of(annotations: DataFrame, assignments: DataFrame, *, limit: int = 50, offset: int = 0, **chosen) -> DataFrame:
    """One page of listed(), by key without case, then kind, then key, with the total of all pages."""
    rows = listed(annotations, assignments, **chosen).withColumn("_key", F.lower("key"))
    return page(rows, {"key": "_key"}, "key", False, ["kind", "key"], limit, offset, "key").drop("_key")


def tag_counts(tags: DataFrame, assignments: DataFrame) -> DataFrame:
    n = assignments.groupBy(F.lower("tag").alias("_t")).agg(F.count(F.lit(1)).alias("n"))
    return tags.join(n, F.lower("tag") == F.col("_t"), "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"))


def spelled_as_in(targets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Target keys in the catalog's spelling where it has them. targets: key; catalog: key."""
    known = catalog.select(F.lower("key").alias("_k"), F.col("key").alias("_known")).dropDuplicates(["_k"])
    return targets.join(known, F.lower("key") == F.col("_k"), "left").select(F.coalesce("_known", "key").alias("key"))
