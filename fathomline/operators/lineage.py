"""From what modules name to stored lineage: references and column edges resolved against a snapshot's objects by joins.

objects: node, db, schema, name, kind; columns: column, node, name. Names are compared without case; a name without a
schema is looked up in `dbo`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import confidence_rank, multipart
from .keys import looked_up


def named_objects(names: DataFrame, objects: DataFrame, column: str = "name") -> DataFrame:
    """names (with db) and `node` of the object that the name in `column` stands for, null where there is none; of equal names the smallest node."""
    p = names.withColumn("_p", multipart(F.col(column)))
    by = objects.select(F.lower("db").alias("_d"), F.lower("schema").alias("_s"), F.lower("name").alias("_n"), "node").groupBy("_d", "_s", "_n").agg(F.min("node").alias("id"))
    return looked_up(p, by, [(F.lower(F.coalesce("_p.db", "db")), "_d"), (F.lower(F.coalesce("_p.schema", F.lit("dbo"))), "_s"), (F.lower("_p.name"), "_n")], "node", required=False).drop("_p")


def parsed_dependencies(references: DataFrame, owners: DataFrame, objects: DataFrame) -> DataFrame:
    """source, target, kind, referenced_name, resolution. references: module, ref, name; owners: module, owner (node), db.

    References to the module itself are dropped, equal ones stored once, temporary names left out.
    """
    refs = references.filter("name NOT RLIKE '^[#@]'").join(owners, "module").select("owner", "db", "ref", "name").distinct()
    found = named_objects(refs, objects)
    kind = F.when(F.col("ref") == "write", "parsed_write").when(F.col("ref") == "exec", "parsed_exec").otherwise("parsed_read")
    out = found.filter("node IS NULL OR node <> owner").select(F.col("owner").alias("source"), F.col("node").alias("target"), kind.alias("kind"), F.lower("name").alias("_n"), F.col("name"), F.when(F.col("node").isNotNull(), "resolved").otherwise("unresolved").alias("resolution"))
    return out.groupBy("source", "target", "kind", "resolution", F.when(F.col("target").isNull(), F.col("_n")).alias("_n")).agg(F.min("name").alias("referenced_name")).drop("_n")


def stored_edges(edges: DataFrame, objects: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with source_column and target_column, issues). edges: owner, db, target, target_column, source, source_column, confidence, transform, statement.

    A target table that isn't known gives one issue per owner and name; a column that the target lacks drops the edge; a
    source that isn't known keeps its name. Equal edges are stored once, the first statement's spelling first.
    """
    cols = columns.select(F.col("node").alias("_cn"), F.lower("name").alias("_cname"), "column")
    t = named_objects(edges, objects, "target").withColumnRenamed("node", "target_node")
    issues = t.filter("target_node IS NULL").select("owner", F.lower("target").alias("_t"), "target").groupBy("owner", "_t").agg(F.min("target").alias("name")).select("owner", "name", F.lit("unresolved_ref").alias("issue"))
    t = t.join(cols, (F.col("target_node") == F.col("_cn")) & (F.lower("target_column") == F.col("_cname"))).drop("_cn", "_cname").withColumnRenamed("column", "target_id")
    s = named_objects(t, objects, "source").withColumnRenamed("node", "source_node")
    s = looked_up(s, cols.withColumnRenamed("column", "id"), [(F.col("source_node"), "_cn"), (F.lower("source_column"), "_cname")], "source_id", required=False)
    s = s.withColumn("source_name", F.when(F.col("source_id").isNull(), F.concat_ws(".", "source", "source_column")))
    first = Window.partitionBy("source_node", "source_id", F.lower("source_name"), "target_id", "statement", "transform").orderBy("owner", "source_name", confidence_rank(F.col("confidence")).desc(), "confidence")
    kept = s.withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    return kept.select("owner", "source_id", "source_name", "target_id", "confidence", "transform", "statement"), issues


#: Rows that one part of them holds.
PART_ROWS = 1 << 18


def parts(rows: DataFrame) -> int:
    """How many parts of PART_ROWS the rows fill; one number goes to the driver."""
    return max(1, ceil(rows.count() / PART_ROWS))


def _dealt(rows: DataFrame, among: int | None, *keys: str) -> DataFrame:
    return rows.repartition(among, *keys) if among else rows


def _spelled(name: str) -> Column:
    """The first statement's spelling, then the smallest."""
    return F.min_by(name, F.struct("statement", name)).alias("name")


@dataclass(frozen=True)
class Stored:
    """edges; the temporary tables and table variables of modules as objects; the columns that modules make; issues."""

    edges: DataFrame
    objects: DataFrame
    mentioned: DataFrame  # every mention of a column that a module makes
    issues: DataFrame
    given: DataFrame  # the edges that all of it is made of
    among: int | None  # parts() of them, if known

    def __iter__(self) -> Iterator[DataFrame]:
        return iter((self.edges, self.objects, self.columns, self.issues))

    @property
    def columns(self) -> DataFrame:
        """node, column_kind, resultset, column, name, ordinal. Mentions are dealt by node once, in parts that don't grow with the
        edges: their grouping and numbering stay there. An edge mentions one in its target and one in its source at most."""
        each = self.mentioned.repartition(2 * (self.among or parts(self.given)), "node").groupBy("node", "column_kind", "resultset", "column").agg(_spelled("name"), F.min("statement").alias("_first"))
        order = Window.partitionBy("node", "column_kind", "resultset").orderBy("_first", "column")
        return each.withColumn("ordinal", F.row_number().over(order)).drop("_first")


def stored_lineage(edges: DataFrame, objects: DataFrame, columns: DataFrame, among: int | None = None) -> Stored:
    """Column edges of modules with every kind of target, by joins with the catalog.

    edges: owner, db, target_kind, target, target_column, resultset, source, source_column, confidence, transform, statement.
    `self` is the module, whose column must exist (a scalar function's is made as `return_value`); `resultset` a column that
    the module returns; `temp` and `tablevar` (names with # or @) belong to the module, so each module has its own; `table`
    is looked up, and an unknown one gives one issue per owner and name. Sources with # or @ are the module's own too; a
    source without a column (or `*`) is the whole object, one that isn't known keeps its name. Ids of what modules make hold
    the lower-case name, so no join is needed for them; the spelling is the first statement's, then the smallest. Of edges
    with equal ends, statement and transform that of the smallest owner with the highest confidence stays. An edge without
    a target column is dropped. among: parts() of the edges, if they are known from what the edges are made of; joins by module are
    dealt in as many then, else as Spark sees fit.
    """
    made, whole = F.col("source").rlike("^[#@]"), F.col("source_column").isNull() | (F.col("source_column") == "*")
    own = lambda name: F.concat_ws("|", "owner", F.lower(name))
    under = lambda node, name: F.concat_ws("|", node, F.lower(name))
    known = objects.filter("kind <> 'external'")
    cols = columns.select(F.col("node").alias("_cn"), F.lower("name").alias("_cname"), F.col("column").alias("id"))

    edges = edges.filter("target_column IS NOT NULL")
    temp, result = F.col("target_kind").isin("temp", "tablevar"), F.col("target_kind") == "resultset"
    target = lambda rows, node, id_, kind: rows.withColumns({"target_node": node, "target_id": id_, "column_kind": kind}).select(*edges.columns, "target_node", "target_id", "column_kind")
    # Each kind of target takes the joins that it needs: rows of what modules make pass none, so they neither fill nor widen the look-ups of others.
    node = F.when(temp, own("target")).otherwise(F.col("owner"))
    made_id = F.when(temp, under(node, "target_column")).otherwise(F.concat_ws("|", node, F.concat(F.lit("#rs"), F.col("resultset").cast("string")), F.lower("target_column")))
    by_modules = target(edges.filter(temp | result), node, made_id, F.when(temp, "column").otherwise("resultset"))
    named = named_objects(edges.filter("target_kind = 'table'"), known, "target")
    lost = named.filter("node IS NULL").groupBy("owner", F.lower("target").alias("_t"))
    issues = lost.agg(F.min_by("target", F.struct("statement", "target")).alias("name"), F.min("statement").alias("statement")).select("owner", "name", "statement", F.lit("unresolved_ref").alias("issue"))
    tables = target(looked_up(named, cols, [(F.col("node"), "_cn"), (F.lower("target_column"), "_cname")], "_id"), F.col("node"), F.col("_id"), F.lit(None).cast("string"))
    selves = edges.filter(~(temp | result | (F.col("target_kind") == "table"))).withColumn("_c", F.lower("target_column"))
    kinds = _dealt(objects.select(F.col("node").alias("owner"), F.col("kind").alias("_kind")), among, "owner")
    selves = _dealt(selves, among, "owner").join(kinds, "owner", "left")
    selves = _dealt(selves, among, "owner", "_c").join(_dealt(cols.select(F.col("_cn").alias("owner"), F.col("_cname").alias("_c"), "id"), among, "owner", "_c"), ["owner", "_c"], "left")
    returned = (F.col("target_kind") == "self") & F.col("id").isNull() & (F.col("_kind") == "scalar_function")
    selves = target(selves, F.col("owner"), F.coalesce("id", F.when(returned, under("owner", "target_column"))), F.when(returned, "return_value"))
    t = by_modules.unionByName(tables).unionByName(selves).filter("target_id IS NOT NULL")

    s = named_objects(t.withColumn("_name", F.when(~made, F.col("source"))), known, "_name").drop("_name")
    s = s.withColumn("source_node", F.when(made, own("source")).otherwise(F.col("node"))).drop("node")
    s = looked_up(s, cols, [(F.when(~made, F.col("source_node")), "_cn"), (F.lower("source_column"), "_cname")], "column", required=False)
    s = s.withColumn("source_id", F.when(made & ~whole, under("source_node", "source_column")).otherwise(F.col("column"))).drop("column")
    name = F.when(F.col("source_id").isNull(), F.when(F.col("source_node").isNull(), F.concat_ws(".", "source", "source_column")).otherwise(F.col("source_column")))
    s = s.withColumns({"source_name": name, "via_object": F.when(temp | (F.col("target_kind") == "table"), F.col("owner"))})
    key = ["source_node", "source_id", "source_name", "target_node", "target_id", "statement", "transform"]
    first = F.min(F.struct("owner", (-confidence_rank(F.col("confidence"))).alias("rank"), "confidence", "via_object")).alias("_f")
    kept = s.groupBy(*key).agg(first).select(*key, "_f.owner", "_f.confidence", "_f.via_object")

    mentions = edges.filter(temp).select("owner", F.col("target").alias("name"), F.col("target_column").alias("column"), "statement")
    mentions = mentions.unionByName(t.filter(made).select("owner", F.col("source").alias("name"), F.when(~whole, F.col("source_column")).alias("column"), "statement"))
    owners = objects.select(F.col("node").alias("parent"), "db", "schema")
    pseudo = mentions.groupBy("owner", own("name").alias("node")).agg(_spelled("name")).select("node", "name", F.lit("temp_table").alias("kind"), F.col("owner").alias("parent")).join(owners, "parent", "left")
    of_modules = t.filter("column_kind <> 'column'").select(F.col("target_node").alias("node"), F.col("target_column").alias("name"), "column_kind", F.when(result, F.col("resultset")).alias("resultset"), F.col("target_id").alias("column"), "statement")
    of_temps = mentions.filter("column IS NOT NULL").select(own("name").alias("node"), F.col("column").alias("name"), F.lit("column").alias("column_kind"), F.lit(None).cast("int").alias("resultset"), under(own("name"), "column").alias("column"), "statement")
    return Stored(kept, pseudo, of_modules.unionByName(of_temps), issues, edges, among)


def computed_columns(definitions: DataFrame, columns: DataFrame) -> DataFrame:
    """Edges of computed columns: node, column, definition -> source, target, inferred, computed. Bracketed or plain names of the same table count."""
    names = F.array_distinct(F.transform(F.regexp_extract_all("definition", F.lit(r"\[[^\]]*+(?:\]\][^\]]*+)*+\]|[A-Za-z_]\w*+"), F.lit(0)), lambda n: F.lower(F.regexp_replace(n, r"^\[|\]$", ""))))
    each = definitions.select("node", F.col("column").alias("target"), F.explode(names).alias("_name"))
    own = columns.select("node", F.lower("name").alias("_name"), F.col("column").alias("source"))
    return each.join(own, ["node", "_name"]).filter("source <> target").select("source", "target", F.lit("inferred").alias("confidence"), F.lit("computed").alias("transform"))
