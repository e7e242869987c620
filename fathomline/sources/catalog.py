"""Catalog and statistics rowsets of a scanned estate, as relations over the source's system tables.

Each function takes the system tables it needs as DataFrames, whose column names are the source's own, so the same code
runs over a JDBC source, over files, or over fixtures.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import average, object_kind, type_display

USER_CODES = ("U", "V", "P", "PC", "FN", "IF", "TF", "FS", "FT", "TR", "TA", "SN", "SO")


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A source query over JDBC; the driver's class and credentials come as options."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def jdbc_table(spark: SparkSession, url: str, table: str, column: str | None = None, partitions: int = 16, fetch: int = 10_000, **options: str) -> DataFrame:
    """A source table over JDBC in ranges of a numeric column, so that executors read it side by side; filters and columns asked for later go to the source.

    The bounds come from one query to the source (smallest and largest value); rows with nulls are in the first range. Without
    a column, or in a table without rows, there is one partition.
    """
    reader = lambda: spark.read.format("jdbc").options(url=url, fetchsize=str(fetch), **options)
    if column:
        low, high = reader().option("query", f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}").load().first()
        if low is not None:
            bounds = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(int(high) + 1), "numPartitions": str(max(1, min(partitions, int(high) - int(low) + 1)))}
            return reader().options(dbtable=table, **bounds).load()
    return reader().option("dbtable", table).load()


def objects(sys_objects: DataFrame, sys_schemas: DataFrame, table_types: DataFrame | None = None) -> DataFrame:
    """User objects with their kinds; table types appended. Unknown codes are dropped."""
    schemas = sys_schemas.select("schema_id", F.col("name").alias("schema_name"))
    code = F.rtrim("type")
    found = sys_objects.filter(code.isin(*USER_CODES) & ~F.col("is_ms_shipped")).join(schemas, "schema_id")
    rows = found.select("object_id", "schema_name", "name", code.alias("type"), F.when(F.col("parent_object_id") != 0, F.col("parent_object_id")).alias("parent_object_id"))
    if table_types is not None:
        types = table_types.join(schemas, "schema_id").select(F.col("type_table_object_id").alias("object_id"), "schema_name", "name", F.lit("TT").alias("type"))
        rows = rows.unionByName(types, allowMissingColumns=True)
    return rows.withColumn("kind", object_kind(F.col("type"))).filter("kind IS NOT NULL")


def triggers(sys_triggers: DataFrame, trigger_events: DataFrame) -> DataFrame:
    """Triggers of tables, their events in order as one text."""
    events = trigger_events.groupBy("object_id").agg(F.array_join(F.array_sort(F.collect_list("type_desc")), ",").alias("events"))
    return sys_triggers.filter("parent_class = 1").join(events, "object_id", "left")


def _own(rows: DataFrame, sys_objects: DataFrame, codes: tuple[str, ...] | None = None) -> DataFrame:
    """rows (with object_id) of objects that a user made, of the given type codes."""
    kept = sys_objects.filter(~F.col("is_ms_shipped"))
    if codes:
        kept = kept.filter(F.rtrim("type").isin(*codes))
    return rows.join(kept.select("object_id"), "object_id", "left_semi")


def _typed(rows: DataFrame, sys_types: DataFrame) -> DataFrame:
    """rows with user_type_id and system_type_id, with type_name, system_type_name, is_user_defined and type_schema_id."""
    named = sys_types.select("user_type_id", F.col("name").alias("type_name"), "is_user_defined", F.col("schema_id").alias("type_schema_id"))
    system = sys_types.select(F.col("user_type_id").alias("system_type_id"), F.col("name").alias("system_type_name"))
    return rows.join(named, "user_type_id").join(system, "system_type_id", "left")


def columns(sys_columns: DataFrame, sys_objects: DataFrame, sys_types: DataFrame, computed: DataFrame, defaults: DataFrame, identities: DataFrame) -> DataFrame:
    """Columns of tables, views, functions and table types, with what is known of computed ones, defaults and identities."""
    of_computed = computed.select("object_id", "column_id", F.col("definition").alias("computed_definition"), "is_persisted")
    of_default = defaults.select(F.col("object_id").alias("default_object_id"), F.col("name").alias("default_name"), F.col("definition").alias("default_definition"))
    of_identity = identities.select("object_id", "column_id", "seed_value", "increment_value")
    rows = _typed(_own(sys_columns, sys_objects, ("U", "V", "TF", "IF", "TT")), sys_types)
    rows = rows.join(of_computed, ["object_id", "column_id"], "left").join(of_default, "default_object_id", "left").join(of_identity, ["object_id", "column_id"], "left")
    return rows.withColumn("shown_type", type_display(F.coalesce("type_name", "system_type_name"), F.col("max_length"), F.col("precision"), F.col("scale"), F.col("is_user_defined")))


def parameters(sys_parameters: DataFrame, sys_objects: DataFrame, sys_types: DataFrame) -> DataFrame:
    """Parameters of modules; parameter 0 is what the module returns."""
    return _typed(_own(sys_parameters, sys_objects), sys_types).withColumn("is_return_value", F.col("parameter_id") == 0)


def indexes(sys_indexes: DataFrame, sys_objects: DataFrame, data_spaces: DataFrame) -> DataFrame:
    """Indexes of tables and views, without heaps."""
    spaces = data_spaces.select("data_space_id", F.col("name").alias("data_space_name"), F.col("type").alias("data_space_type"))
    return _own(sys_indexes.filter("index_id > 0"), sys_objects, ("U", "V")).join(spaces, "data_space_id", "left")


def index_columns(sys_index_columns: DataFrame, sys_objects: DataFrame, sys_columns: DataFrame) -> DataFrame:
    """Key and included columns of indexes, with their names."""
    names = sys_columns.select("object_id", "column_id", F.col("name").alias("column_name"))
    return _own(sys_index_columns.filter("index_id > 0"), sys_objects).join(names, ["object_id", "column_id"])


def not_shipped(rows: DataFrame) -> DataFrame:
    """Foreign keys and check constraints: those that a user made."""
    return rows.filter(~F.col("is_ms_shipped"))


foreign_keys = check_constraints = not_shipped


def extended_properties(properties: DataFrame) -> DataFrame:
    """Descriptions of objects and columns (class 1), parameters (2), schemas (3) and indexes (7)."""
    return properties.filter((F.col("name") == "MS_Description") & F.col("class").isin(1, 2, 3, 7)).select("class", "major_id", "minor_id", "name", F.col("value").cast("string").alias("value"))


def modules(sql_modules: DataFrame, sys_objects: DataFrame) -> DataFrame:
    return _own(sql_modules, sys_objects)


def synonyms(sys_synonyms: DataFrame) -> DataFrame:
    return sys_synonyms.select("object_id", "name", "base_object_name")


def dependencies(expression_dependencies: DataFrame) -> DataFrame:
    """What objects (class 1, not indexes or triggers of databases) name."""
    return expression_dependencies.filter("referencing_class = 1")


def database_info(databases: DataFrame, name: str) -> DataFrame:
    return databases.filter(F.lower("name") == name.lower()).select("database_id", "name", "collation_name", "compatibility_level", "state_desc", "is_read_only")


def server_info(spark: SparkSession) -> DataFrame:
    """One row about the engine that answers: version, master, when it started, how callers are known to it."""
    context = spark.sparkContext
    return spark.createDataFrame([(spark.version, context.master, context.startTime, context.getConf().get("spark.authenticate", "false"))], "version string, server string, start_ms long, auth_scheme string")


def permissions(granted: DataFrame, principal: str) -> DataFrame:
    """One row of three booleans: what a principal may see. granted: principal, permission."""
    has = lambda p: F.coalesce(F.bool_or(F.upper("permission") == p), F.lit(False))
    own = granted.filter(F.lower("principal") == principal.lower())
    return own.agg(*(has(p.replace("_", " ").upper()).alias(p) for p in ("view_server_state", "view_database_state", "view_definition")))


def table_stats(partitions: DataFrame) -> DataFrame:
    """partitions: object_id, index_id, partition, rows, data_pages, used_pages, reserved_pages, compression."""
    base = F.col("index_id").isin(0, 1)
    data = F.sum(F.when(base, F.col("data_pages")).otherwise(0))
    return partitions.groupBy("object_id").agg(
        F.sum(F.when(base, F.col("rows")).otherwise(0)).alias("row_count"),
        (data * 8).alias("data_kb"),
        ((F.sum("used_pages") - data) * 8).alias("index_kb"),
        (F.sum("reserved_pages") * 8).alias("reserved_kb"),
        F.countDistinct("partition").alias("partition_count"),
        F.max(F.when(F.col("index_id") == 0, 1).otherwise(0)).alias("is_heap"),
        F.min("compression").alias("compression_min"),
        F.max("compression").alias("compression_max"),
    )


def execution_stats(**sources: DataFrame) -> DataFrame:
    """One row per object and kind from any number of sources, named by kind: object_id, executions, elapsed, last_run, cached and, where known, cpu and reads."""
    names = ["object_id", "kind", "executions", "elapsed", "cpu", "reads", "last_run", "cached"]
    tagged = [df.withColumns({"kind": F.lit(kind), **{c: F.lit(None).cast("long") for c in ("cpu", "reads") if c not in df.columns}}).select(names) for kind, df in sources.items()]
    return execution_totals(reduce(DataFrame.unionByName, tagged))


def execution_totals(rows: DataFrame) -> DataFrame:
    """Sums per object and kind; rows: object_id, kind, executions, elapsed, last_run, cached, cpu, reads. The average is in whole units, null without executions."""
    out = rows.groupBy("object_id", "kind").agg(
        F.sum("executions").alias("executions"), F.sum("elapsed").alias("total_elapsed"), F.min("elapsed").alias("min_elapsed"), F.max("elapsed").alias("max_elapsed"),
        F.sum("cpu").alias("total_cpu"), F.sum("reads").alias("total_reads"), F.max("last_run").alias("last_run"), F.min("cached").alias("cached"),
    )
    return out.withColumn("avg_elapsed", average(F.col("total_elapsed"), F.col("executions")))


def missing_indexes(groups: DataFrame, group_stats: DataFrame, details: DataFrame) -> DataFrame:
    return details.join(groups, "index_handle").join(group_stats, "group_handle")


def foreign_key_columns(pairs: DataFrame, columns: DataFrame) -> DataFrame:
    """Column names of both ends; the columns table plays two roles."""
    near = columns.select(F.col("object_id").alias("parent_object_id"), F.col("column_id").alias("parent_column_id"), F.col("name").alias("parent_column"))
    far = columns.select(F.col("object_id").alias("referenced_object_id"), F.col("column_id").alias("referenced_column_id"), F.col("name").alias("referenced_column"))
    return pairs.join(near, ["parent_object_id", "parent_column_id"]).join(far, ["referenced_object_id", "referenced_column_id"])


def index_usage(indexes: DataFrame, usage: DataFrame) -> DataFrame:
    """Every index with its counters; without any they are 0."""
    counters = [c for c in usage.columns if c not in ("object_id", "index_id")]
    return indexes.join(usage, ["object_id", "index_id"], "left").fillna(0, counters)


#: Spark's error classes of jobs that were interrupted.
CANCELLED = ("SPARK_JOB_CANCELLED", "OPERATION_CANCELED")


def cancelled(error: BaseException) -> bool:
    return isinstance(error, KeyboardInterrupt) or any(f"[{c}]" in str(error) for c in CANCELLED)


def attempted(**sources) -> tuple[dict[str, DataFrame], list[str]]:
    """Each source's rows if they can be read, else a warning: sources are functions without arguments."""
    found, warnings = {}, []
    for name, load in sources.items():
        try:
            found[name] = load()
        except Exception as error:  # any failure of one family leaves the others; one that was cancelled isn't a failure
            if cancelled(error):
                raise
            warnings.append(f"{name}: {type(error).__name__}")
    return found, warnings
