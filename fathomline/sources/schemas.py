"""The tables of a snapshot with declared columns. A scan's tables are written under its number; the last four outlive scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

OBJECT = "db string, object_id long"

SCHEMAS = {
    "scans": "scan long, connection string, status string, started timestamp_ntz, finished timestamp_ntz, error string",
    "databases": "db string, database_id int, collation_name string, compatibility_level int, is_configured boolean, selected array<string>",
    "objects": "node string, object_key string, db string, schema string, name string, kind string, scope string, definition string, description string, modified timestamp_ntz, id long, parent_id long",
    "columns": f"{OBJECT}, column_id int, name string, shown_type string, is_nullable boolean, is_identity boolean, computed_definition string, default_definition string, description string, id long, of_object long",
    "parameters": f"{OBJECT}, parameter_id int, name string, type_name string, is_output boolean, is_return_value boolean, id long, of_object long",
    "indexes": f"{OBJECT}, index_id int, name string, type_desc string, is_unique boolean, is_primary_key boolean, filter_definition string, data_space_name string, id long, of_object long",
    "index_columns": f"{OBJECT}, index_id int, column_id int, column_name string, key_ordinal int, is_descending_key boolean, is_included_column boolean, of_object long, of_index long, of_column long",
    "foreign_keys": "db string, object_id long, name string, parent_object_id long, referenced_object_id long, is_disabled boolean, id long, of_parent long, of_referenced long",
    "foreign_key_columns": "db string, constraint_object_id long, parent_column string, referenced_column string, ordinal int, of_key long",
    "check_constraints": "db string, object_id long, name string, parent_object_id long, definition string, is_disabled boolean, of_parent long",
    "dependencies": "source string, target string, kind string, resolution string, minor_id int, referenced_name string, of_source long, of_target long",
    "externals": "external_key string, server string, db string, schema string, name string",
    "column_lineage": "owner string, source_node string, source_id string, source_name string, target_node string, target_id string, via_object string, via string, confidence string, transform string, statement int, expression string",
    "table_stats": f"{OBJECT}, row_count long, data_kb long, index_kb long, reserved_kb long, partition_count long, is_heap int, compression_min string, compression_max string, of_object long",
    "index_usage": f"{OBJECT}, index_id int, seeks long, scans long, lookups long, updates long, is_unused boolean, of_object long, of_index long",
    "proc_stats": f"{OBJECT}, kind string, executions long, total_elapsed long, min_elapsed long, max_elapsed long, avg_elapsed long, total_cpu long, total_reads long, last_run timestamp_ntz, cached timestamp_ntz, of_object long",
    "missing_indexes": f"{OBJECT}, index_handle int, equality_columns string, inequality_columns string, included_columns string, improvement double, suggested_ddl string, of_object long",
    "lineage_issues": "node string, statement int, issue string, message string",
    "warnings": "warning string",
    "annotations": "kind string, key string, description string, notes string, owner string",
    "tags": "tag string, color string",
    "tag_assignments": "kind string, key string, tag string",
    "meta": "key string, value string",
}


def conformed(rows: DataFrame, table: str) -> DataFrame:
    """rows with exactly the declared columns: others are left out, missing ones are null. Undeclared tables stay as they are."""
    if table not in SCHEMAS:
        return rows
    have = {c.lower(): c for c in rows.columns}
    declared = StructType.fromDDL(SCHEMAS[table])
    return rows.select(*((F.col(f"`{have[f.name]}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared))
