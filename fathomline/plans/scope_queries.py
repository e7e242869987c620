"""The rules of scope closure at table size: the catalog of queries.cascade_rules once for each customer, with ids and names of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cascade
from .estate import table
from .queries import _RULE_DEPS, _RULE_EDGES, _RULE_OBJECTS, query, values_sql


def _each(s, d, rows: list[tuple], fields: str) -> DataFrame:
    """The rows for each customer. Fields whose name ends in id grow by 100 for each; names end in the key, but for trigger tables."""
    named = [f.split() for f in fields.split(", ")]
    made = F.array(*(F.struct(*(F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, named, strict=True))) for row in rows))
    out = table(s, d, "customer").select("c_custkey", F.explode(made).alias("_r")).select("c_custkey", "_r.*")
    ids = {n: F.col(n) + 100 * F.col("c_custkey") for n, kind in named if n.endswith("_id") and kind == "long"}
    own = lambda n: F.when(F.lower(n).isin("inserted", "deleted"), F.col(n)).otherwise(F.concat(n, F.lit("_"), F.col("c_custkey").cast("string")))
    names = {n: own(n) for n, _ in named if n in ("name", "referenced_entity_name", "base_object_name")}
    return out.withColumns(ids | names).drop("c_custkey")


def _rules(s, d) -> cascade.Closure:
    objects = _each(s, d, [(o[4], *o[:4]) for o in _RULE_OBJECTS], "db string, object_id long, schema string, name string, kind string")
    deps = _each(s, d, [("Port", a, 0, *rest) for a, *rest in _RULE_DEPS], "db string, referencing_id long, referencing_minor int, referenced_id long, referenced_server_name string, referenced_database_name string, referenced_schema_name string, referenced_entity_name string, is_caller_dependent boolean, is_ambiguous boolean").withColumnRenamed("referencing_minor", "referencing_minor_id")
    triggers = _each(s, d, [("Port", 15, 14)], "db string, object_id long, parent_id long")
    synonyms = _each(s, d, [("Port", 16, "hull . CREW")], "db string, object_id long, base_object_name string")
    fks = s.createDataFrame([], "db string, parent_object_id long, referenced_object_id long")
    return cascade.compute_closure(objects, deps, fks, triggers, synonyms, s.createDataFrame([("port", "DECK"), ("Sea", "dbo")], "db string, schema string"), server_name="HARBOURMASTER")


def _key(column: str) -> str:
    return f"split_part({column}, '#', 1) || '#' || (CAST(split_part({column}, '#', 2) AS BIGINT) + 100 * c_custkey)"


@query(f"SELECT {_key('source')} AS source, {_key('target')} AS target, kind, resolution, external_key || '_' || c_custkey AS external_key FROM customer, ({values_sql(_RULE_EDGES, 'source, target, kind, resolution, external_key')})")
def cascade_rules_scale(s, d):
    return _rules(s, d).edges.select("source", "target", "kind", "resolution", "external_key")


_SCOPES = [(k, "cascaded" if k in ("sea#12", "port#13", "port#17", "port#19") else "in_scope") for k in ("port#11", "port#14", "port#15", "port#16", "sea#12", "port#13", "port#17", "port#19")]


@query(f"SELECT {_key('key')} AS key, scope FROM customer, ({values_sql(_SCOPES, 'key, scope')})")
def cascade_rules_scale_scope(s, d):
    return _rules(s, d).scope


@query("SELECT key || '_' || c_custkey AS external_key, server, db, schema, split_part(key, '|', 5) || '_' || c_custkey AS name FROM customer, (VALUES ('external||Moon|tide|Gauge', NULL, 'Moon', 'tide'), ('external|Lighthouse|Moon|dbo|Lamp', 'Lighthouse', 'Moon', 'dbo'), ('external||Moon|dbo|Crater', NULL, 'Moon', 'dbo')) AS v(key, server, db, schema)")
def cascade_rules_scale_externals(s, d):
    return _rules(s, d).externals.select("external_key", "server", "db", "schema", "name")
