"""Scalar functions over catalog values, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Catalog type codes and what they stand for.
KIND_BY_CODE = {
    "U": "table", "V": "view", "P": "procedure", "PC": "procedure", "FN": "scalar_function", "IF": "inline_tvf", "TF": "table_function",
    "FS": "clr_function", "FT": "clr_function", "TR": "trigger", "TA": "trigger", "SN": "synonym", "SO": "sequence", "TT": "table_type",
}
WIDE, SIZED, EXACT, SCALED = ("nchar", "nvarchar"), ("char", "varchar", "binary", "varbinary"), ("decimal", "numeric"), ("datetime2", "time", "datetimeoffset")
CONFIDENCE = {"unresolved": 0, "inferred": 1, "exact": 2}
# End of fixed values.

_PART = r"\s*+(\[[^\]]*+(?:\]\][^\]]*+)*+\]|\"[^\"]*+(?:\"\"[^\"]*+)*+\"|[^.\[\"]*+)\s*+\."


def lookup(value: Column, mapping: dict) -> Column:
    """mapping[value]; null for values that aren't in it."""
    return reduce(lambda c, kv: c.when(value == kv[0], F.lit(kv[1])), mapping.items(), F.when(F.lit(False), F.lit(next(iter(mapping.values())))))


def object_kind(code: Column) -> Column:
    return lookup(F.upper(F.trim(code)), KIND_BY_CODE)


def type_display(name: Column, max_length: Column, precision: Column, scale: Column, user_defined: Column) -> Column:
    """The way the source's own tools show a type, such as nvarchar(50)."""
    t, size = F.lower(name), lambda n: F.when(max_length == -1, F.lit("(max)")).otherwise(F.concat(F.lit("("), n.cast("string"), F.lit(")")))
    return (
        F.when(F.coalesce(user_defined, F.lit(False)), name)
        .when(t.isin(*WIDE), F.concat(t, size(F.floor(F.coalesce(max_length, F.lit(0)) / 2))))
        .when(t.isin(*SIZED), F.concat(t, size(max_length)))
        .when(t.isin(*EXACT), F.concat(t, F.lit("("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")")))
        .when(t.isin(*SCALED), F.concat(t, F.lit("("), scale.cast("string"), F.lit(")")))
        .otherwise(t)
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used: Spark works out again what a branch of WHEN repeats."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def name_parts(name: Column) -> Column:
    """One to four name parts, unquoted; an empty middle part is null. Null where the name isn't well formed."""
    dotted = F.concat(name, F.lit("."))
    whole = F.length(F.array_join(F.regexp_extract_all(dotted, F.lit(_PART), F.lit(0)), "")) == F.length(dotted)

    def plain(p: Column) -> Column:
        p = F.trim(p)
        inner = F.substring(p, F.lit(2), F.length(p) - 2)
        return F.when(p.startswith("["), F.replace(inner, F.lit("]]"), F.lit("]"))).when(p.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).when(p != "", p)

    checked = lambda parts: F.when(whole & F.size(parts).between(1, 4) & F.element_at(parts, -1).isNotNull(), parts)
    return _once(F.transform(F.regexp_extract_all(dotted, F.lit(_PART), F.lit(1)), plain), checked)


def multipart(name: Column) -> Column:
    """struct(server, db, schema, name) of a name of one to four parts."""
    at = lambda parts, i: F.get(parts, F.lit(i))
    named = lambda p: F.when(p.isNotNull(), F.struct(at(p, 3).alias("server"), at(p, 2).alias("db"), at(p, 1).alias("schema"), at(p, 0).alias("name")))
    return _once(F.reverse(name_parts(name)), named)


def display(server: Column, db: Column, schema: Column, name: Column) -> Column:
    """Parts joined by dots, without leading nulls; an inner null prints empty."""
    return F.concat(
        F.when(server.isNotNull(), F.concat(server, F.lit("."))).otherwise(""),
        F.when(db.isNotNull() | server.isNotNull(), F.concat(F.coalesce(db, F.lit("")), F.lit("."))).otherwise(""),
        F.when(schema.isNotNull() | db.isNotNull() | server.isNotNull(), F.concat(F.coalesce(schema, F.lit("")), F.lit("."))).otherwise(""),
        name,
    )


def object_key(*parts: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))


def external_key(server: Column, db: Column, schema: Column, name: Column) -> Column:
    return object_key(F.lit("external"), server, db, schema, name)


def target_key(key: Column) -> Column:
    """struct(connection, db, schema, name, column) of an object or column key; of external or short keys only the name."""
    p = F.split(key, r"\|")
    part = lambda i: F.when((F.size(p) >= 4) & (p[0] != "external"), F.get(p, F.lit(i)))
    long = (F.size(p) >= 4) & (p[0] != "external")
    rest = F.when(long & (F.size(p) > 4), F.array_join(F.slice(p, 5, F.greatest(F.size(p) - 4, F.lit(0))), "|"))
    return F.struct(part(0).alias("connection"), part(1).alias("db"), part(2).alias("schema"), F.when(long, p[3]).otherwise(F.element_at(p, -1)).alias("name"), rest.alias("column"))


def quote_ident(name: Column) -> Column:
    return F.concat(F.lit("["), F.replace(name, F.lit("]"), F.lit("]]")), F.lit("]"))


def _listed(columns: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(columns, F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")


def suggested_index(schema: Column, table: Column, equality: Column, inequality: Column, included: Column) -> Column:
    """DDL for a missing index."""
    keys = F.concat(_listed(equality), _listed(inequality))
    bare = F.transform(keys, lambda c: F.regexp_replace(c, r"[\[\]]", ""))
    name = F.concat(F.lit("IX_"), table, F.lit("_"), F.array_join(bare, "_"))
    include = F.when(F.size(_listed(included)) > 0, F.concat(F.lit(" INCLUDE ("), F.array_join(_listed(included), ", "), F.lit(")"))).otherwise("")
    return F.concat(F.lit("CREATE INDEX "), quote_ident(name), F.lit(" ON "), quote_ident(schema), F.lit("."), quote_ident(table), F.lit(" ("), F.array_join(keys, ", "), F.lit(")"), include, F.lit(";"))


def improvement_measure(cost: Column, impact: Column, seeks: Column, scans: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return zero(cost) * zero(impact) * (zero(seeks) + zero(scans))


def average(total: Column, count: Column) -> Column:
    """Whole units; null without executions."""
    return F.when(count > 0, F.floor(total / count)).cast("long")


def is_unused(primary: Column, unique_constraint: Column, type_code: Column, *uses: Column) -> Column:
    used = reduce(lambda a, b: a + b, (F.coalesce(u, F.lit(0)) for u in uses))
    return ~F.coalesce(primary, F.lit(False)) & ~F.coalesce(unique_constraint, F.lit(False)) & (type_code >= 2) & (used == 0)


def total_size_kb(reserved: Column, data: Column, index: Column) -> Column:
    return F.coalesce(reserved, F.when(data.isNotNull() | index.isNotNull(), F.coalesce(data, F.lit(0)) + F.coalesce(index, F.lit(0))))


def us_to_ms(us: Column) -> Column:
    return us / 1000.0


def snippet(text: Column, needle: str, around: int = 60, head: int = 120) -> Column:
    """The text around the first match, whatever its case; without a match its beginning."""
    at, n = F.locate(needle.lower(), F.lower(text)), len(needle)
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + n + around, F.length(text) + 1)
    found = F.concat(F.when(start > 1, F.lit("...")).otherwise(""), F.substring(text, start, end - start), F.when(end <= F.length(text), F.lit("...")).otherwise(""))
    return F.when(at > 0, found).otherwise(F.substring(text, 1, head))


def compression(low: Column, high: Column) -> Column:
    return F.when(low.eqNullSafe(high), low).otherwise(F.lit("MIXED"))


def confidence_rank(confidence: Column) -> Column:
    return F.coalesce(lookup(confidence, CONFIDENCE), F.lit(0))
