"""Column edges of INSERT .. SELECT, UPDATE and MERGE statements, from token rows.

A list (target columns, selected items, SET pairs, values) is cut at the commas of its bracket level: a running count of commas
since the clause's first word gives each token the place of its item. Target and source of a place meet in one grouping by
statement, list and place. All windows and groupings lie within a module. The names of the statements that write are written to the
checkpoint folder once, as lists and tables are both made of them; no code walks through a text.

Limits: a SELECT's tables are those of its own FROM clause; a name that stands for a CTE or a derived table stays the source as it
is (unresolved); names of sub-selects count as names of the item they stand in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .keys import looked_up
from .lineage import named_objects
from .tsql import name_tokens, named_tables, parts, plain_name, runs, statement_tokens

# Functions that aggregate, words of expressions that are no columns, and functions whose first argument is none.
AGGREGATES = "sum count count_big min max avg stdev stdevp var varp string_agg checksum_agg grouping grouping_id approx_count_distinct".split()
NO_COLUMN = "select distinct all top percent ties case when then else end and or not null is in like between as over partition by order rows range unbounded preceding following current row exists any some from join inner left right full outer cross on where group having asc desc escape collate default at time zone within union except intersect".split()
TYPED = ("convert", "try_convert", "dateadd", "datediff", "datediff_big", "datepart", "datename", "datetrunc")
# End of fixed values.

MARKS = {
    "insert": "insert into select from where group having order union except intersect values exec execute output default option".split(),
    "update": "update set from where output option".split(),
    "merge": "merge using on when then update set insert values delete output option".split(),
}


def _any(c: Column, words) -> Column:
    return F.coalesce(c.isin(*words), F.lit(False))


def _listed(t: DataFrame) -> DataFrame:
    """Rows of runs() of the statements that write, with side (target, item or table), list and place."""
    order = Window.partitionBy("module", "index").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    flat = (F.col("depth") == 0) & (F.col("cases") == 0)
    mark = F.when(F.col("kind") == "insert", _any(F.col("word"), MARKS["insert"])).when(F.col("kind") == "update", _any(F.col("word"), MARKS["update"])).otherwise(_any(F.col("word"), MARKS["merge"]))
    comma, opens = F.col("token") == ",", (F.col("token") == "(") & (F.col("depth") == 0)
    t = t.withColumns({"_mark": flat & mark, "_opens": opens})
    t = t.withColumns({
        "_clause": F.last(F.when(F.col("_mark"), F.struct("word", "i")), True).over(order),
        "_opener": F.last(F.when(F.col("_opens"), F.struct("i", F.col("word1").alias("word"))), True).over(order),
        "_c0": F.sum((flat & comma).cast("int")).over(order),
        "_c1": F.sum(((F.col("depth") == 1) & comma).cast("int")).over(order),
        "_eq": F.sum((flat & (F.col("token") == "=")).cast("int")).over(order),
        "_inserts": F.sum((F.col("_mark") & _any(F.col("word"), ["insert"])).cast("int")).over(order),
    })
    # Which list a row may belong to is told before the last window: with what comes after it, it would be more than Java compiles.
    clause, start = F.col("_clause.word"), F.col("_clause.i")
    inner = (F.col("depth") >= 1) & ~F.col("_opens") & ~((F.col("token") == ",") & (F.col("depth") == 1)) & ~((F.col("token") == ")") & (F.col("depth") == 0))
    own = ~F.col("_mark") & ~(flat & comma)
    named = F.col("is_name") & (F.col("depth") == 1)
    skipped = _any(F.col("word"), ["distinct", "all", "top", "percent"]) | (_any(F.col("word1"), ["top"])) | ((F.col("_opener.word") == "top") & (F.col("_opener.i") > start) & ((F.col("depth") > 0) | (F.col("before") != ")")) & ((F.col("depth") > 0) | (F.col("token") == ")")))
    kind = F.col("kind")
    may = (
        F.when((kind == "insert") & clause.isin("insert", "into"), F.when(named & ~_any(F.col("_opener.word"), ["with"]), "into"))
        .when((kind == "insert") & (clause == "select"), F.when(own & ~skipped, "select"))
        .when((kind == "merge") & (clause == "insert"), F.when(named, "names"))
        .when((kind == "merge") & (clause == "values"), F.when(inner, "values"))
        .when((kind != "insert") & (clause == "set"), F.when(own, "set"))
    )
    t = t.withColumns({
        "_may": may,
        "_sets": F.col("is_name") & ~F.col("name").startswith("@") & F.coalesce(F.col("after") == "=", F.lit(False)),
        "_sign": (F.col("token") == "=") & flat,
        "_base0": F.last(F.when(F.col("_mark"), F.col("_c0")), True).over(order),
        "_base1": F.last(F.when(F.col("_opens"), F.col("_c1")), True).over(order),
        "_eqs": F.last(F.when(F.col("_mark") | (flat & comma), F.col("_eq")), True).over(order),
    })
    t = t.filter("_may IS NOT NULL")
    right = F.col("_eq") > F.col("_eqs")
    assigned = F.when(right, ~((F.col("_eq") == F.col("_eqs") + 1) & F.col("_sign"))).otherwise(F.col("_sets"))
    t = t.filter((F.col("_may") != "set") | assigned)
    is_target = F.col("_may").isin("into", "names") | ((F.col("_may") == "set") & ~right)
    lst = F.when(F.col("_may") == "into", "").when(F.col("_may") == "select", F.concat(F.lit("s"), start.cast("string"))).when(F.col("_may") == "set", F.concat(F.lit("p"), start.cast("string"))).otherwise(F.concat(F.lit("v"), F.col("_inserts").cast("string")))
    place = F.when(F.col("_may").isin("select", "set"), F.col("_c0") - F.col("_base0")).otherwise(F.col("_c1") - F.col("_base1"))
    placed = [F.when(is_target, "target").otherwise("item").alias("side"), lst.alias("list"), place.cast("int").alias("place")]
    return t.select("module", "index", "kind", "i", *placed, "name", "word", "word1", "before", "before2", "after", "size", "is_name", "depth")


def _last_part(name: Column) -> Column:
    return plain_name(F.regexp_extract(name, r"(?s)(\[[^\]]*+(?:\]\][^\]]*+)*+\]|\"[^\"]*+(?:\"\"[^\"]*+)*+\"|[^.]*+)\z", 1))


def _items(listed: DataFrame, assigned: bool = False) -> DataFrame:
    """A row for each place of each list: target column, or the item's text, output name, transform and names.

    Items that assign a variable are left out, or kept with the variable as their output name.
    """
    part = F.struct("i", "name", "word", "word1", "before", "before2", "after", "size", "is_name", "depth")
    is_item = F.col("side") == "item"
    g = listed.groupBy("module", "index", "kind", "list", "place").agg(
        F.first(F.when(F.col("side") == "target", _last_part(F.col("name"))), True).alias("column"), F.array_sort(F.collect_list(F.when(is_item, part))).alias("all")
    )
    n, first = F.size("all"), F.col("all")[0]
    at = lambda k: F.try_element_at("all", F.lit(k))
    said = at(-2)["word"] == "as"
    renamed = F.col("list").startswith("s") & (at(2)["name"] == "=") & first["is_name"]
    behind = F.col("list").startswith("s") & (n >= 2) & at(-1)["is_name"] & (at(-1)["depth"] == 0) & ((at(-2)["name"] == ")") | (at(-2)["word"] == "end") | at(-2)["name"].rlike(r"^[0-9']|^N'") | (at(-2)["is_name"] & ~_any(at(-2)["word"], NO_COLUMN))) & ~_any(at(-1)["word"], NO_COLUMN)
    shape = F.when(F.coalesce(said, F.lit(False)), 2).when(F.coalesce(renamed, F.lit(False)), 3).when(F.coalesce(behind, F.lit(False)), 1).otherwise(0)
    g = g.withColumn("_shape", shape)
    cut = F.when(F.col("_shape") == 2, F.slice("all", F.lit(1), n - 2)).when(F.col("_shape") == 3, F.slice("all", F.lit(3), F.greatest(n - 2, F.lit(0)))).when(F.col("_shape") == 1, F.slice("all", F.lit(1), n - 1)).otherwise(F.col("all"))
    g = g.withColumn("expr", cut)
    one = F.size("expr") == 1
    single = one & F.coalesce(F.col("expr")[0]["is_name"] & ~F.col("expr")[0]["name"].startswith("@"), F.lit(False))
    star = one & F.coalesce(F.col("expr")[0]["name"].rlike(r"(?:^|\.)\*$"), F.lit(False))
    column = lambda x: x.is_name & ~x["name"].startswith("@") & ~_any(x.word, NO_COLUMN) & ~F.coalesce(x.after == "(", F.lit(False)) & ~_any(x.word1, ["as", "from", "join", "collate"]) & ~F.coalesce((x.before == "(") & F.lower(x.before2).isin(*TYPED), F.lit(False))
    aggregate = F.exists("expr", lambda x: F.coalesce((x.after == "(") & F.lower(x["name"]).isin(*AGGREGATES), F.lit(False)))
    names = F.when(star, F.array(F.col("expr")[0]["name"])).otherwise(F.array_distinct(F.transform(F.filter("expr", column), lambda x: x["name"])))
    out = F.when(F.col("_shape") == 3, first["name"]).when(F.col("_shape") > 0, at(-1)["name"]).when(single, F.col("expr")[0]["name"])
    text = F.array_join(F.transform("expr", lambda x: x["name"]), " ")
    transform = F.when(aggregate, "aggregate").when(single | star, "passthrough").otherwise("expression")
    keep = ~F.coalesce(F.col("list").startswith("s") & (F.col("_shape") == 3) & first["name"].startswith("@"), F.lit(False))
    return (g if assigned else g.filter(keep)).select("module", "index", "kind", "list", "place", "column", _last_part(out).alias("out"), text.alias("text"), transform.alias("transform"), names.alias("names"), (n > 0).alias("filled"))


def _tables(r: DataFrame) -> DataFrame:
    """module, index, kind, i, role (read, write, exec), name, alias of the tables at the statement's own bracket level."""
    named = named_tables(r).filter("ref IN ('read', 'write', 'exec') AND depth = 0 AND NOT (ref = 'exec' AND name LIKE '@%')")
    return named.select("module", "index", "kind", "i", F.col("ref").alias("role"), "name", "alias")


def sourced(items: DataFrame) -> DataFrame:
    """A row for each name of each item and each table that it may belong to: source (null if unknown), source_column, guess.

    items: names, _own (the tables at hand) and _run (the procedure called, else null).
    """
    each = items.withColumn("_name", F.explode("names"))
    source_column = _last_part(F.col("_name"))
    qualifier = F.lower(plain_name(F.regexp_replace(F.col("_name"), r"(?s)\.?(?:\[[^\]]*+(?:\]\][^\]]*+)*+\]|\"[^\"]*+(?:\"\"[^\"]*+)*+\"|[^.]*+)\z", "")))
    each = each.withColumns({"source_column": source_column, "_q": qualifier})
    fits = F.when(F.col("_run").isNotNull(), F.array(plain_name(F.col("_run")))).when(F.col("_q") == "", F.array_distinct(F.transform("_own", lambda t: plain_name(t["name"])))).otherwise(F.slice(F.transform(F.filter("_own", lambda t: (t["alias"] == F.col("_q")) | (t.folded == F.col("_q")) | ((t["last"] == F.col("_q")) & (t["alias"] == ""))), lambda t: plain_name(t["name"])), 1, 1))
    each = each.withColumn("_fits", fits)
    each = each.withColumn("guess", (F.col("_q") == "") & (F.size("_fits") > 1))
    out = each.withColumn("source", F.explode_outer("_fits"))
    return out.withColumn("source", F.coalesce("source", F.when(F.col("_q") != "", F.col("_q"))))


def statement_rows(modules: DataFrame, kinds, body: str = "body") -> DataFrame:
    """runs() of the statements of these kinds, written to the checkpoint folder once and dealt by module in parts().

    What a row says of the rows around it, more than half of its width, is neither written nor shuffled, but found after that. A row's
    numbers are shuffled as one array: whatever takes of them what it needs takes the same shuffle.
    """
    among, numbers = parts(modules, body), ("index", "i", "depth", "cases", "size")
    stated = statement_tokens(name_tokens(modules, body, among)).filter(F.col("kind").isin(*kinds) & ~F.col("inner"))
    # What is written forgets how its rows were dealt; dealt again by module, all that follows stays in these parts.
    packed = F.array(*(F.col(c).cast("int") for c in numbers), F.col("is_name").cast("int")).alias("_numbers")
    dealt = written(stated).select("module", "kind", "token", "word", packed).repartition(among, "module")
    own = {c: F.get("_numbers", F.lit(k)).cast(stated.schema[c].dataType) for k, c in enumerate((*numbers, "is_name"))}
    return runs(dealt.withColumns(own | {"inner": F.lit(False)}).drop("_numbers"))


def column_edges(modules: DataFrame, body: str = "body", rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, issues). edges: module, statement, kind, target, target_column, place, source (table name), source_column, guess, transform, expression.

    Places of INSERT lists meet by position if both lists are equally long, else by name, with the issue column_count_mismatch;
    without a list `target_column` is null and `place` and `output` tell what catalog_targets() needs. SET pairs and MERGE's lists
    meet within their clause; equal pairs of a MERGE count once. A name without a table's name belongs to the only table, or, where there
    are several, to each of them as a guess that resolved() decides. Constants have no edges. rows: statement_rows() of MARKS' kinds and any others.
    """
    r = statement_rows(modules, MARKS, body) if rows is None else rows.filter(F.col("kind").isin(*MARKS))
    tables = _tables(r).select("module", "index", "kind", F.struct("i", "role", "name", F.lower(plain_name(F.coalesce("alias", F.lit("")))).alias("alias"), F.lower(plain_name(F.col("name"))).alias("folded"), F.lower(_last_part(F.col("name"))).alias("last")).alias("_table"))
    both = _items(_listed(r)).unionByName(tables, allowMissingColumns=True)
    whole, of_list = Window.partitionBy("module", "index"), Window.partitionBy("module", "index", "list")
    both = both.withColumns({
        "_all": F.array_sort(F.collect_list("_table").over(whole)),
        "_targets": F.array_sort(F.collect_list(F.when((F.col("kind") == "insert") & (F.col("list") == ""), F.struct("place", "column"))).over(whole)),
        "_n": F.count(F.when(F.col("list").startswith("s"), F.lit(1))).over(of_list),
    })
    write = F.get(F.filter("_all", lambda t: t.role == "write"), F.lit(0))
    behind = F.get(F.filter("_all", lambda t: (t.role == "read") & (t["alias"] == write["folded"]) & (t["alias"] != "")), F.lit(0))["name"]
    run = F.get(F.filter("_all", lambda t: t.role == "exec"), F.lit(0))["name"]
    # INSERT .. EXEC: each target column gets whatever the procedure returns.
    called = F.coalesce((F.col("kind") == "insert") & run.isNotNull(), F.lit(False)) & F.when(F.col("_table").isNull(), F.col("list") == "").otherwise((F.col("_table.role") == "exec") & (F.size("_targets") == 0))
    items = both.withColumn("_run", F.when(called, run)).filter("_run IS NOT NULL OR (_table IS NULL AND list <> '' AND filled)")
    items = items.withColumns({"list": F.when(F.col("_run").isNotNull(), "e").otherwise(F.col("list")), "names": F.when(F.col("_run").isNotNull(), F.array(F.lit("*"))).otherwise(F.col("names")), "place": F.coalesce("place", F.lit(0))}).drop("_table")
    # A SELECT's tables stand between its first word and the next one's.
    starts = F.array_sort(F.collect_set(F.when(F.col("list").startswith("s"), F.substring("list", 2, 20).cast("int"))).over(whole))
    items = items.withColumn("_starts", starts).withColumn("_start", F.when(F.col("list").startswith("s"), F.substring("list", 2, 20).cast("int")))
    end = F.get(F.filter("_starts", lambda x: x > F.col("_start")), F.lit(0))
    # The target of an UPDATE may be the alias of a table that it reads; its name then stands for no table of its own.
    items = items.withColumn("_behind", F.when(F.col("kind") == "update", behind))
    own = F.filter("_all", lambda t: F.when(F.col("_start").isNull(), (t.role == "read") | ((t.role == "write") & F.col("_behind").isNull())).otherwise((t.role == "read") & (t.i > F.col("_start")) & (end.isNull() | (t.i < end))))
    items = items.withColumns({"_own": own, "target": plain_name(F.coalesce("_behind", write["name"]))})
    given = F.size("_targets") > 0
    by_place = F.get(F.filter("_targets", lambda x: x.place == F.col("place")), F.lit(0))["column"]
    by_name = F.get(F.filter("_targets", lambda x: F.lower(x.column) == F.lower(F.col("out"))), F.lit(0))["column"]
    column = F.when((F.col("kind") != "insert") | F.col("_run").isNotNull(), F.col("column")).when(given & (F.size("_targets") == F.col("_n")), by_place).when(given, by_name)
    items = items.withColumns({"target_column": column, "_lost": F.col("list").startswith("s") & given & (F.size("_targets") != F.col("_n"))})
    message = F.concat_ws(" ", F.lit("query has"), F.col("_n").cast("string"), F.lit("output columns but the list has"), F.size("_targets").cast("string"))
    issues = items.filter("_lost").select("module", F.col("index").alias("statement"), F.lit("column_count_mismatch").alias("issue"), message.alias("message")).distinct()
    items = items.filter((~given & (F.col("kind") == "insert")) | F.col("target_column").isNotNull())
    # Of a MERGE's pairs with the same column and text the first stays.
    items = items.withColumn("_same", F.when(F.col("kind") == "merge", F.row_number().over(Window.partitionBy("module", "index", F.lower("target_column"), "text").orderBy("list", "place"))).otherwise(1)).filter("_same = 1")
    out = sourced(items)
    is_run = F.col("_run").isNotNull()
    transform, text = F.when(is_run, "pseudo").otherwise(F.col("transform")), F.when(is_run, F.concat(F.lit("EXEC "), "_run")).otherwise(F.col("text"))
    return out.select("module", F.col("index").alias("statement"), "kind", "target", "target_column", "list", "place", "out", "source", "source_column", "guess", transform.alias("transform"), F.substring(text, 1, 2000).alias("expression")), issues


def catalog_targets(edges: DataFrame, owners: DataFrame, objects: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with their target columns, issues): lists that no INSERT names are the target's columns in their order, else the query's output names.

    owners: module, owner, db; objects: node, db, schema, name; columns: column, node, name, ordinal. Where the target's columns and the
    query's outputs are not equally many they meet by name, with the issue column_count_mismatch.
    """
    named = edges.filter("target_column IS NOT NULL")
    open_ = named_objects(edges.filter("target_column IS NULL").join(owners.select("module", "db"), "module"), objects, "target").withColumnRenamed("node", "_node")
    listed = columns.groupBy(F.col("node").alias("_node")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "name"))).alias("_columns"))
    open_ = open_.join(listed, "_node", "left")
    outputs = F.max("place").over(Window.partitionBy("module", "statement", "list")) + 1
    open_ = open_.withColumn("_n", outputs)
    # What an EXEC returns goes to all columns.
    returned = open_.filter("list = 'e' AND _columns IS NOT NULL").withColumn("target_column", F.explode(F.transform("_columns", lambda x: x["name"])))
    open_ = open_.filter("list <> 'e'")
    equal = F.size("_columns") == F.col("_n")
    by_name = F.get(F.filter("_columns", lambda x: F.lower(x["name"]) == F.lower(F.col("out"))), F.lit(0))["name"]
    column = F.when(F.col("_columns").isNull(), F.col("out")).when(equal, F.get(F.col("_columns"), F.col("place"))["name"]).otherwise(by_name)
    message = F.concat_ws(" ", F.lit("query has"), F.col("_n").cast("string"), F.lit("output columns but the object has"), F.size("_columns").cast("string"))
    issues = open_.filter("_columns IS NOT NULL").filter(~equal).select("module", "statement", F.lit("column_count_mismatch").alias("issue"), message.alias("message")).distinct()
    found = open_.withColumn("target_column", column).filter("target_column IS NOT NULL")
    return named.unionByName(found.select(*named.columns)).unionByName(returned.select(*named.columns)), issues


def through_trigger_tables(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """edges with `via`: in triggers, `inserted` and `deleted` stand for the table that the trigger is on. parents: module, parent (name).

    Both ends are looked at; the name that stood there is kept in `via`. Elsewhere these names are names like others.
    """
    pseudo = lambda c: F.lower(c).isin("inserted", "deleted") & F.col("parent").isNotNull()
    e = edges.join(parents.select("module", "parent"), "module", "left")
    through = F.when(pseudo("source"), F.lower("source")).when(pseudo("target"), F.lower("target"))
    e = e.withColumn("via", through).withColumns({c: F.when(pseudo(c), F.col("parent")).otherwise(F.col(c)) for c in ("source", "target")})
    return e.drop("parent")


def resolved(edges: DataFrame, owners: DataFrame, objects: DataFrame, columns: DataFrame) -> DataFrame:
    """Edges as lineage.stored_lineage() takes them: owner, db, target_kind, target, target_column, resultset, source, source_column, confidence, transform, statement.

    Exact: a known column of a known table, passed through. Inferred: any other column of a known table. Unresolved: unknown
    tables, whole rows (`*`), and names that none of several tables has. A guess stays for the tables that have the column. A
    temporary source overrides the transform with `temp`.
    """
    e = edges.join(owners.select("module", "owner", "db"), "module").withColumn("_id", F.struct("module", "statement", "list", "place", "target_column", F.lower("source_column").alias("c")))
    temp = F.coalesce(F.col("source").rlike("^[#@]"), F.lit(False))
    e = named_objects(e.withColumn("_source", F.when(~temp, F.col("source"))), objects, "_source").drop("_source").withColumnRenamed("node", "_node")
    known = columns.select(F.col("node").alias("_cn"), F.lower("name").alias("_cname"), F.col("column").alias("id"))
    e = looked_up(e, known, [(F.col("_node"), "_cn"), (F.lower("source_column"), "_cname")], "_column", required=False)
    e = e.withColumn("_known", F.col("_column").isNotNull()).drop("_column")
    e = e.withColumn("_any", F.max("_known").over(Window.partitionBy("_id"))).filter("NOT guess OR _known OR NOT _any")
    lost = F.col("guess") & ~F.col("_any")
    e = e.withColumns({"source": F.when(~lost, F.col("source")), "_node": F.when(~lost, F.col("_node"))})
    star = F.col("source_column") == "*"
    confidence = F.when(star | (F.col("_node").isNull() & ~temp), "unresolved").when(F.col("_known") & (F.col("transform") == "passthrough"), "exact").otherwise("inferred")
    transform = F.when(star, "star").when(temp, "temp").otherwise(F.col("transform"))
    kind = F.when(F.col("kind") == "return", "self").when(F.col("target").startswith("#"), "temp").when(F.col("target").startswith("@"), "tablevar").otherwise("table")
    return e.select("owner", "db", kind.alias("target_kind"), "target", "target_column", F.lit(None).cast("int").alias("resultset"), "source", "source_column", confidence.alias("confidence"), transform.alias("transform"), "statement").distinct()
