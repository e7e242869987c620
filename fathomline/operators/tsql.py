"""Stored SQL bodies as token rows: statements, module bodies and object references, by window functions.

A body becomes one row per token; everything that a reader of the text keeps in mind (bracket depth, CASE depth, which
statement keyword came before) is a running sum or a lag over the tokens of a module. So bodies are spread over the
cluster and no code walks through a text row by row. Bodies are dealt by module before they become rows, in parts of equal
text, so all of these windows find their rows where they are, and a task's memory depends on no table's size.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of bodies that one part holds: their token rows with all windows take some hundred times as much memory.
PART_CHARS = 1 << 20

# Keywords that begin a statement, and the statement's kind.
STARTERS = "select insert update delete merge with exec execute declare set if else while begin end return print raiserror throw truncate create drop alter open fetch close deallocate commit rollback goto break continue waitfor use".split()
DML = ("select", "insert", "update", "delete", "merge", "exec")
#: Procedures that run a text.
DYNAMIC = ("sp_executesql", "xp_cmdshell")
#: One token: comment, string (closed or not), quoted name, variable or temporary name, word, number, blank, or a character. All
#: repetitions are possessive, so a token of any length takes no stack: Java follows an alternation inside a repeated group by recursion.
TOKEN = r"(?s)--[^\n]*+|/\*.*?(?:\*/|\z)|N?'[^']*+(?:''[^']*+)*+(?:'|\z)|\[[^\]]*+(?:\]\][^\]]*+)*+(?:\]|\z)|\"[^\"]*+(?:\"\"[^\"]*+)*+(?:\"|\z)|[@#]++[\w@#$]*+|[A-Za-z_\u0080-￿][\w@#$]*+|\d[\w.]*+|\s++|."
#: The same with the blanks before it, so that they are no rows of their own; blanks at a body's end are a token.
SPACED = rf"(?s)\s*+(?:{TOKEN[4:]})|\s++"
#: A string or quoted name that ends.
CLOSED = r"(?s)^(?:N?'[^']*+(?:''[^']*+)*+'|\[[^\]]*+(?:\]\][^\]]*+)*+\]|\"[^\"]*+(?:\"\"[^\"]*+)*+\")\z"
# End of fixed values.


def unfinished(token: Column) -> Column:
    """Whether a body's last token is a string or quoted name without an end, so that the body can't be told apart into tokens."""
    return F.coalesce(token.rlike(r"^(?:N?'|\[|\")") & ~token.rlike(CLOSED), F.lit(False))


def _unspaced(token: Column) -> Column:
    return F.regexp_replace(token, r"^\s++", "")


def parts(modules: DataFrame, body: str = "body") -> int:
    """How many parts of PART_CHARS the bodies fill; one number goes to the driver."""
    return max(1, ceil((modules.agg(F.sum(F.char_length(body))).first()[0] or 0) / PART_CHARS))


def _cut(modules: DataFrame, body: str, among: int | None, token: str = TOKEN) -> DataFrame:
    """module, _body, _all (its tokens), broken: bodies as they are dealt. among: parts(), if they are known from the texts that the bodies are made of."""
    dealt = modules.select("module", F.col(body).alias("_body")).repartition(among or parts(modules, body), "module").sortWithinPartitions("module")
    own = dealt.select("module", "_body", F.regexp_extract_all("_body", F.lit(token), F.lit(0)).alias("_all"))
    return own.withColumn("broken", unfinished(_unspaced(F.expr("try_element_at(_all, -1)"))))


#: Blanks and comments.
_EMPTY = r"^(?:\s|--|/\*)"
_NAME = r"^(\[|\"|[A-Za-z_@#\u0080-\uffff])"


def _worded(rows: DataFrame) -> DataFrame:
    """rows (token, _p1 and _p2 before it, _t1 behind it) with word and what the token's neighbours say of it."""
    word = lambda token, before: F.when(~F.col("broken") & F.col(token).rlike(r"^[A-Za-z_\u0080-\uffff]") & ~F.col(token).rlike("^N'") & (F.coalesce(before, F.lit("")) != "."), F.lower(token))
    return rows.withColumns({
        "word": word("token", "_p1"),
        "_hint": F.coalesce(F.col("_t1") == "(", F.lit(False)),
        "_joined": F.coalesce(word("_p1", "_p2").isin("union", "except", "intersect", "all"), F.lit(False)),
        "_as_exec": F.coalesce(word("_p1", "_p2").isin("exec", "execute"), F.lit(False)),
        "_fresh": F.col("_p1").isNull() | (F.col("_p1") == ";"),
    }).drop("_p1", "_p2", "_t1")


def tokens(modules: DataFrame, body: str = "body", among: int | None = None) -> DataFrame:
    """module, i (place among tokens, comments too), token, word (lower case; null if it can't be a keyword), start, end, broken, and what its neighbours say.

    before_end: where the token before it ends, unless that is a semicolon; final: whether it is the last one. A body that can't be
    told apart (unfinished) is a single broken token; all others are not touched by it.
    """
    each = _cut(modules, body, among, SPACED).select("module", "broken", F.posexplode(F.when(F.col("broken"), F.array("_body")).otherwise(F.col("_all"))).alias("i", "_raw")).withColumn("i", F.col("i") + 1)
    order = Window.partitionBy("module").orderBy("i")
    placed = each.withColumn("end", F.sum(F.char_length("_raw")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("token", F.when(F.col("broken"), F.col("_raw")).otherwise(_unspaced(F.col("_raw")))).drop("_raw")
    real = placed.withColumn("start", F.col("end") - F.char_length("token")).filter(F.col("broken") | ~F.col("token").rlike(r"^(?:--|/\*|\z)"))
    near = real.withColumns({"_p1": F.lag("token").over(order), "_p2": F.lag("token", 2).over(order), "_t1": F.lead("token").over(order), "_pe": F.lag("end").over(order)})
    return _worded(near.withColumns({"before_end": F.when(F.col("_p1") != ";", F.col("_pe")), "final": F.col("_t1").isNull()}).drop("_pe"))


def name_tokens(modules: DataFrame, body: str = "body", among: int | None = None) -> DataFrame:
    """tokens() without start and end, where a name of several parts is one token: size (its tokens), is_name; i counts no blanks.

    A token's neighbours come from the body's array, shifted and zipped, before it becomes rows: no window looks for them, and blanks
    and the parts of names never become rows. Names have at most four parts.
    """
    own = _cut(modules, body, among)
    own = own.select("module", "broken", F.when(F.col("broken"), F.array("_body")).otherwise(F.filter("_all", lambda x: ~x.rlike(_EMPTY))).alias("_t0"))
    n = F.size("_t0")
    back = {f"_p{k}": F.slice(F.concat(F.array(*[F.lit(None).cast("string")] * k), F.col("_t0")), F.lit(1), n) for k in (1, 2)}
    own = own.withColumns(back | {f"_t{k}": F.slice("_t0", F.lit(k + 1), n) for k in range(1, 8)})
    each = own.select("module", "broken", F.posexplode(F.arrays_zip("_t0", "_p1", "_p2", *(f"_t{k}" for k in range(1, 8)))).alias("i", "_z"))
    at = lambda k: F.coalesce(F.col(f"_z._t{k}"), F.lit(""))

    def rest(k: int) -> Column:
        more = (at(k) == ".") | ((at(k - 1) == ".") & (at(k) != ";"))
        return F.when(more, (rest(k + 1) if k < 7 else F.lit(0)) + 1).otherwise(0)

    token, before = F.col("_z._t0"), F.col("_z._p1")
    inner = F.coalesce((token == ".") | (before == "."), F.lit(False)) & before.isNotNull()
    # Brackets and semicolons count wherever they stand; they are no part of a name.
    each = each.withColumn("inner", inner).filter(~F.col("inner") | token.isin("(", ")", ";") | (before == ";"))
    dotted = token.rlike(_NAME) & ~token.rlike("^N'")
    each = each.withColumns({"is_name": F.coalesce(dotted, F.lit(False)), "size": F.when(dotted & (at(1) == "."), rest(1)).otherwise(0) + 1})
    whole = F.when(F.col("size") > 1, F.concat(token, F.array_join(F.slice(F.array(*(at(k) for k in range(1, 8))), F.lit(1), F.col("size") - 1), ""))).otherwise(token)
    rows = each.select("module", "broken", (F.col("i") + 1).alias("i"), token.alias("token"), whole.alias("_whole"), *(F.col(f"_z.{c}").alias(c) for c in ("_p1", "_p2", "_t1")), "inner", "is_name", "size")
    return _worded(rows).drop("token").withColumnRenamed("_whole", "token")


def broken_modules(modules: DataFrame, body: str = "body") -> DataFrame:
    """module, issue, message: bodies that can't be told apart into tokens. Each is one statement; the others are read as always."""
    last = F.expr("try_element_at(_all, -1)")
    own = modules.select("module", F.regexp_extract_all(F.col(body), F.lit(TOKEN), F.lit(0)).alias("_all"))
    return own.filter(unfinished(last)).select("module", F.lit("parse_error").alias("issue"), F.concat(F.lit("no end of "), F.substring(last, 1, 200)).alias("message"))


def _depths(toks: DataFrame, wanted: Column | None = None) -> DataFrame:
    """toks with depth (open brackets) and cases (open CASE expressions) before each token, and whether END closes a CASE; of the wanted tokens and those of CASE and BEGIN."""
    to_here = Window.partitionBy("module").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    change = F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)
    # END closes the CASE or BEGIN that was opened last. Words at one nesting level alternate between opening and closing.
    nest = F.when(F.col("word").isin("case", "begin"), 1).when(F.col("word") == "end", -1).otherwise(0)
    deep = toks.withColumns({"depth": F.sum(change).over(to_here) - F.when(F.col("token") == "(", 1).otherwise(0), "_nest": F.sum(nest).over(to_here) + F.when(F.col("word") == "end", 1).otherwise(0)})
    if wanted is not None:
        deep = deep.filter(wanted | F.coalesce(F.col("word").isin("case", "begin", "end"), F.lit(False)))
    # All other words share a level, so their rows stay in order and sorting has little to do.
    deep = deep.withColumn("_nest", F.when(F.col("word").isin("case", "begin", "end"), F.col("_nest")))
    level = Window.partitionBy("module", "_nest").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    opener = F.last(F.when(F.col("word").isin("case", "begin"), F.col("word")), True).over(level)
    deep = deep.withColumn("_closes_case", F.coalesce((F.col("word") == "end") & (F.coalesce(opener, F.lit("begin")) == "case"), F.lit(False)))
    step = F.when(F.col("word") == "case", 1).when(F.col("_closes_case"), -1).otherwise(0)
    return deep.withColumn("cases", F.sum(step).over(to_here) - F.when(F.col("word") == "case", 1).otherwise(0)).drop("_nest")


_CLAUSED = (*STARTERS, "values", "default", "output")


def statement_tokens(toks: DataFrame, bounds: bool = False) -> DataFrame:
    """The tokens of all statements, as tokens() or name_tokens() have them, with index and kind of their statement, depth (open brackets) and cases.

    All of it comes from windows over a module's tokens in their order, so the bodies' shuffle is the only one. Semicolons belong to
    no statement; what begins with no keyword is `other`; a broken body is one statement of its first word's kind.
    bounds: only the tokens of tokens() that may begin or end a statement, each with the end of what stands before the next of them.
    """
    order = Window.partitionBy("module").orderBy("i")
    to_here, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    t = _depths(toks, F.col("final") | F.col("_fresh") | (F.col("token") == ";") | F.coalesce(F.col("word").isin(*_CLAUSED), F.lit(False)) if bounds else None)
    top = (F.col("depth") == 0) & (F.col("cases") == 0) & ~F.col("_closes_case")
    predicate = F.col("word").isin("update", "with") & F.col("_hint")  # a trigger's test, a table hint
    started = F.col("word").isin(*_CLAUSED) & top & ~F.coalesce(predicate, F.lit(False))
    kind = F.when(F.col("word") == "execute", "exec").otherwise(F.col("word"))
    t = t.withColumn("_c", F.when(F.coalesce(started, F.lit(False)), kind))
    place = F.struct(F.col("_c"), F.col("i"))
    t = t.withColumns({
        "_semi": F.coalesce(F.max(F.when(F.col("token") == ";", F.col("i"))).over(to_here), F.lit(0)),
        "_merge": F.coalesce(F.max(F.when(F.col("_c") == "merge", F.col("i"))).over(before), F.lit(0)),
        "_lastc": F.last(F.when(F.col("_c").isNotNull(), place), True).over(before),
        # A hint, an OUTPUT clause or CTEs may stand between an INSERT and its rows; any other clause ends the wait for them.
        "_open": F.last(F.when(F.col("_c").isNotNull() & ~F.col("_c").isin("output", "with"), place), True).over(before),
    })
    previous = F.when(F.col("_lastc.i") > F.col("_semi"), F.col("_lastc._c"))
    waiting = (F.col("_open._c") == "insert") & (F.col("_open.i") > F.col("_semi"))
    dml = F.col("_c").isin(*DML[:-1])
    cont = (
        (F.col("_merge") > F.col("_semi"))
        | F.col("_c").isin("values", "default", "output")
        | ((F.col("_c") == "set") & (previous == "update"))
        | (F.col("_c").isin("select", "exec", "with") & waiting)
        | (dml & (previous == "with"))
        | ((F.col("_c") == "select") & F.col("_joined"))
    )
    t = t.withColumn("_cont", F.when(F.col("_c").isNotNull(), F.coalesce(cont, F.lit(False))))
    t = t.withColumn("_after", F.expr("lead(CASE WHEN _c IS NOT NULL THEN struct(_c, _cont) END) IGNORE NULLS OVER (PARTITION BY module ORDER BY i)"))
    of_cte = F.when((F.col("_c") == "with") & F.col("_after._cont") & F.col("_after._c").isin(*DML[:-1]), F.col("_after._c"))
    first = F.regexp_extract("token", r"(?s)^\s*+(\S++)", 1)
    own = F.when(F.lower(first) == "execute", "exec").when(F.lower(first).isin(*STARTERS), F.lower(first)).otherwise("other")
    begins = F.col("_fresh") & (F.col("token") != ";")
    head = F.when(F.col("broken"), own).when(F.col("_c").isNotNull() & ~F.col("_cont"), F.coalesce(of_cte, F.col("_c"))).when(begins, "other")
    t = t.withColumn("_head", head)
    if bounds:
        t = t.withColumn("end", F.greatest("end", F.lead("before_end").over(order)))
    t = t.withColumns({"index": F.sum(F.col("_head").isNotNull().cast("int")).over(to_here).cast("int") - 1, "kind": F.last("_head", True).over(to_here)})
    return t.filter((F.col("index") >= 0) & (F.col("token") != ";")).select("module", "index", "kind", "word", "depth", "cases", *(c for c in ("i", "token", "start", "end", "size", "is_name", "inner") if c in toks.columns))


def statements(modules: DataFrame, body: str = "body", among: int | None = None) -> DataFrame:
    """module, index, kind, start, end, text of every statement; body[start:end] is its text."""
    among = among or parts(modules, body)
    spans = statement_tokens(tokens(modules, body, among), bounds=True).groupBy("module", "index", "kind").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    out = spans.join(modules.select("module", F.col(body).alias("_b")).repartition(among, "module"), "module")
    return out.select("module", "index", "kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.expr("substring(_b, cast(start AS int) + 1, cast(end - start AS int))").alias("text"))


def module_body(modules: DataFrame, body: str = "body", among: int | None = None) -> DataFrame:
    """module, body: what follows the first AS outside brackets that no EXEC stands before; without one the whole text."""
    at = _depths(tokens(modules, body, among)).filter("word = 'as' AND depth = 0 AND NOT _as_exec").groupBy("module").agg(F.min("end").alias("_e"))
    return modules.join(at, "module", "left").select("module", F.expr(f"substring({body}, cast(coalesce(_e, 0) AS int) + 1)").alias("body"))


def view_query(views: DataFrame, body: str = "body") -> DataFrame:
    """module, query: the first SELECT statement after the header."""
    among = parts(views, body)
    inner = statements(module_body(views, body, among), "body", among).filter("kind = 'select'")
    return inner.groupBy("module").agg(F.min_by("text", "index").alias("query"))


#: Words that begin a clause. A comma separates tables only where the last of them at its own bracket level is FROM.
CLAUSES = "select from where group having order set values into union except intersect when then output option for insert update delete merge using exec execute declare".split()
#: Words that a table, module or CTE may stand behind.
_BEFORE_NAMES = "from join using apply into insert update merge delete table exec execute with".split()
#: Words that stand where an alias could.
_NO_ALIAS = "where on set join inner left right full cross outer group order union values select with output when using from having option for except intersect exec execute default pivot unpivot tablesample".split()


def runs(t: DataFrame) -> DataFrame:
    """t (statement_tokens() of name_tokens()) with the rows around each row.

    name, size (tokens), is_name; word (null after a dot); after, after2, after_word and before, before2, word1, word2, word3:
    names and words of the rows behind and in front, of the same statement.
    """
    order = Window.partitionBy("module").orderBy("i")
    r = t.filter("NOT inner").withColumn("name", F.col("token"))
    near = F.struct("index", "word", "name")
    r = r.withColumns({f"_b{k}": F.lag(near, k).over(order) for k in (1, 2, 3)} | {f"_a{k}": F.lead(near, k).over(order) for k in (1, 2)})
    of = lambda c, part: F.when(F.col(f"{c}.index") == F.col("index"), F.col(f"{c}.{part}"))
    return r.select("module", "index", "kind", "i", "token", "word", "depth", "cases", "name", "size", "is_name", of("_b1", "word").alias("word1"), of("_b2", "word").alias("word2"), of("_b3", "word").alias("word3"), of("_b1", "name").alias("before"), of("_b2", "name").alias("before2"), of("_a1", "name").alias("after"), of("_a2", "name").alias("after2"), of("_a1", "word").alias("after_word"))


def plain_name(name: Column) -> Column:
    """A name without the quotes around its parts."""
    return F.regexp_replace(F.regexp_replace(name, r'^[\["]|[\]"]$', ""), r'[\]"]\.[\["]|[\]"]\.|\.[\["]', ".")


def named_tables(r: DataFrame) -> DataFrame:
    """module, index, kind, i, depth, ref, name, alias, clause (place of the clause word before): what statements name as tables or modules. r: runs().

    Where a CTE is named, `cte` is true, and `ref` is null if the name stands for no table there. Tables stand after FROM, JOIN, USING, APPLY and INTO, behind commas of a FROM clause, and after the words that write.
    """
    is_word = lambda c, *ws: F.coalesce(c.isin(*ws), F.lit(False))
    plain = F.col("is_name") & ~is_word(F.col("word"), *STARTERS, "from", "join", "into", "top", "where", "on", "as", "table", "statistics", "inner", "left", "right", "full", "cross", "outer")
    w1, w2 = F.col("word1"), F.col("word2")
    read = is_word(w1, "from", "join", "using", "apply") & ~(is_word(w1, "from") & is_word(w2, "delete"))
    write = is_word(w1, "into") | (is_word(w1, "insert", "update", "merge", "delete") & (F.col("kind") == w1)) | (is_word(w1, "from") & is_word(w2, "delete")) | (is_word(w1, "table") & is_word(w2, "truncate"))
    call = is_word(w1, "exec", "execute") | ((F.col("before") == "=") & F.col("before2").startswith("@") & is_word(F.col("word3"), "exec", "execute"))
    function = (F.col("size") == 3) & (F.col("after") == "(") & F.col("kind").isin(*DML[:-1]) & ~is_word(w1, "statistics")
    listed = F.col("before") == ","
    ref = F.when(plain, F.when(write, "write").when(read, "read").when(call, "exec").when(listed, F.when(function, "listed function").otherwise("listed")).when(function, "function"))
    alias = F.when(F.col("after_word") == "as", F.col("after2")).when(F.col("after").rlike(_NAME) & ~is_word(F.col("after_word"), *_NO_ALIAS), F.col("after"))
    opens, clause = F.col("token") == "(", is_word(F.col("word"), *CLAUSES)
    cte = F.coalesce(F.expr("is_name AND after_word = 'as' AND after2 = '(' AND (word1 = 'with' OR before = ',')"), F.lit(False))
    # What can't be a reference goes by a plain test: the whole one, made once here and once above, is more than Java compiles.
    may = opens | clause | (F.col("is_name") & (is_word(w1, *_BEFORE_NAMES) | is_word(F.col("before"), ",", "=") | is_word(F.col("after"), "(")))
    marked = r.filter(may).withColumns({"ref": ref, "cte": cte, "_open": opens, "_clause": clause, "level": F.col("depth") + opens.cast("int")})
    # A bracket begins a level anew.
    level = Window.partitionBy("module", "index", "level").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_open"), F.struct(F.lit("(").alias("word"), F.col("i").alias("i"))).when(F.col("_clause"), F.struct("word", F.col("i").alias("i"))), True).over(level)
    marked = marked.withColumn("_in", last).filter("ref IS NOT NULL OR cte")
    marked = marked.withColumn("ref", F.when(F.col("ref").startswith("listed"), F.when(F.col("_in.word") == "from", "read").when(F.col("ref") == "listed function", "function")).otherwise(F.col("ref")))
    return marked.filter("ref IS NOT NULL OR cte").select("module", "index", "kind", "i", "depth", "ref", "name", alias.alias("alias"), F.col("_in.i").alias("clause"), "level", "cte")


def _referenced(r: DataFrame) -> DataFrame:
    named = named_tables(r)
    whole = Window.partitionBy("module", "index")
    folded = F.lower("name")
    named = named.withColumns({
        "_aliases": F.collect_list(F.when((F.col("ref") == "read") & F.col("alias").isNotNull() & ~F.col("name").startswith("@"), F.struct("i", F.lower("alias").alias("a"), F.col("name").alias("n")))).over(whole),
        "_ctes": F.collect_set(F.when(F.col("cte"), folded)).over(whole),
    }).filter("ref IS NOT NULL AND name NOT RLIKE '^@'")
    real = F.get(F.array_sort(F.filter("_aliases", lambda x: x.a == folded)), F.lit(0))["n"]
    out = named.withColumn("name", F.when(F.col("ref") == "write", F.coalesce(real, "name")).otherwise(F.col("name"))).filter(~F.array_contains("_ctes", folded))
    runs_text = (F.col("ref") == "exec") & F.lower("name").rlike(rf"(^|[.\[\"])({'|'.join(DYNAMIC)})[\]\"]?$")
    return out.filter(~runs_text).select("module", "index", "ref", plain_name(F.col("name")).alias("name")).distinct()


def module_references(modules: DataFrame, body: str = "body") -> DataFrame:
    """module, index, ref (read, write, exec, function), name: what each statement of each body names.

    Aliases of UPDATE and DELETE targets, and names of CTEs, are looked up in the same statement. A function counts where a
    query calls it as `schema.name(`; procedures that run a text (dynamic_sql) don't. All from one shuffle by module.
    """
    return _referenced(runs(statement_tokens(name_tokens(modules, body))))


def references(stmts: DataFrame) -> DataFrame:
    """module_references() of statements that are at hand as texts; stmts: statements()."""
    key = F.concat_ws("\u0001", "module", F.col("index").cast("string"), "kind")
    t = _depths(name_tokens(stmts.select(key.alias("module"), F.col("text").alias("body"))))
    parts = F.split("module", "\u0001")
    found = _referenced(runs(t.select("module", F.lit(0).alias("index"), parts[2].alias("kind"), "i", "token", "word", "depth", "cases", "size", "is_name", "inner")))
    return found.select(parts[0].alias("module"), parts[1].cast("int").alias("index"), "ref", "name")


def dynamic_sql(stmts: DataFrame) -> DataFrame:
    """module, index, issue, snippet: EXEC statements that run a text, in brackets or by a procedure for it. stmts: statements()."""
    runs = rf"(?i)^exec(?:ute)?\s*(?:\(|(?:@\w+\s*=\s*)?(?:[\w.\[\]]*[.\[])?(?:{'|'.join(DYNAMIC)})(?!\w))"
    return stmts.filter((F.col("kind") == "exec") & F.col("text").rlike(runs)).select("module", "index", F.lit("dynamic_sql").alias("issue"), F.substring("text", 1, 200).alias("snippet"))
