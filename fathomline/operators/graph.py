"""Lineage graphs as DataFrames: flow edges, hop-limited neighbourhoods, caps, temporary tables collapsed.

Neighbourhoods grow level by level; each level is a join of the frontier with the edges and an anti join with what is
known, written to the checkpoint folder so that no level computes the ones before it again. Nothing is collected but
whether a frontier is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import confidence_rank
from ..session import checkpoint

# All kinds of edges, and those whose stored row says that the source uses the target: data flows the other way.
EDGE_KINDS = ("catalog", "fk", "trigger", "synonym", "parsed_read", "parsed_write", "parsed_exec")
REVERSED = ("catalog", "fk", "synonym", "parsed_read")


def turned(dependencies: DataFrame) -> DataFrame:
    """id, source, target, kind in the direction of data, without loops."""
    back = F.col("kind").isin(*REVERSED)
    rows = dependencies.select("id", F.when(back, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(back, F.col("source")).otherwise(F.col("target")).alias("target"), "kind")
    return rows.filter("source IS NOT NULL AND target IS NOT NULL AND source <> target")


def first_edges(dependencies: DataFrame) -> DataFrame:
    """turned(), the first of equal edges."""
    return turned(dependencies).groupBy("source", "target", "kind").agg(F.min("id").alias("id"))


def flow_edges(nodes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """first_edges() between known nodes."""
    known = nodes.select("node")
    return first_edges(dependencies).join(known.withColumnRenamed("node", "source"), "source", "left_semi").join(known.withColumnRenamed("node", "target"), "target", "left_semi").select("id", "source", "target", "kind")


def degree(edges: DataFrame) -> DataFrame:
    """node, degree: different predecessors plus different successors."""
    ends = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), F.lit(1).alias("out")).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), F.lit(0).alias("out")))
    return ends.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """degree() of some nodes only, from the edges at them."""
    at = lambda near, far, way: edges.join(nodes.select(F.col("node").alias(near)), near, "left_semi").select(F.col(near).alias("node"), F.col(far).alias("other"), F.lit(way).alias("out"))
    return at("source", "target", 1).unionByName(at("target", "source", 0)).distinct().groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


@dataclass(frozen=True)
class Ego:
    """What to walk: direction up, down or both; filters hold for all nodes but the focus."""

    direction: str = "both"
    depth: int = 2
    max_nodes: int = 200
    kinds: tuple[str, ...] | None = None
    schemas: tuple[str, ...] | None = None
    edge_kinds: tuple[str, ...] | None = None
    cascaded: bool = True
    external: bool = True

    def follows(self) -> Column:
        return F.lit(True) if self.edge_kinds is None else F.col("kind").isin(*self.edge_kinds)

    def allowed(self, kind: str = "kind", schema: str = "schema", scope: str = "scope") -> Column:
        test = F.lit(True)
        if self.kinds is not None:
            test &= F.col(kind).isin(*self.kinds)
        if self.schemas is not None:
            test &= F.lower(F.coalesce(schema, F.lit(""))).isin(*(s.lower() for s in self.schemas))
        if not self.cascaded:
            test &= F.col(scope) != "cascaded"
        if not self.external:
            test &= F.col(scope) != "external"
        return test


@dataclass
class EgoResult:
    hops: DataFrame  # node, hop: what the cap keeps
    edges: DataFrame
    more: DataFrame  # node, more_up, more_down: neighbours not returned
    reached: DataFrame  # node, hop before the cap
    total: int


def walk(focus: DataFrame, edges: DataFrame, allowed: DataFrame, direction: str, depth: int) -> DataFrame:
    """node, hop: one walk in both directions, in which a level goes up before it goes down and a node keeps its first hop."""
    hops = focus.select("node", F.lit(0).alias("hop"))
    frontier = {"up": hops.select("node"), "down": hops.select("node")}
    ways = {"up": ("target", "source", -1), "down": ("source", "target", 1)}
    for level in range(1, depth + 1):
        grew = False
        for way in ("up", "down"):
            if direction not in (way, "both") or frontier[way] is None:
                continue
            near, far, sign = ways[way]
            reached = edges.join(frontier[way].withColumnRenamed("node", near), near, "left_semi").select(F.col(far).alias("node")).distinct()
            new = checkpoint(reached.join(allowed, "node", "left_semi").join(hops, "node", "left_anti"))
            if new.isEmpty():
                frontier[way] = None
                continue
            frontier[way], grew = new, True
            hops = hops.unionByName(new.select("node", F.lit(sign * level).alias("hop")))
        if not grew:
            break
    return hops


def capped(hops: DataFrame, nodes: DataFrame, degrees: DataFrame, limit: int) -> DataFrame:
    """The focus and the nearest others: by distance, own before external, higher degree, smaller id."""
    ranked = hops.join(nodes.select("node", (F.col("scope") == "external").cast("int").alias("far")), "node").join(degrees, "node", "left")
    top = ranked.orderBy(F.abs("hop"), F.when(F.col("hop") == 0, 0).otherwise(F.col("far")), F.desc(F.coalesce("degree", F.lit(0))), "node").limit(limit)
    return top.select("node", "hop")


def ego_graph(nodes: DataFrame, edges: DataFrame, focus: DataFrame, options: Ego) -> EgoResult:
    """The neighbourhood of a focus (one row, column node). nodes: node, kind, schema, scope; edges: flow_edges()."""
    edges = checkpoint(edges)
    used = edges if options.edge_kinds is None else edges.filter(F.col("kind").isin(*options.edge_kinds))
    allowed = nodes.filter(options.allowed()).select("node")
    reached = checkpoint(walk(focus, used, allowed, options.direction, options.depth))
    total = reached.count()
    kept = reached if total <= options.max_nodes else checkpoint(capped(reached, nodes, degree_of(reached, edges), options.max_nodes))
    inside = kept.select("node")
    induced = used.join(inside.withColumnRenamed("node", "source"), "source", "left_semi").join(inside.withColumnRenamed("node", "target"), "target", "left_semi")

    def missing(near: str, far: str, name: str) -> DataFrame:
        others = used.join(inside.withColumnRenamed("node", near), near, "left_semi").select(F.col(near).alias("node"), F.col(far).alias("other")).distinct()
        others = others.join(allowed.withColumnRenamed("node", "other"), "other", "left_semi").join(inside.withColumnRenamed("node", "other"), "other", "left_anti")
        return others.groupBy("node").agg(F.count(F.lit(1)).alias(name))

    more = inside.join(missing("target", "source", "more_up"), "node", "left").join(missing("source", "target", "more_down"), "node", "left").fillna(0, ["more_up", "more_down"])
    return EgoResult(kept, induced.select("id", "source", "target", "kind"), more, reached, total)


def hubs(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """Nodes with most different neighbours (a top-k report)."""
    up = edges.groupBy(F.col("target").alias("node")).agg(F.countDistinct("source").alias("upstream"))
    down = edges.groupBy(F.col("source").alias("node")).agg(F.countDistinct("target").alias("downstream"))
    both = up.join(down, "node", "full_outer").fillna(0, ["upstream", "downstream"])
    ranked = both.join(nodes.select("node", "name"), "node").withColumn("degree", F.col("upstream") + F.col("downstream"))
    return ranked.orderBy(F.desc("degree"), "name", "node").limit(limit)


# Column level ---------------------------------------------------------------------------------------------------


def column_edges(columns: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between known columns, loops dropped, equal ones kept. edges: id, source, target, confidence, transform, via."""
    known = columns.select("column")
    return edges.filter("source <> target").join(known.withColumnRenamed("column", "source"), "source", "left_semi").join(known.withColumnRenamed("column", "target"), "target", "left_semi")


def participating(columns: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("column")).unionByName(edges.select(F.col("target").alias("column"))).distinct()
    return columns.join(ends, "column", "left_semi")


def collapse(columns: DataFrame, objects: DataFrame, edges: DataFrame, longest: int = 16) -> DataFrame:
    """Edges with temporary tables' columns replaced by one edge for each simple path through them.

    A path's id is its edges' ids joined by +, its confidence the least of them, its `via` the last that isn't null, its
    expression and statement (if edges have them) those of its last edge.
    """
    extra = [c for c in ("expression", "statement") if c in edges.columns]
    temp = columns.join(objects.filter("kind = 'temp_table'").select("object"), "object", "left_semi").select("column")
    as_end = lambda name: temp.withColumnRenamed("column", name)
    step = edges.select(F.col("source").alias("_s"), F.col("target").alias("_t"), F.col("id").alias("_id"), F.col("confidence").alias("_c"), F.col("via").alias("_via"), *(F.col(c).alias(f"_{c}") for c in extra))
    done = edges.join(as_end("source"), "source", "left_anti").join(as_end("target"), "target", "left_anti").select("id", "source", "target", "confidence", "transform", "via", *extra)
    open_paths = edges.join(as_end("source"), "source", "left_anti").join(as_end("target"), "target", "left_semi")
    open_paths = open_paths.select(F.col("id").cast("string").alias("id"), "source", "target", "confidence", "via", F.array("target").alias("seen"))
    for _ in range(longest):
        longer = open_paths.join(step, F.col("target") == F.col("_s")).filter(~F.array_contains("seen", F.col("_t")) & (F.col("_t") != F.col("source")))
        least = F.when(confidence_rank(F.col("_c")) < confidence_rank(F.col("confidence")), F.col("_c")).otherwise(F.col("confidence"))
        longer = checkpoint(longer.select(F.concat_ws("+", "id", F.col("_id").cast("string")).alias("id"), "source", F.col("_t").alias("target"), least.alias("confidence"), F.coalesce("_via", "via").alias("via"), F.concat("seen", F.array("_t")).alias("seen"), *(F.col(f"_{c}").alias(c) for c in extra)))
        if longer.isEmpty():
            break
        ended = longer.join(as_end("target"), "target", "left_anti")
        done = done.unionByName(ended.select("id", "source", "target", "confidence", F.lit("temp").alias("transform"), "via", *extra))
        open_paths = longer.join(as_end("target"), "target", "left_semi").drop(*extra)
    return done


def column_ego(columns: DataFrame, objects: DataFrame, edges: DataFrame, seeds: DataFrame, *, direction: str = "both", depth: int = 2, min_confidence: str = "unresolved", max_nodes: int = 150, focus: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(object, hop), (edges among the returned columns), total objects. seeds: column; focus: the object they belong to (one row), which is there at hop 0 also without any."""
    used = checkpoint(edges.filter(confidence_rank(F.col("confidence")) >= confidence_rank(F.lit(min_confidence))))
    walked = walk(seeds.select(F.col("column").alias("node")), used, columns.select(F.col("column").alias("node")), direction, depth)
    of = walked.join(columns.select(F.col("column").alias("node"), "object"), "node")
    nearest = Window.partitionBy("object").orderBy(F.abs("hop"), "hop")
    placed = of.select("object", "hop")
    if focus is not None:
        placed = placed.unionByName(focus.select("object", F.lit(0).alias("hop")))
    hops = checkpoint(placed.withColumn("_r", F.row_number().over(nearest)).filter("_r = 1").select("object", "hop"))
    total = hops.count()
    if total > max_nodes:
        ends = edges.select(F.col("source").alias("column")).unionByName(edges.select(F.col("target").alias("column")))
        degrees = ends.join(columns, "column").groupBy("object").agg(F.count(F.lit(1)).alias("degree"))
        far = objects.select("object", (F.col("scope") == "external").cast("int").alias("far"))
        hops = hops.join(far, "object").join(degrees, "object", "left").orderBy(F.abs("hop"), F.when(F.col("hop") == 0, 0).otherwise(F.col("far")), F.desc(F.coalesce("degree", F.lit(0))), "object").limit(max_nodes).select("object", "hop")
    inside = of.join(hops.select("object"), "object", "left_semi").select("node")
    induced = used.join(inside.withColumnRenamed("node", "source"), "source", "left_semi").join(inside.withColumnRenamed("node", "target"), "target", "left_semi")
    return hops, induced, total
