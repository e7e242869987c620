"""Flow edges written once for each snapshot, so that a neighbourhood reads what is near it instead of all tables.

Edges lie in two layouts, by their source (`down`) and by their target (`up`), each in folders of one hash bucket of the near
end, and each row carries what filters ask about its ends. A level of a walk reads the buckets of its frontier only and joins
no table of nodes. What goes to the driver is the list of buckets that a frontier touches, at most as many numbers as there are
buckets. A bucket whose node has very many edges is split over several files (REBALANCE).

A graph that is asked once isn't worth its layouts: they and the shuffles behind them hold all edges several times. LiveGraph finds
the edges of each step in the dependencies themselves and writes only those.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import written
from .graph import Ego, EgoResult, first_edges, turned

#: As many nodes as this or fewer, counted, go to all tasks, so that the edges at them aren't shuffled.
FEW = 65_536
#: Bits of the set that tells which edges may be at more nodes than that. 64 of them are a row; all rows go to all tasks.
BITS = 1 << 26
_ABOUT = ("kind", "schema", "scope")
#: How a row looks from its other end.
_TURNED = {"near": "far", "far": "near"} | {f"{a}_{c}": f"{b}_{c}" for a, b in (("near", "far"), ("far", "near")) for c in _ABOUT}


def _bucket(node: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int").alias("bucket")


@dataclass(frozen=True)
class StoredGraph:
    spark: SparkSession
    folder: str
    buckets: int
    rows: str  # the rows' schema as JSON: a layout without edges has no files to learn it from
    _layouts: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)  # listed once, as files never change

    def touched(self, nodes: DataFrame) -> list[int]:
        """The buckets that nodes (column node) lie in; none if there are no nodes."""
        return self.placed(nodes)[1]

    def placed(self, nodes: DataFrame) -> tuple[DataFrame, list[int]]:
        """nodes (column node), marked for broadcast if they are FEW, and the buckets that they lie in; none if there are no nodes."""
        rows = nodes.select(_bucket(F.col("node"), self.buckets)).groupBy("bucket").count().collect()
        return F.broadcast(nodes) if sum(r[1] for r in rows) <= FEW else nodes, sorted(r[0] for r in rows)

    def edges(self, way: str, buckets: list[int]) -> DataFrame:
        """near, far, kind, id, what is known of both ends, bucket. Files of other buckets aren't read."""
        if way not in self._layouts:
            self._layouts[way] = self.spark.read.schema(StructType.fromJson(json.loads(self.rows))).parquet(f"{self.folder}/{way}")
        return self._layouts[way].filter(F.col("bucket").isin(*buckets))

    def at(self, way: str, nodes: DataFrame, buckets: list[int]) -> DataFrame:
        """The edges whose near end is one of nodes (column node), which lie in these buckets."""
        return self.edges(way, buckets).join(nodes.select(F.col("node").alias("near")), "near", "left_semi")


def _even(nodes: DataFrame, count: int) -> DataFrame:
    """nodes, broadcast by a join if they are FEW as counted, else joined by a shuffle, whatever Spark takes them for."""
    return F.broadcast(nodes) if count <= FEW else nodes.hint("merge")


@dataclass(frozen=True)
class LiveGraph:
    """graph.flow_edges() of nodes (node, kind, schema, scope) and dependencies (id, source, target, kind), as StoredGraph has them, without a store.

    A step reads all dependencies, but shuffles and writes only the edges at the nodes that it asks for.
    """

    nodes: DataFrame
    dependencies: DataFrame

    def placed(self, nodes: DataFrame) -> tuple[DataFrame, list[int]]:
        """nodes (column node) and how many they are; nothing if there are none."""
        count = nodes.count()
        return nodes, [count] if count else []

    def at(self, way: str, nodes: DataFrame, count: list[int]) -> DataFrame:
        """near, far, kind, id and what is known of the far end: edges whose near end is one of nodes (column node), which are so many."""
        near, far = ("source", "target") if way == "down" else ("target", "source")
        edges = turned(self.dependencies).select(F.col(near).alias("near"), F.col(far).alias("far"), "kind", "id")
        if not count:
            edges = edges.limit(0)
        elif count[0] > FEW:
            edges = _maybe_at(edges, nodes)
        found = edges.join(_even(nodes.select(F.col("node").alias("near")), sum(count)), "near", "left_semi")
        found = written(found.groupBy("near", "far", "kind").agg(F.min("id").alias("id")))
        ends = found.select(F.col("near").alias("node")).union(found.select("far")).distinct()
        few = ends.count()
        about = self.nodes.select("node", *_ABOUT).join(_even(ends, few), "node", "left_semi").dropDuplicates(["node"])
        known, end = about.select(F.col("node").alias("near")), about.select(F.col("node").alias("far"), *(F.col(c).alias(f"far_{c}") for c in _ABOUT))
        return found.join(_even(known, few), "near", "left_semi").join(_even(end, few), "far")


def _maybe_at(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges whose near end falls on a bit that one of nodes sets: all that are at nodes, and some that are not. At most BITS / 64 rows are broadcast."""
    bit = lambda node: F.pmod(F.xxhash64(node), F.lit(BITS))
    mask = F.expr("shiftleft(1L, CAST(_bit & 63 AS INT))")
    words = nodes.select(bit("node").alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(mask).alias("_set"))
    held = edges.withColumn("_bit", bit("near")).withColumn("_word", F.shiftright("_bit", 6)).join(F.broadcast(words), "_word")
    return held.filter(F.col("_set").bitwiseAND(mask) != 0).drop("_bit", "_word", "_set")


def store(nodes: DataFrame, dependencies: DataFrame, folder: str, buckets: int = 64) -> StoredGraph:
    """Writes graph.flow_edges() of nodes (node, kind, schema, scope) and dependencies (id, source, target, kind).

    Of several nodes of one name any one tells what filters see. `buckets` should let a bucket fill about one file: 64 for
    millions of edges, thousands for billions. `meta` is written last: a folder without it is no graph.
    """
    spark = nodes.sparkSession
    known = nodes.select("node", *_ABOUT).dropDuplicates(["node"])
    end = lambda name, prefix: known.select(F.col("node").alias(name), *(F.col(c).alias(f"{prefix}_{c}") for c in _ABOUT))
    rows = first_edges(dependencies).join(end("source", "near"), "source").join(end("target", "far"), "target")
    rows = rows.withColumnsRenamed({"source": "near", "target": "far"}).withColumn("bucket", _bucket(F.col("near"), buckets))
    made = StoredGraph(spark, folder, buckets, rows.schema.json())

    def put(rows: DataFrame, way: str) -> None:
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "near").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{way}")

    put(rows, "down")
    down = spark.read.schema(rows.schema).parquet(f"{folder}/down")
    put(down.select(*(F.col(_TURNED.get(c, c)).alias(c) for c in rows.columns if c != "bucket")).withColumn("bucket", _bucket(F.col("near"), buckets)), "up")
    spark.createDataFrame([(buckets, made.rows)], "buckets int, rows string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")
    return made


def opened(spark: SparkSession, folder: str) -> StoredGraph:
    """The graph that store() wrote there."""
    meta = spark.read.parquet(f"{folder}/meta").first()
    return StoredGraph(spark, folder, meta.buckets, meta.rows)


def walk(graph: StoredGraph | LiveGraph, focus: DataFrame, options: Ego) -> DataFrame:
    """node, hop, outside (whether the node is external) as graph.walk(): up before down within a level, the first hop stays."""
    hops = focus.select("node", F.lit(0).alias("hop"), F.lit(False).alias("outside"))
    allowed = options.allowed("far_kind", "far_schema", "far_scope")
    ways = {way: sign for way, sign in (("up", -1), ("down", 1)) if options.direction in (way, "both")}
    frontier = {way: graph.placed(focus.select("node")) for way in ways}
    for level in range(1, options.depth + 1):
        for way, sign in ways.items():
            nodes, buckets = frontier[way]
            if not buckets:
                continue
            near = graph.at(way, nodes, buckets).filter(options.follows() & allowed)
            found = near.groupBy(F.col("far").alias("node")).agg(F.first(F.col("far_scope") == "external").alias("outside"))
            new = written(found.join(hops.hint("merge"), "node", "left_anti"))
            frontier[way] = graph.placed(new.select("node"))
            if frontier[way][1]:
                hops = hops.unionByName(new.select("node", F.lit(sign * level).alias("hop"), F.coalesce("outside", F.lit(False)).alias("outside")))
        if not any(buckets for _, buckets in frontier.values()):
            break
    return hops


def ego(graph: StoredGraph | LiveGraph, focus: DataFrame, options: Ego) -> EgoResult:
    """The same as graph.ego_graph() of the graph's edges. A focus (one row, column node) without edges is alone."""
    reached = walk(graph, focus, options)
    total = reached.count()
    kept = reached
    if total > options.max_nodes:
        # All nodes of the nearest classes stay; only the class that the cap cuts needs degrees. There are at most two classes a hop.
        far = F.when(F.col("hop") == 0, False).otherwise(F.col("outside"))
        classes = reached.groupBy(F.abs("hop").alias("near"), far.alias("far")).count().orderBy("near", "far").collect()
        room, cut = options.max_nodes, None
        for cut in classes:
            if cut["count"] > room:
                break
            room -= cut["count"]
        edge = (F.abs("hop") == cut.near) & (far == cut.far)
        nearer = (F.abs("hop") < cut.near) | ((F.abs("hop") == cut.near) & ~far & F.lit(cut.far))
        at_edge = reached.filter(edge)
        nodes, buckets = graph.placed(at_edge.select("node"))
        side = lambda way: graph.at(way, nodes, buckets).select(F.col("near").alias("node"), "far", F.lit(way).alias("way"))
        degrees = side("up").unionByName(side("down")).distinct().groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        chosen = at_edge.join(degrees, "node", "left").orderBy(F.desc(F.coalesce("degree", F.lit(0))), "node").limit(room)
        kept = written(reached.filter(nearer).unionByName(chosen.drop("degree")))
    inside, buckets = graph.placed(kept.select("node"))
    ends = inside.select(F.col("node").alias("far"))
    induced = graph.at("down", inside, buckets).filter(options.follows()).join(ends, "far", "left_semi")

    def missing(way: str, name: str) -> DataFrame:
        others = graph.at(way, inside, buckets).filter(options.follows() & options.allowed("far_kind", "far_schema", "far_scope")).select("near", "far").distinct()
        return others.join(ends, "far", "left_anti").groupBy(F.col("near").alias("node")).agg(F.count(F.lit(1)).alias(name))

    more = inside.join(missing("up", "more_up"), "node", "left").join(missing("down", "more_down"), "node", "left").fillna(0, ["more_up", "more_down"])
    return EgoResult(kept.select("node", "hop"), induced.select("id", F.col("near").alias("source"), F.col("far").alias("target"), "kind"), more, reached.select("node", "hop"), total)
