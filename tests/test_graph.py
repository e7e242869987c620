import pytest

from fathomline.operators import graph, stored_graph

# A brewery: what is stored says who uses whom; grain and water flow to the glass.
NODES = {10: ("Barley", "table", "farm"), 20: ("Malt", "view", "mill"), 30: ("Water", "table", "well"), 40: ("Mash", "procedure", "brew"), 50: ("Keg", "table", "brew"), 60: ("Tap", "view", "pub"), 70: ("Bell", "trigger", "pub"), 80: ("Toll", "external", "road")}
SCOPES = {30: "cascaded", 10: "cascaded", 80: "external"}
USES = [(20, 10, "catalog"), (40, 20, "parsed_read"), (40, 30, "parsed_read"), (40, 50, "parsed_write"), (60, 50, "catalog"), (70, 50, "trigger"), (70, 40, "parsed_exec"), (60, 80, "synonym"), (50, 30, "fk"), (60, 50, "catalog"), (40, 40, "parsed_exec"), (60, None, "catalog")]


@pytest.fixture(scope="module")
def estate(spark):
    n = spark.createDataFrame([(k, name, kind, schema, SCOPES.get(k, "in_scope")) for k, (name, kind, schema) in NODES.items()], "node int, name string, kind string, schema string, scope string")
    return n, graph.flow_edges(n, spark.createDataFrame([(i, *u) for i, u in enumerate(USES, 1)], "id int, source int, target int, kind string"))


def ego(spark, estate, focus, **options):
    r = graph.ego_graph(*estate, spark.createDataFrame([(focus,)], "node int"), graph.Ego(**options))
    return r, {x.node: x.hop for x in r.hops.collect()}


def flow():
    """(source, target) of the flow and the first id of each, by the direction that each kind has."""
    out = {}
    for i, (a, b, kind) in enumerate(USES, 1):
        if b is not None and a != b:
            pair = (a, b, kind) if kind in ("trigger", "parsed_write", "parsed_exec") else (b, a, kind)
            out.setdefault(pair, i)
    return out


def walked(focus, direction, depth, allowed=lambda n: True, kinds=None):
    """Level by level, up before down; who is reached first keeps that hop."""
    edges = {(a, b) for a, b, k in flow() if kinds is None or k in kinds}
    hops, front = {focus: 0}, {-1: {focus}, 1: {focus}}
    for level in range(1, depth + 1):
        for sign in (-1, 1):
            if direction in ("both", {-1: "up", 1: "down"}[sign]):
                near = {(a if sign < 0 else b) for a, b in edges if (b if sign < 0 else a) in front[sign]}
                front[sign] = {n for n in near if n not in hops and allowed(n)}
                hops |= dict.fromkeys(front[sign], sign * level)
    return hops


def test_flow_edges(estate):
    assert {(r.source, r.target, r.kind): r.id for r in estate[1].collect()} == flow()


@pytest.mark.parametrize(
    ("focus", "options", "plain"),
    [
        (60, {"direction": "up", "depth": 3}, {}),
        (30, {"direction": "down", "depth": 2}, {}),
        (50, {"direction": "both", "depth": 2}, {}),
        (40, {"direction": "both", "depth": 1}, {}),
        (60, {"direction": "up", "depth": 1, "external": False}, {"allowed": lambda n: SCOPES.get(n) != "external"}),
        (60, {"direction": "up", "depth": 4, "kinds": ("table", "procedure")}, {"allowed": lambda n: NODES[n][1] in ("table", "procedure")}),
        (60, {"direction": "up", "depth": 3, "schemas": ("BREW", "mill")}, {"allowed": lambda n: NODES[n][2] in ("brew", "mill")}),
        (50, {"direction": "up", "depth": 2, "edge_kinds": ("fk",)}, {"kinds": ("fk",)}),
        (60, {"direction": "up", "depth": 4, "cascaded": False}, {"allowed": lambda n: SCOPES.get(n) != "cascaded"}),
    ],
)
def test_walks(spark, estate, focus, options, plain):
    assert ego(spark, estate, focus, **options)[1] == walked(focus, options["direction"], options["depth"], **plain)


def test_cap_keeps_the_nearest_of_highest_degree_and_more_counts_the_rest(spark, estate):
    every = walked(50, "up", 2)
    r, hops = ego(spark, estate, 50, direction="up", depth=2, max_nodes=3)
    assert r.total == len(every) and hops == {50: 0, 40: -1, 30: -1}  # 40 has four neighbours, 30 and 70 two each
    r, hops = ego(spark, estate, 60, direction="up", depth=1)
    inside, pairs = set(hops), {(a, b) for a, b, _ in flow()}
    wanted = {n: (len({a for a, b in pairs if b == n} - inside), len({b for a, b in pairs if a == n} - inside)) for n in inside}
    assert {x.node: (x.more_up, x.more_down) for x in r.more.collect()} == wanted and any(sum(w) for w in wanted.values())
    assert {(x.source, x.target) for x in r.edges.collect()} == {(a, b) for a, b in pairs if {a, b} <= inside}


@pytest.fixture(scope="module")
def stored(spark, estate, tmp_path_factory):
    uses = spark.createDataFrame([(i, *u) for i, u in enumerate(USES, 1)], "id int, source int, target int, kind string")
    folder = f"file://{tmp_path_factory.mktemp('flow')}"
    stored_graph.store(estate[0], uses, folder, buckets=5)
    return stored_graph.opened(spark, folder)


@pytest.mark.parametrize(
    "options",
    [
        {"direction": "both", "depth": 3},
        {"direction": "up", "depth": 4, "cascaded": False, "external": False},
        {"direction": "both", "depth": 2, "kinds": ("table", "procedure"), "schemas": ("BREW", "well")},
        {"direction": "both", "depth": 3, "max_nodes": 3},
        {"direction": "down", "depth": 3, "edge_kinds": ("parsed_write", "catalog"), "max_nodes": 2},
    ],
)
@pytest.mark.parametrize("focus", [60, 50, 30])
def test_stored_neighbourhoods_are_those_of_all_edges(spark, estate, stored, focus, options):
    rows = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    at = spark.createDataFrame([(focus,)], "node int")
    a, b = graph.ego_graph(*estate, at, graph.Ego(**options)), stored_graph.ego(stored, at, graph.Ego(**options))
    assert a.total == b.total and all(rows(getattr(a, part)) == rows(getattr(b, part)) for part in ("reached", "hops", "edges", "more"))


def test_a_walk_reads_the_buckets_of_its_frontier_only(spark, stored):
    at = spark.createDataFrame([(50,)], "node int")
    near = stored.edges("up", stored.touched(at))
    assert {f.rsplit("/", 2)[1] for f in near.select("_metadata.file_path").distinct().toPandas()["file_path"]} == {f"bucket={stored.touched(at)[0]}"}
    scan = near._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in scan and "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_stored_graphs_without_edges_or_known_nodes(spark, estate, tmp_path):
    none = spark.createDataFrame([], "id int, source int, target int, kind string")
    empty = stored_graph.store(estate[0], none, f"file://{tmp_path}/g")
    r = stored_graph.ego(empty, spark.createDataFrame([(60,)], "node int"), graph.Ego())
    assert [tuple(x) for x in r.reached.collect()] == [(60, 0)] and r.edges.isEmpty() and [tuple(x) for x in r.more.collect()] == [(60, 0, 0)]
