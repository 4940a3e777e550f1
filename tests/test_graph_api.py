import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from weft.operators import depth_first, fluent, frontier
from weft.operators.fluent import Direction, GraphApi, PathResult, Strategy
from weft.plans.syntax import QueryError

from .graphs import links, social, values


def test_scans(spark):
    g = social(spark)
    assert values(g.nodes_where("Person", name="Bob", age=25).select("id")) == [(2,)]
    assert values(g.nodes_in_range("Person", "age", 25, 35).select("id")) == [(2,), (3,)]
    assert g.node_of_greatest("Person", "age").first().id == 4
    assert g.nodes_without("Person", "none").count() == 4
    assert g.node(1)["name"] == "Alice" and g.edge(10)["dst"] == 2 and g.node_label(3) == "Person"
    assert g.node_projected(1, ["age"]) == {"id": 1, "label": "Person", "age": 35}
    assert g.node_exists(4) and not g.node_exists(5)
    assert g.has_edge(1, 2) and not g.has_edge(2, 1) and not g.has_edge(1, 2, "X")
    assert g.edge_endpoints(12) == (4, 2) and g.edge_label_hashes().count() == 3
    assert (g.node_count(), g.edge_count(), g.node_labels(), g.edge_types()) == (4, 3, ["Person"], ["KNOWS"])
    assert g.outgoing(1).count() == 2 and g.incoming(2, "KNOWS").count() == 2
    with pytest.raises(QueryError):
        g.node(99)


def test_neighbours(spark):
    api = GraphApi(links(spark, [(1, 2), (3, 1), (1, 1), (1, 2)]))
    assert values(api.neighbors(1).direction("outgoing").nodes()) == [(1,), (2,), (2,)]
    assert values(api.neighbors(1).direction(Direction.INCOMING).nodes()) == [(1,), (3,)]
    assert values(api.neighbors(1).nodes()) == [(1,), (1,), (2,), (2,), (3,)]
    assert api.neighbors(1).label("X").edges().count() == 0
    with pytest.raises(QueryError):
        api.neighbors(9).nodes()
    with pytest.raises(QueryError):
        api.neighbors(1).direction("sideways")


def test_traversals(spark):
    tree = GraphApi(links(spark, [(1, 2), (1, 3), (2, 4), (2, 5), (3, 6), (6, 1)]))
    walk = tree.traverse(1).direction("outgoing")
    assert walk.nodes() == [1, 2, 3, 4, 5, 6]
    assert walk.strategy("dfs").nodes() == [1, 2, 4, 5, 3, 6]
    assert walk.max_depth(1).nodes() == [1, 2, 3] and walk.max_depth(0).nodes() == [1]
    assert walk.max_depth(2).paths()[0] == PathResult((1,)) and walk.paths()[-1].nodes == (1, 3, 6)
    assert walk.strategy(Strategy.DFS).max_depth(1).nodes() == [1, 2, 3]
    assert [p.nodes for p in walk.strategy("dfs").paths()][:3] == [(1,), (1, 2), (1, 2, 4)]
    assert set(tree.traverse(4).nodes()) == {1, 2, 3, 4, 5, 6}
    assert set(tree.traverse(4).strategy("dfs").nodes()) == {1, 2, 3, 4, 5, 6}
    with pytest.raises(QueryError):
        walk.strategy("random")


def _pre_order(pairs, start, way, limit):
    """(node, depth, edge) by the recursive definition; edges are numbered from 100."""
    follow = {}
    for i, (a, b) in enumerate(pairs):
        for k, x, y in ((0, a, b), (1, b, a)):
            if way in ("both", ("outgoing", "incoming")[k]):
                follow.setdefault(x, []).append((k, 100 + i, y))
    out, seen = [], set()

    def visit(v, depth, edge):
        seen.add(v)
        out.append((v, depth, edge))
        for _, e, b in sorted(follow.get(v, ())) if depth < limit else ():
            if b not in seen:
                visit(b, depth + 1, e)

    visit(start, 0, None)
    return out


def test_depth_first_order(spark, monkeypatch):
    """Against the recursive definition, in small blocks."""
    monkeypatch.setattr(depth_first, "ROWS", 9)
    monkeypatch.setattr(fluent, "DFS_EDGES", 3, raising=False)  # no number of edges is too large
    draw = random.Random(5)
    pairs = [(draw.randrange(-3, 15), draw.randrange(-3, 15)) for _ in range(30)] + [(20, 21), (21, 22)]
    api = GraphApi(links(spark, pairs, nodes=range(-3, 25)))
    for way, limit in (("outgoing", 1 << 30), ("both", 3), ("incoming", 2), ("both", 0)):
        walk = api.traverse(2).direction(way).max_depth(limit)
        want = _pre_order(pairs, 2, way, limit)
        assert [tuple(r) for r in walk.depth_first().orderBy("place").collect()] == [(i, *x) for i, x in enumerate(want)]
    walk = api.traverse(2).strategy("dfs")
    want = _pre_order(pairs, 2, "both", 1 << 30)
    paths = walk.paths()
    assert [(p.end, len(p)) for p in paths] == [x[:2] for x in want] and all(p.start == 2 for p in paths)
    assert paths[-1] == paths[len(paths) - 1] == paths[:][-1]
    assert api.traverse(24).strategy("dfs").nodes() == [24]
    assert api.traverse(20).direction("outgoing").strategy("dfs").nodes() == [20, 21, 22]


def test_depth_first_memory(spark):
    """The driver holds no path for each step: here those would take over 50 MB."""
    n, wide = 600, 20
    api = GraphApi(links(spark, [(i, (i + k) % n) for i in range(n) for k in range(1, wide + 1)]))
    tracemalloc.start()
    try:
        nodes = api.traverse(0).direction("outgoing").strategy("dfs").nodes()
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert nodes == list(range(n)) and most < 10 << 20


def test_long_chain(spark):
    """The plan of a far search is as large as that of a near one."""
    n = 12
    graph = links(spark, [(i, i + 1) for i in range(n)])
    starts = spark.createDataFrame([(0,)], "start long")
    near, far = (frontier.expand(starts, frontier.oriented(graph.rels(), "out"), 0, d)._jdf.queryExecution().optimizedPlan().toString() for d in (3, n))
    assert len(near.splitlines()) == len(far.splitlines())
    api = GraphApi(graph)
    assert api.traverse(0).direction("outgoing").nodes() == list(range(n + 1))
    assert len(api.shortest_path(0, n).find()) == n


def test_shortest_path(spark):
    api = GraphApi(links(spark, [(1, 2), (2, 3), (3, 4), (1, 4)], nodes=range(1, 7)))
    p = api.shortest_path(1, 3).direction("outgoing").find()
    assert (p.nodes, p.edges, len(p), p.start, p.end, p.is_empty) == ((1, 2, 3), (100, 101), 2, 1, 3, False)
    assert api.shortest_path(2, 2).find() == PathResult((2,))
    assert api.shortest_path(1, 6).find() is None
    assert api.shortest_path(4, 1).direction("outgoing").find() is None
    assert len(api.shortest_path(4, 1).find()) == 1
    with pytest.raises(QueryError):
        api.shortest_path(1, 77).find()


def test_weighted_path(spark):
    api = GraphApi(links(spark, [(1, 2), (2, 3), (1, 3), (3, 1), (1, 2)], costs=[1, 1, 5, 0, 0.5], nodes=range(1, 6)))
    find = lambda w: api.weighted_shortest_path(1, 3).direction("outgoing").weight_by(w).find()
    assert find("cost") == (1.5, PathResult((1, 2, 3), (104, 101)))
    assert find(F.col("cost") * 2)[0] == 3.0
    assert find(lambda row: row["cost"])[0] == 1.5
    assert find(lambda row: 1 / 0) == (1.0, PathResult((1, 3), (102,)))  # failing weights count 1
    assert find(None)[0] == 1.0
    assert api.weighted_shortest_path(1, 5).find() is None
    assert api.weighted_shortest_path(1, 1).find() == (0.0, PathResult((1,)))
    with pytest.raises(QueryError):
        find(F.lit(-1.0))


def test_subgraph(spark):
    api = GraphApi(links(spark, [(1, 2), (2, 3), (3, 4), (2, 1), (3, 1)]))
    nodes, edges = api.subgraph(1).direction("outgoing").max_depth(2).tables()
    assert values(nodes.select("id")) == [(1,), (2,), (3,)]
    assert values(edges.select("src", "dst")) == [(1, 2), (2, 1), (2, 3), (3, 1)]


def test_pattern_builder(spark):
    p = GraphApi(social(spark)).pattern()
    chain = p.node("a").label("Person").where_prop("name", "Alice").edge().label("KNOWS").edge_var("k").node("b")
    assert values(chain.project("a", ["name"]).project("b", ["name", "age"]).project("k", ["since"]).execute()) == [("Alice", "Bob", 25, 2001), ("Alice", "Carol", 30, None)]
    assert chain.where_prop("age", 25).execute().count() == 1
    assert p.node("a").edge("incoming").where_edge_prop("since", 2005).node("b").execute().count() == 1
    for wrong in (lambda: p.edge(), lambda: p.node("a").node("b"), lambda: p.node("a").edge().execute(), lambda: p.edge_var("x"), lambda: p.execute(), lambda: p.node("a").edge().node("a").execute()):
        with pytest.raises(QueryError):
            wrong()
