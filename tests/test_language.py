import pytest

from weft.operators.graph import PropertyGraph
from weft.operators.session import query, validate
from weft.plans.syntax import QueryError

from .graphs import links, social, values


@pytest.fixture(scope="module")
def g(spark):
    return social(spark)


def one(graph, text, params=None):
    return tuple(query(graph, f"RETURN {text}", params).collect()[0])


def test_null_and_type_rules(g):
    assert one(g, "NULL = 1, NULL <> 1, NULL < 1, 1 = 'x', 1 <> 'x', 1 < 'x', 1 = 1.0") == (False, True, None, False, True, None, True)
    assert one(g, "NULL AND false, NULL OR true, NOT NULL, 1 AND true, 'x' OR true") == (False, True, None, None, True)
    assert one(g, "NULL IN [1, NULL], 1 IN [NULL, 1], 2 IN [1, NULL], 'a' IN [1]") == (False, True, False, False)
    assert one(g, "1 STARTS WITH 'x', 'abc' CONTAINS 'b', NULL IS NULL") == (None, True, True)


def test_arithmetic(g):
    assert one(g, "9223372036854775807 + 1, -7 / 2, 1 / 0, 1.5 / 0, 'a' + 1") == (-(2**63), -3, None, None, None)
    assert one(g, "2 * 3.5, 7 - 10, -(2 + 3)") == (7.0, -3, -5)


def test_lists_and_functions(g):
    assert one(g, "[1, 2.5][1], [1, 2][-1], [1, 2][5], [][0], size([1, 2]), size('héé')") == (2.5, None, None, None, 2, 3)
    assert one(g, "range(2, 4), range(3, 1), size(range(1, 1000000)), range(1, 1000002)") == ([2, 3, 4], [], 1_000_000, None)
    assert one(g, "ALL(x IN [] WHERE x > 1), ANY(x IN [] WHERE x > 1), NONE(x IN [NULL] WHERE x > 1), SINGLE(x IN [1, 2, 3] WHERE x > 2)") == (True, False, True, True)
    assert one(g, "toLower('ÀB'), toUpper(1), coalesce(NULL, 2, 3), ALL(x IN 5 WHERE true)") == ("àb", None, 2, None)
    assert one(g, "$a, $b[1], $1", {"a": 1, "b": [1, "x"], "1": True}) == (1, "x", True)


def test_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, -0.0)], "id long, x double")
    g = PropertyGraph(spark).with_vertices("X", df)
    assert values(query(g, "MATCH (n:X) RETURN id(n), n.x = n.x, n.x > 0, n.x = 0.0")) == [(1, False, False, False), (2, True, True, False), (3, True, False, True)]


def test_matching(g):
    assert values(query(g, "MATCH (a:Person)-[:KNOWS]->(b) WHERE b.age < 30 RETURN a.name, b.name")) == [("Alice", "Bob"), ("Dave", "Bob")]
    assert values(query(g, "MATCH (b {name: 'Bob'})<-[k:KNOWS]-(a) RETURN a.name, k.since")) == [("Alice", 2001), ("Dave", 2005)]
    assert values(query(g, "MATCH (a:Person)-[:KNOWS]->(b)<-[:KNOWS]-(c) WHERE a.name <> c.name RETURN a.name, c.name")) == [("Alice", "Dave"), ("Dave", "Alice")]
    assert values(query(g, "MATCH (a)-[k]-(b {name: 'Carol'}) RETURN a.name")) == [("Alice",)]
    assert values(query(g, "MATCH (a:Nobody) RETURN a.name")) == []
    assert query(g, "MATCH (a:Person {age: 35.0}) RETURN a").count() == 0  # inline constraints are typed
    assert query(g, "MATCH (a:Person {name: NULL}) RETURN a").count() == 4
    assert values(query(g, "MATCH (a:Person)-[:KNOWS]->(b), (c:Person)-[:KNOWS]->(b) RETURN COUNT(*)")) == [(5,)]


def test_loops_and_parallel_edges(spark):
    g = links(spark, [(1, 1), (1, 2), (1, 2)])
    assert values(query(g, "MATCH (a {k: 1})-[r]->(b) RETURN b.k")) == [(1,), (2,), (2,)]
    assert values(query(g, "MATCH (a {k: 1})-[r]-(b) RETURN b.k")) == [(1,), (1,), (2,), (2,)]


def test_optional_match(g):
    got = values(query(g, "MATCH (a:Person) OPTIONAL MATCH (a)-[k:KNOWS]->(b) WHERE b.age > 26 RETURN a.name, b.name, k"))
    assert [r[:2] for r in got] == [("Alice", "Carol"), ("Bob", None), ("Carol", None), ("Dave", None)]
    assert [r[2] is None for r in got] == [False, True, True, True]
    assert values(query(g, "OPTIONAL MATCH (a:Nobody) RETURN a")) == [(None,)]


def test_aggregates(g):
    assert values(query(g, "MATCH (p:Person) RETURN COUNT(*) AS n, SUM(p.age) AS s, AVG(p.age) AS a, MIN(p.name) AS lo, MAX(p.age) AS hi")) == [(4, 130, 32.5, "Alice", 40)]
    assert values(query(g, "MATCH (p:Person) WHERE p.age > 99 RETURN COUNT(p), SUM(p.age), AVG(p.age)")) == [(0, None, None)]
    assert values(query(g, "MATCH (p:Person) WHERE p.age > 99 WITH SUM(p.age) AS s RETURN s")) == [(0,)]
    df = query(g, "MATCH (a)-[:KNOWS]->(b) RETURN a.name, COUNT(*), collect(b.age) GROUP BY a.name ORDER BY COUNT(*) DESC")
    assert df.columns == ["a.name", "COUNT(*)", "COLLECT(b.age)"]
    assert [(r[0], r[1], sorted(r[2])) for r in df.collect()] == [("Alice", 2, [25, 30]), ("Dave", 1, [25])]
    assert values(query(g, "MATCH (a)-[k:KNOWS]->(b) RETURN COUNT(k.since), COUNT(DISTINCT b)")) == [(2, 2)]


def test_order_distinct_limit(g):
    assert [r[0] for r in query(g, "MATCH (a)-[k:KNOWS]->(b) RETURN k.since ORDER BY k.since").collect()] == [2001, 2005, None]
    assert [r[0] for r in query(g, "MATCH (a)-[k:KNOWS]->(b) RETURN k.since ORDER BY k.since DESC").collect()] == [None, 2005, 2001]
    assert [r[0] for r in query(g, "MATCH (a)-[:KNOWS]->(b) RETURN DISTINCT b.name AS n ORDER BY n DESC").collect()] == ["Carol", "Bob"]
    assert [r[0] for r in query(g, "MATCH (p:Person) RETURN p.name ORDER BY p.age DESC LIMIT 2").collect()] == ["Dave", "Alice"]
    assert query(g, "MATCH (p:Person) RETURN p.name LIMIT 0").count() == 0
    assert query(g, "RETURN 1 SKIP 1").count() == 0


def test_pipelines(g):
    assert values(query(g, "MATCH (a)-[:KNOWS]->(b) WITH a, COUNT(b) AS n WHERE n > 1 MATCH (a)-[:KNOWS]->(c) RETURN a.name, n, c.name")) == [("Alice", 2, "Bob"), ("Alice", 2, "Carol")]
    assert values(query(g, "MATCH (p:Person) WITH p ORDER BY p.age SKIP 1 LIMIT 2 RETURN p.name")) == [("Alice",), ("Carol",)]
    assert values(query(g, "MATCH (p:Person) WITH collect(p.name) AS ns UNWIND ns AS n WITH n WHERE n CONTAINS 'o' RETURN n, size(n) AS l")) == [("Bob", 3), ("Carol", 5)]
    assert values(query(g, "MATCH (p:Person) WITH collect(p) AS ps UNWIND ps AS p RETURN p.name, id(p)")) == [("Alice", 1), ("Bob", 2), ("Carol", 3), ("Dave", 4)]
    assert values(query(g, "MATCH (p:Person) WITH DISTINCT p.age > 29 AS old RETURN old")) == [(False,), (True,)]
    assert values(query(g, "MATCH (p:Person) WITH p AS q RETURN q.name, q.age > 30")) == [("Alice", True), ("Bob", False), ("Carol", False), ("Dave", True)]
    assert values(query(g, "UNWIND [1, 2] AS x MATCH (p:Person) WITH x, COUNT(p) AS n RETURN x, n")) == [(1, 4), (2, 4)]
    assert values(query(g, "UNWIND NULL AS x RETURN x")) == [] and values(query(g, "UNWIND 5 AS x RETURN x")) == [(5,)]
    assert values(query(g, "WITH 5 AS y UNWIND y AS x RETURN x")) == []
    assert values(query(g, "CALL db.vertex_labels() YIELD label RETURN label")) == [("Person",)]


def test_variable_length(spark):
    chain = links(spark, [(1, 2), (2, 3), (3, 4), (4, 5)])
    ends = lambda g, p: [r[0] for r in values(query(g, f"MATCH (a {{k: 1}})-[{p}]->(b) RETURN b.k"))]
    assert ends(chain, ":R*1..3") == [2, 3, 4]
    assert ends(chain, ":R*2") == [3]
    assert ends(chain, "*") == [1, 2, 3, 4, 5]
    assert ends(chain, "*..1") == [1, 2]
    assert ends(chain, "*4..9") == [5]
    cycle = links(spark, [(1, 2), (2, 3), (3, 1)])
    assert ends(cycle, "*1..10") == [2, 3]  # the start is never met again
    diamond = links(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (1, 4)])
    assert ends(diamond, "*2..3") == []  # all are nearer than two hops
    assert values(query(diamond, "MATCH (a {k: 1})-[r*1..2]->(b) RETURN b.k, id(b), type(r)")) == [(2, 2, "R"), (3, 3, "R"), (4, 4, "R")]
    assert values(query(chain, "MATCH p = (a {k: 1})-[*1..3]->(b)-[:R]->(c) RETURN nodes(p), length(p)")) == [([1, 2, 3, 4, 5], 4), ([1, 2, 3, 4], 3), ([1, 2, 3], 2)]
    assert values(query(chain, "MATCH p = (c {k: 3})<-[*1..3]-(b) RETURN nodes(p), relationships(p)")) == [([3, 2, 1], [101, 100]), ([3, 2], [101])]


def test_shortest_path_function(spark):
    g = links(spark, [(1, 2), (2, 3), (3, 4), (1, 3)], nodes=range(1, 7))
    assert values(query(g, "MATCH (a {k: 1}), (b) RETURN b.k, shortestPath(a, b)")) == [(1, [1]), (2, [1, 2]), (3, [1, 3]), (4, [1, 3, 4]), (5, None), (6, None)]
    assert values(query(g, "MATCH (a {k: 4}), (b {k: 1}) RETURN shortestPath((a)-[:R*..5]-(b)) AS x, shortestPath((a)-[*..1]-(b)) AS y, shortestPath((a)-[*]->(b)) AS z")) == [([4, 3, 1], None, None)]


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (a) RETURN b",
        "MATCH (a) RETURN a.x, COUNT(*)",
        "MATCH (a) RETURN a.x, COUNT(*) GROUP BY a.y",
        "MATCH (a) WHERE COUNT(a) > 1 RETURN a",
        "MATCH (a)-[:R]->(a) RETURN a",
        "MATCH (a) WITH a.x AS x RETURN a",
        "RETURN nosuch(1)",
        "RETURN size(1, 2)",
        "RETURN $missing",
        "MATCH (a) RETURN a.x AS y, a.z AS y",
        "CALL db.nothing()",
        "MATCH (a) SET a.x = 1",
    ],
)
def test_errors(g, text):
    with pytest.raises(QueryError):
        query(g, text)


def test_ragged_properties(spark):
    g = PropertyGraph(spark).with_vertices("A", spark.createDataFrame([(1, 5, "x")], "id long, v int, w string")).with_vertices("B", spark.createDataFrame([(2, 2.5)], "id long, v double"))
    assert values(query(g, "MATCH (n) RETURN labels(n)[0], n.v, n.w")) == [("A", 5.0, "x"), ("B", 2.5, None)]
    assert values(query(g, "MATCH (n) WHERE n.v > 3 RETURN n.w")) == [("x",)]


def test_empty_graph(spark):
    g = PropertyGraph(spark)
    assert values(query(g, "MATCH (n) RETURN COUNT(*)")) == [(0,)]
    assert values(query(g, "MATCH (a)-[r:X]->(b) RETURN a")) == []


def test_plans_prune_and_push(spark, sf_dir):
    from weft.sources.tables import star_graph

    df = query(star_graph(spark, sf_dir), "MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE o.totalprice > 1000 RETURN c.mktsegment, COUNT(*) GROUP BY c.mktsegment")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000" in plan
    assert "c_name" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    # a hop whose end nothing reads needs no vertex table
    plan = query(star_graph(spark, sf_dir), "MATCH (c:Customer)-[r:PLACED]->(o) RETURN COUNT(o)")._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" in plan and "o_totalprice" not in plan


def test_validate():
    validate("MATCH (n) RETURN n")
    with pytest.raises(QueryError):
        validate("MATCH n")
