import pytest

from weft.operators.fluent import GraphApi
from weft.operators.store import GraphStore
from weft.plans.syntax import QueryError

from .graphs import social, values


@pytest.fixture
def store(spark):
    return GraphStore(social(spark))


def changed(result):
    return {k: v for k, v in vars(result.counters).items() if v}


def test_create_and_return(spark):
    s = GraphStore(spark)
    r = s.execute("CREATE (a:P {name: 'x', n: 1, none: NULL}), (b:P $m), (a)-[:R {w: 2}]->(b) RETURN a.name, b.n", {"m": {"n": 5}})
    assert changed(r) == {"nodes_created": 2, "edges_created": 1, "properties_set": 4, "labels_added": 1}
    assert values(r.rows) == [("x", 5)]
    assert values(s.execute("MATCH (a:P)-[r:R]->(b) RETURN a.name, r.w, b.n").rows) == [("x", 2, 5)]


def test_match_create_uses_where_and_bindings(store):
    r = store.execute("MATCH (a:Person {name: 'Alice'}), (b:Person) WHERE b.age >= 35 CREATE (a)-[:LIKES {how: b.age + 1}]->(b)")
    assert changed(r) == {"edges_created": 2, "properties_set": 2}
    assert values(store.execute("MATCH (a)-[l:LIKES]->(b) RETURN b.name, l.how").rows) == [("Alice", 36), ("Dave", 41)]


def test_unwind_create(store):
    store.execute("UNWIND $rows AS x CREATE (n:Item {sku: x.sku, q: x.q})", {"rows": [{"sku": "a", "q": 1}, {"sku": "b"}]})
    assert values(store.execute("MATCH (i:Item) RETURN i.sku, i.q").rows) == [("a", 1), ("b", None)]
    store.execute("UNWIND [1, 2] AS x MATCH (p:Person {name: 'Bob'}) CREATE (t:Tag {v: x}), (p)-[:HAS]->(t)")
    assert values(store.execute("MATCH (:Person)-[:HAS]->(t) RETURN t.v").rows) == [(1,), (2,)]


def test_set_and_remove(store):
    assert changed(store.execute("MATCH (n:Person) WHERE n.age < 31 SET n.age = n.age * 2, n.tag = 'y'")) == {"properties_set": 4}
    assert values(store.execute("MATCH (n:Person) RETURN n.name, n.age, n.tag").rows) == [("Alice", 35, None), ("Bob", 50, "y"), ("Carol", 60, "y"), ("Dave", 40, None)]
    store.execute("MATCH (n:Person {name: 'Bob'}) REMOVE n.tag")
    store.execute("MATCH (n:Person {name: 'Carol'}) SET n.tag = NULL")
    assert values(store.execute("MATCH (n:Person) WHERE n.tag IS NOT NULL RETURN n.name").rows) == []
    store.execute("MATCH (a)-[k:KNOWS]->(b) WHERE k.since IS NULL SET k.since = b.age")
    assert values(store.execute("MATCH (a)-[k:KNOWS]->(b) RETURN k.since").rows) == [(2001,), (2005,), (60,)]
    store.execute("MATCH (n:Person {name: 'Dave'}) SET n += $m", {"m": {"age": 1}})
    store.execute("MATCH (n:Person {name: 'Alice'}) SET n = $m", {"m": {"nick": "Al"}})
    assert values(store.execute("MATCH (n:Person) RETURN n.name, n.age, n.nick").rows) == [("Bob", 50, None), ("Carol", 60, None), ("Dave", 1, None), (None, None, "Al")]
    store.execute("MATCH (n:Person) WITH n WHERE n.age > 55 SET n.old = true")
    assert values(store.execute("MATCH (n:Person) WHERE n.old = true RETURN n.name").rows) == [("Carol",)]


def test_delete(store):
    with pytest.raises(QueryError):
        store.execute("MATCH (n:Person {name: 'Bob'}) DELETE n")
    assert changed(store.execute("MATCH (a {name: 'Dave'})-[k]->(b) DELETE k")) == {"edges_deleted": 1}
    assert changed(store.execute("MATCH (n:Person {name: 'Dave'}) DELETE n")) == {"nodes_deleted": 1}
    assert changed(store.execute("MATCH (a {name: 'Alice'})-[k]->(b) DETACH DELETE b")) == {"nodes_deleted": 2, "edges_deleted": 2}
    assert (store.graph.node_count(), store.graph.edge_count()) == (1, 0)


def two_types(spark):
    """Edges of two types that bear one id."""
    g = social(spark)
    likes = spark.createDataFrame([(10, 1, 4, 1), (11, 2, 3, 1)], "id long, src long, dst long, since long")
    return g.with_edges("LIKES", likes, "Person", "Person")


def test_edges_are_told_by_type_and_id(spark):
    store = GraphStore(two_types(spark))
    assert changed(store.execute("MATCH (a)-[k:KNOWS]->(b {name: 'Bob'}) WHERE a.name = 'Alice' DELETE k")) == {"edges_deleted": 1}
    assert (store.graph.rels("KNOWS").count(), store.graph.rels("LIKES").count()) == (2, 2)
    store.execute("MATCH (a)-[k:LIKES]->(b) SET k.since = 9")
    assert values(store.execute("MATCH ()-[k]->() RETURN type(k), k.since").rows) == [("KNOWS", 2005), ("KNOWS", None), ("LIKES", 9), ("LIKES", 9)]
    with pytest.raises(QueryError):
        store.graph.edge(11)
    assert store.graph.edge(11, "LIKES")["since"] == 9
    store.remove_edge(11, "LIKES")
    assert (store.graph.rels("KNOWS").count(), store.graph.rels("LIKES").count()) == (2, 1)
    whole = GraphApi(two_types(spark)).subgraph(1).max_depth(3).tables()[1]
    assert values(whole.select("label", "id")) == [("KNOWS", 10), ("KNOWS", 11), ("KNOWS", 12), ("LIKES", 10), ("LIKES", 11)]


def test_what_fails_leaves_nothing(store):
    before = store.graph
    for text in ("CREATE (:Person {name: 'new'}); CREATE (n {name: 'no label'})", "CREATE (:Person {name: 'new'}), (n)"):
        with pytest.raises(QueryError):
            store.script(text)
        assert store.graph is before
    with pytest.raises(QueryError):
        store.execute("CREATE (:Person {name: 'new'}), (n)")
    assert store.graph is before and store.add_node("Person", name="next") == 5


def test_merge(store):
    text = "MERGE (n:Person {name: 'Eve'}) ON CREATE SET n.age = 1 ON MATCH SET n.age = n.age + 1 RETURN n.name, n.age"
    assert values(store.execute(text).rows) == [("Eve", 1)]
    assert values(store.execute(text).rows) == [("Eve", 2)]
    assert store.graph.node_count() == 5


def test_constraints_and_append_only(store):
    store.execute("CREATE CONSTRAINT ON (n:Person) ASSERT n.name IS UNIQUE")
    for text in ("CREATE (:Person {name: 'Bob'})", "MATCH (n:Person {name: 'Bob'}) SET n.name = 'Dave'", "CREATE (:Person {name: 'Z'}), (:Person {name: 'Z'})"):
        with pytest.raises(QueryError):
            store.execute(text)
    store.execute("MATCH (n:Person {name: 'Bob'}) SET n.name = 'Bob'")
    assert values(store.execute("SHOW CONSTRAINT INFO").rows) == [("unique", "Person", "name")]
    store.execute("DROP CONSTRAINT ON (n:Person) ASSERT n.name IS UNIQUE")
    store.execute("ALTER LABEL :Person SET APPEND ONLY")
    for text in ("MATCH (n:Person) SET n.age = 1", "MATCH (n:Person) DETACH DELETE n"):
        with pytest.raises(QueryError):
            store.execute(text)
    store.execute("CREATE (:Person {name: 'New'})")
    assert values(store.execute("SHOW APPEND ONLY INFO").rows) == [("Person",)]
    store.execute("CREATE INDEX ON :Person(name)")
    assert values(store.execute("SHOW INDEX INFO").rows) == [("label+property", "Person", "name", 0)]
    store.execute("DROP INDEX ON :Person(name)")
    assert values(store.execute("SHOW INDEX INFO").rows) == []


def test_transactions_and_batches(store):
    before = store.snapshot()
    store.begin()
    store.execute("CREATE (:Person {name: 'T'})")
    assert store.graph.node_count() == 5
    with pytest.raises(QueryError):
        store.execute("CREATE INDEX ON :Person(name)")
    store.rollback()
    assert store.graph.node_count() == 4 == before.node_count()
    store.begin()
    store.execute("CREATE (:Person {name: 'T'})")
    store.commit()
    with store.batch():
        for i in range(3):
            store.execute("CREATE (:Person {name: $n})", {"n": str(i)})
    assert store.graph.node_count() == 8 and before.node_count() == 4
    assert store.graph.nodes().select("id").distinct().count() == 8
    store.vacuum()
    assert store.graph.node_count() == 8
    with pytest.raises(QueryError):
        store.commit()


def test_element_api(store):
    a = store.add_node("Thing", name="t", n=1)
    e = store.add_edge("HAS", 1, a, w=2.5)
    assert store.graph.node(a)["name"] == "t" and store.graph.edge(e)["w"] == 2.5
    store.update_node(a, {"name": "u"})
    assert store.graph.node(a)["n"] is None
    store.update_node(a, {"name": "v"}, label="Other")
    assert store.graph.node_label(a) == "Other"
    with pytest.raises(QueryError):
        store.add_edge("HAS", 1, 999)
    store.remove_edge(e)
    store.remove_node(1)
    assert (store.graph.node_count(), store.graph.edge_count()) == (4, 1)


def test_script(spark):
    s = GraphStore(spark)
    total = s.script("CREATE (:A {x: 'a;b'}); CREATE (:A {x: 'c'}); MATCH (a:A {x: 'c'}) SET a.y = 1;")
    assert total.nodes_created == 2 and values(s.execute("MATCH (a:A) RETURN a.x, a.y").rows) == [("a;b", None), ("c", 1)]
