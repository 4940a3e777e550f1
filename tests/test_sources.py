import json

import pytest

from weft.operators.graph import Catalog
from weft.operators.session import query
from weft.operators.store import GraphStore
from weft.plans.syntax import QueryError
from weft.sources.exports import Cursor, create_script, export, render, to_dicts
from weft.sources.imports import from_tables, import_csv_edges, import_csv_nodes, import_json, import_script, load_graph, restore_graph, save_graph, with_catalog

from .graphs import social, values


def test_csv(spark, tmp_path):
    (tmp_path / "n.csv").write_text('kind,name,age,score\nP,Ann,3,1.5\nP,"B, ""b""",,2\nQ,Z,x,\n')
    (tmp_path / "e.csv").write_text("from,to,label,w\nAnn,Z,KNOWS,1\n")
    s = GraphStore(spark)
    assert import_csv_nodes(s, str(tmp_path / "n.csv")).nodes_created == 3
    assert values(s.execute("MATCH (n:P) RETURN n.name, n.age, n.score").rows) == [("Ann", 3, 1.5), ('B, "b"', None, 2.0)]
    assert values(s.execute("MATCH (n:Q) RETURN n.age").rows) == [("x",)]
    assert import_csv_edges(s, str(tmp_path / "e.csv"), "name").edges_created == 1
    assert values(s.execute("MATCH (a)-[k:KNOWS]->(b) RETURN a.name, k.w, b.name").rows) == [("Ann", 1, "Z")]


def test_json(spark, tmp_path):
    doc = {
        "nodes": [{"label": "A", "properties": {"k": 1, "t": ["x"]}}, {"label": "A", "properties": {"k": 2}}, {"label": "B", "properties": {"z": "q"}}],
        "edges": [{"source": {"label": "A", "match": {"k": 1}}, "target": {"label": "B", "match": {"z": "q"}}, "label": "R", "properties": {"w": 2.5}}],
    }
    (tmp_path / "g.json").write_text(json.dumps(doc))
    s = GraphStore(spark)
    total = import_json(s, str(tmp_path / "g.json"))
    assert (total.nodes_created, total.edges_created) == (3, 1)
    assert values(s.execute("MATCH (a:A)-[r:R]->(b:B) RETURN a.k, a.t, r.w, b.z").rows) == [(1, '["x"]', 2.5, "q")]


def test_script_import_and_export(spark, tmp_path):
    (tmp_path / "s.gql").write_text("CREATE (:P {name: 'it\\'s; x'});\nCREATE (:P {name: 'b', n: 2});")
    s = GraphStore(spark)
    assert import_script(s, str(tmp_path / "s.gql")).nodes_created == 2
    rows = s.execute("MATCH (p:P) RETURN p.name AS name, p.n AS n ORDER BY name").rows
    script = [r[0] for r in create_script(rows).collect()]
    assert script == ["CREATE ({name: 'b', n: 2});", "CREATE ({name: 'it\\'s; x'});"]
    for kind in ("gql", "json", "csv", "parquet"):
        export(rows, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').collect()} == {("b", "2"), ("it's; x", None)}
    with pytest.raises(QueryError):
        export(rows, str(tmp_path / "x"), "xml")


def test_render_and_cursor(spark):
    df = query(social(spark), "MATCH (p:Person) RETURN p.name AS name, [p.age] AS l, NULL AS none ORDER BY p.name LIMIT 2")
    assert render(df).splitlines()[2] == "| Alice | [35] |      |"
    assert render(df, "csv") == "name,l,none\nAlice,[35],\nBob,[25],"
    assert json.loads(render(df, "json"))[0] == {"name": "Alice", "l": [35], "none": None}
    whole = list(to_dicts(query(social(spark), "MATCH (p:Person {name: 'Bob'})<-[k]-(a {name: 'Dave'}) RETURN p, k")))
    assert whole == [{"p": {"id": 2, "labels": ["Person"], "properties": {"name": "Bob", "age": 25}}, "k": {"id": 12, "type": "KNOWS", "start": 4, "end": 2, "properties": {"since": 2005}}}]
    with pytest.raises(QueryError):
        render(df, limit=1)
    c = Cursor(query(social(spark), "MATCH (p:Person) RETURN p.name ORDER BY p.name"))
    assert [len(c.pull(3)[0]), c.pull(3)[1]] == [3, False]
    c = Cursor(df)
    c.discard()
    assert c.pull(5) == ([], False)


def test_versions(spark, tmp_path):
    s = GraphStore(with_catalog(social(spark), Catalog(unique=(("Person", "name"),))))
    path = str(tmp_path / "store")
    assert save_graph(s.graph, path) == 0
    s.execute("CREATE (:Person {name: 'New'})")
    assert save_graph(s.graph, path) == 1
    back = load_graph(spark, path)
    assert back.node_count() == 5 and back.catalog.unique == (("Person", "name"),)
    assert load_graph(spark, path, 0).node_count() == 4
    assert restore_graph(spark, path, 0).node_count() == 4 and load_graph(spark, path).node_count() == 4
    g = from_tables(spark, {"Person": f"{path}/v1/vertices/0"}, {"KNOWS": f"{path}/v1/edges/0"})
    assert (g.node_count(), g.edge_count()) == (5, 3)


def test_stream(spark, tmp_path):
    from weft.streaming.upserts import stream_edges, windowed_activity

    src = str(tmp_path / "in")
    spark.createDataFrame([(10, 1, 2, 7), (20, 3, 4, 8)], "id long, src long, dst long, since long").coalesce(1).write.parquet(src)
    s = GraphStore(social(spark))
    q = stream_edges(s, "KNOWS", spark.readStream.schema("id long, src long, dst long, since long").parquet(src), str(tmp_path / "cp"))
    q.awaitTermination()
    assert values(s.execute("MATCH (a)-[k:KNOWS]->(b) RETURN id(a), id(b), k.since").rows) == [(1, 2, 7), (1, 3, None), (3, 4, 8), (4, 2, 2005)]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert windowed_activity(events).agg({"n": "sum"}).first()[0] == events.count()


def test_command_line(spark, tmp_path):
    from weft.__main__ import main

    store = str(tmp_path / "db")
    assert main(["exec", store, "CREATE (:A {x: 1}); CREATE (:A {x: 2})"], spark) == "nodes created: 2, properties set: 2, labels added: 1"
    assert main(["query", store, "MATCH (a:A) RETURN a.x AS x ORDER BY x", "--format", "csv"], spark) == "x\n1\n2"
    (tmp_path / "n.csv").write_text("label,x\nA,3\n")
    main(["import", store, str(tmp_path / "n.csv"), "--format", "csv"], spark)
    main(["export", store, "MATCH (a:A) RETURN a.x AS x", str(tmp_path / "out")], spark)
    assert values(spark.read.json(str(tmp_path / "out"))) == [(1,), (2,), (3,)]


def test_guards(spark):
    from weft.operators.session import fetch

    df = query(social(spark), "MATCH (p:Person) RETURN p.name")
    assert len(fetch(df, seconds=60)) == 4
    with pytest.raises(QueryError):
        fetch(df, most_rows=3)
    with pytest.raises(QueryError):
        fetch(spark.range(1 << 40).selectExpr("sum(hash(id)) AS s"), seconds=1)
