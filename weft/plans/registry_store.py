"""Registered queries of the store, the element API, declarations, imports and exports. Writes
run on the whole star graph; files go to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.fluent import Direction, GraphApi
from weft.operators.graph import PropertyGraph
from weft.operators.session import query
from weft.operators.storage import shared_folder
from weft.operators.store import GraphStore
from weft.plans.syntax import QueryError
from weft.sources.exports import Cursor, display, export, render, to_dicts
from weft.sources.imports import import_csv_edges, import_csv_nodes, import_json, import_script, load_graph, restore_graph, save_graph
from weft.sources.tables import EDGE_BITS, EDGES, VERTICES, star_graph

QUERIES: dict = {}
SQL: dict[str, str] = {}
REGION = VERTICES["Region"][0] << 48
NATION = VERTICES["Nation"][0] << 48
#: Edges of each type, counted in the tables.
ALL_EDGES = "SELECT 'IN_REGION' AS t, count(*) AS n FROM nation UNION ALL SELECT 'LIVES_IN', count(*) FROM customer UNION ALL SELECT 'BASED_IN', count(*) FROM supplier UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)"


def stored(name: str, sql: str):
    """A function of a store of the star graph."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(GraphStore(star_graph(spark, sf_dir)))

        QUERIES[name], SQL[name] = run, sql
        return f

    return add


def _rows(store: GraphStore, rows: list[tuple], schema: str) -> DataFrame:
    return store.spark.createDataFrame(rows, schema)


def _place(store: GraphStore) -> str:
    return f"{shared_folder(store.spark)}/weft_{uuid.uuid4().hex}"


def _types(store: GraphStore) -> DataFrame:
    """Edges of every type."""
    return query(store.graph, "MATCH ()-[e]->() RETURN type(e) AS t, COUNT(*) AS n GROUP BY type(e)")


def _refused(f) -> bool:
    try:
        f()
    except QueryError:
        return True
    return False


# ---- writes ------------------------------------------------------------------------


@stored("m1_create", "SELECT 'a' AS name, CAST(2 AS BIGINT) AS w, 'b' AS far, count(*) + 2 AS n FROM (SELECT 1 FROM region UNION ALL SELECT 1 FROM nation UNION ALL SELECT 1 FROM customer UNION ALL SELECT 1 FROM supplier UNION ALL SELECT 1 FROM part UNION ALL SELECT 1 FROM orders)")
def _(store):
    store.execute("CREATE (a:Mark {name: 'a', gone: NULL})-[:AT {w: 2}]->(b:Mark {name: 'b'})")
    return store.execute("MATCH (a:Mark)-[e:AT]->(b:Mark) RETURN a.name AS name, e.w AS w, b.name AS far").rows.withColumn("n", F.lit(store.graph.node_count()).cast("long"))


@stored("m4_create_map", "SELECT 'x' AS name, CAST(3 AS BIGINT) AS size, true AS flag")
def _(store):
    store.execute("CREATE (a:Mark $map)", {"map": {"name": "x", "size": 3, "flag": True, "gone": None}})
    return store.execute("MATCH (a:Mark) RETURN a.name AS name, a.size AS size, a.flag AS flag").rows


@stored("m7_delete_edges_all_types", f"SELECT t, n - CASE t WHEN 'BASED_IN' THEN (SELECT count(*) FROM supplier WHERE s_nationkey < 10) ELSE 0 END AS n, (SELECT count(*) FROM supplier WHERE s_nationkey < 10) AS counted FROM ({ALL_EDGES})")
def _(store):
    counted = store.execute("MATCH (s:Supplier)-[e:BASED_IN]->(n:Nation) WHERE n.nationkey < 10 DELETE e").counters.edges_deleted
    return _types(store).withColumn("counted", F.lit(counted).cast("long"))


@stored("m7_detach_delete_orders", "SELECT t, n FROM (SELECT 'IN_REGION' AS t, count(*) AS n FROM nation UNION ALL SELECT 'LIVES_IN', count(*) FROM customer UNION ALL SELECT 'BASED_IN', count(*) FROM supplier UNION ALL SELECT 'PLACED', count(*) FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'))")
def _(store):
    store.execute("MATCH (o:Orders {status: 'F'}) DETACH DELETE o")
    return _types(store)


@stored("m8_unwind_match_delete", f"SELECT t, n - CASE t WHEN 'IN_REGION' THEN (SELECT count(*) FROM nation WHERE n_nationkey IN (3, 5, 8)) ELSE 0 END AS n FROM ({ALL_EDGES})")
def _(store):
    store.execute("UNWIND [3, 5, 8] AS x MATCH (n:Nation)-[e:IN_REGION]->(r) WHERE n.nationkey = x DELETE e")
    return _types(store)


@stored("m10_pipeline_set", "SELECT c_custkey AS k, count(o_orderkey) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 10")
def _(store):
    store.execute("MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH c, COUNT(o) AS n WHERE n > 10 SET c.orders = n")
    return store.execute("MATCH (c:Customer) WHERE c.orders IS NOT NULL RETURN c.custkey AS k, c.orders AS orders").rows


@stored("m10_pipeline_delete", "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 10)")
def _(store):
    store.execute("MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH c, COUNT(o) AS n WHERE n > 10 DETACH DELETE c")
    return store.execute("MATCH (c:Customer)-[e:PLACED]->(o) RETURN COUNT(*) AS n").rows


@stored("m11_return_after_write", "SELECT r_name AS name, CAST(r_regionkey * 10 AS BIGINT) AS ten FROM region")
def _(store):
    return store.execute("MATCH (r:Region) SET r.ten = r.regionkey * 10 RETURN r.name AS name, r.ten AS ten").rows


@stored("m13_element_api", "SELECT (SELECT count(*) FROM region) + 1 AS regions, 'HERE' AS name, 2.5 :: DOUBLE AS w, (SELECT count(*) FROM nation) AS in_region, true AS gone")
def _(store):
    a, b = store.add_node("Region", name="NEW"), store.add_node("Mark", name="m")
    kept = store.add_edge("AT", a, REGION, w=2.5)
    store.remove_edge(store.add_edge("IN_REGION", NATION, a))
    store.update_node(a, {"name": "HERE"})
    store.remove_node(b)
    found = store.execute("MATCH (r:Region) RETURN COUNT(*) AS regions").rows
    return found.withColumns({"name": F.lit(store.graph.node(a)["name"]), "w": F.lit(store.graph.edge(kept, "AT")["w"]), "in_region": F.lit(store.graph.rels("IN_REGION").count()).cast("long"), "gone": F.lit(not store.graph.node_exists(b))})


@stored("m14_batch", "SELECT n_name AS name, CAST(1 AS BIGINT) AS seen FROM nation UNION ALL SELECT 'EXTRA', NULL")
def _(store):
    store.script("MATCH (n:Nation) SET n.seen = 1; CREATE (:Nation {name: 'EXTRA'});")
    _refused(lambda: store.script("MATCH (n:Nation) SET n.seen = 2; CREATE (n {name: 'no label'});"))
    return store.execute("MATCH (n:Nation) RETURN n.name AS name, n.seen AS seen").rows


@stored("m15_transactions", "SELECT (SELECT count(*) FROM region) + 1 AS kept, (SELECT count(*) FROM region) AS before, true AS refused")
def _(store):
    old = store.snapshot()
    store.begin()
    store.execute("CREATE (:Region {name: 'lost'})")
    refused = _refused(lambda: store.execute("CREATE INDEX ON :Region(name)"))
    store.rollback()
    store.begin()
    store.execute("CREATE (:Region {name: 'kept'})")
    store.commit()
    count = lambda g: g.nodes("Region").count()
    return _rows(store, [(count(store.graph), count(old), refused)], "kept long, before long, refused boolean")


@stored("m16_unique", "SELECT true AS twice, true AS clash, count(*) AS n FROM region")
def _(store):
    store.execute("CREATE CONSTRAINT ON (n:Region) ASSERT n.name IS UNIQUE")
    twice = _refused(lambda: store.execute("CREATE (:Region {name: 'z'}), (:Region {name: 'z'})"))
    clash = _refused(lambda: store.execute("MATCH (r:Region {regionkey: 0}) CREATE (:Region {name: r.name})"))
    with store.batch():
        store.execute("MATCH (r:Region) SET r.seen = 1")
    return _rows(store, [(twice, clash, store.execute("MATCH (r:Region {seen: 1}) RETURN COUNT(*) AS n").rows.first()[0])], "twice boolean, clash boolean, n long")


@stored("m17_vacuum", "SELECT n_name AS name, n_nationkey AS k FROM nation WHERE n_nationkey > 3")
def _(store):
    small = GraphStore(PropertyGraph(store.spark, {k: store.graph.vertices[k] for k in ("Region", "Nation")}, {"IN_REGION": store.graph.edges["IN_REGION"]}))
    small.execute("MATCH (n:Nation) WHERE n.nationkey <= 3 DETACH DELETE n")
    small.vacuum()
    return small.execute("MATCH (n:Nation) RETURN n.name AS name, n.nationkey AS k").rows


# ---- declarations, procedures ------------------------------------------------------


@stored("d1_indexes", "SELECT 'label+property' AS kind, 'Part' AS label, 'brand' AS property")
def _(store):
    for one in ("CREATE INDEX ON :Part(brand)", "CREATE INDEX ON :Part(size)", "DROP INDEX ON :Part(size)"):
        store.execute(one)
    return store.execute("SHOW INDEX INFO").rows.select(F.col("`index type`").alias("kind"), "label", "property")


@stored("d2_constraints", "SELECT 'unique' AS kind, 'Part' AS label, 'partkey' AS properties")
def _(store):
    for one in ("CREATE CONSTRAINT ON (n:Part) ASSERT n.partkey IS UNIQUE", "CREATE CONSTRAINT ON (n:Part) ASSERT n.name IS UNIQUE", "DROP CONSTRAINT ON (n:Part) ASSERT n.name IS UNIQUE"):
        store.execute(one)
    return store.execute("SHOW CONSTRAINT INFO").rows.withColumnRenamed("constraint type", "kind")


@stored("d3_append_only", "SELECT 'Region' AS label, true AS refused, (SELECT count(*) FROM region) + 1 AS n")
def _(store):
    store.execute("ALTER LABEL :Region SET APPEND ONLY")
    refused = _refused(lambda: store.execute("MATCH (r:Region) SET r.x = 1")) and _refused(lambda: store.execute("MATCH (r:Region) DETACH DELETE r"))
    store.execute("CREATE (:Region {name: 'more'})")
    return store.execute("SHOW APPEND ONLY INFO").rows.withColumns({"refused": F.lit(refused), "n": F.lit(store.graph.nodes("Region").count()).cast("long")})


@stored("w10_refused_procedures", "SELECT * FROM (VALUES ('db.restore', true), ('db.snapshot', true), ('db.unknown', true)) t(name, refused)")
def _(store):
    return _rows(store, [(n, _refused(lambda n=n: store.execute(f"CALL {n}() YIELD x RETURN x"))) for n in ("db.restore", "db.snapshot", "db.unknown")], "name string, refused boolean")


# ---- reads that need the API -------------------------------------------------------


@stored("s10_label_read", "SELECT * FROM (VALUES ('Region', CAST(0 AS BIGINT)), ('Nation', 1)) t(label, ordinal)")
def _(store):
    return _rows(store, [(store.graph.node_label(i), i >> 48) for i in (REGION + 1, NATION + 2)], "label string, ordinal long")


@stored("s14_adjacency_by_label", "SELECT c_custkey AS k FROM customer WHERE c_nationkey = 7")
def _(store):
    customer = VERTICES["Customer"][0] << 48
    return store.graph.incoming(NATION + 7, "LIVES_IN").select((F.col("src") - customer).alias("k"))


@stored("g9_subgraph_types", "SELECT 'IN_REGION' AS t, count(*) AS n FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'LIVES_IN', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION ALL SELECT 'BASED_IN', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def _(store):
    _, edges = GraphApi(store.graph).subgraph(REGION + 2).direction("incoming").max_depth(2).tables()
    return edges.groupBy(F.col("label").alias("t")).agg(F.count(F.lit(1)).alias("n"))


#: What is below region 1, in the order of edge ids: by type, then by key.
_BELOW = f"""WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1),
x AS (SELECT CAST(-1 AS BIGINT) AS nk, 0 AS kind, CAST({REGION} + 1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS depth
      UNION ALL SELECT n_nationkey, 0, {NATION} + n_nationkey, 1 FROM n
      UNION ALL SELECT n_nationkey, 1, {VERTICES['Customer'][0] << 48} + c_custkey, 2 FROM customer JOIN n ON c_nationkey = n_nationkey
      UNION ALL SELECT n_nationkey, 2, {VERTICES['Supplier'][0] << 48} + s_suppkey, 2 FROM supplier JOIN n ON s_nationkey = n_nationkey)
SELECT row_number() OVER (ORDER BY nk, kind, id) - 1 AS place, id, depth FROM x"""


@stored("g5_depth_first_order", _BELOW)
def _(store):
    below = GraphApi(store.graph).traverse(REGION + 1).direction("incoming").max_depth(2).depth_first()
    return below.select("place", F.col("node").alias("id"), "depth")


@stored("g6_depth_first_paths", f"SELECT {NATION} + n_nationkey AS id, CAST(1 AS BIGINT) AS depth, CAST({REGION} + 1 AS BIGINT) AS top FROM nation WHERE n_regionkey = 1 UNION ALL SELECT {REGION} + 1, 0, {REGION} + 1")
def _(store):
    found = GraphApi(store.graph).traverse(REGION + 1).direction(Direction.INCOMING).label("IN_REGION").strategy("dfs").paths()
    return _rows(store, [(p.end, len(p), p.nodes[0]) for p in found], "id long, depth long, top long")


@stored("s18_edge_ids", f"SELECT {EDGES.index('PLACED') << EDGE_BITS} + o_orderkey AS id FROM orders")
def _(store):
    return store.graph.rels("PLACED").select("id")


# ---- files -------------------------------------------------------------------------


def _new(store: GraphStore) -> GraphStore:
    return GraphStore(store.spark)


@stored("s21_csv_nodes", "SELECT c_custkey AS k, c_name AS name, round(c_acctbal, 2) AS bal FROM customer")
def _(store):
    path, new = _place(store), _new(store)
    export(query(store.graph, "MATCH (c:Customer) RETURN 'Buyer' AS label, c.custkey AS custkey, c.name AS name, c.acctbal AS bal, c.none AS empty"), path, "csv")
    import_csv_nodes(new, path)
    return new.execute("MATCH (b:Buyer) RETURN b.custkey AS k, b.name AS name, b.bal AS bal").rows.withColumn("bal", F.round("bal", 2))


@stored("s23_csv_edges", "SELECT n_name AS nation, count(*) AS n, sum(c_custkey) :: BIGINT AS keys FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(store):
    path, new = _place(store), GraphStore(PropertyGraph(store.spark, {k: store.graph.vertices[k] for k in ("Nation", "Customer")}))
    export(query(store.graph, "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN c.name AS src, n.name AS dst, 'IN' AS label, c.custkey AS k"), path, "csv")
    import_csv_edges(new, path, "name")
    return new.execute("MATCH (c:Customer)-[e:IN]->(n:Nation) RETURN n.name AS nation, COUNT(*) AS n, SUM(e.k) AS keys GROUP BY n.name").rows


@stored("s22_json_graph", "SELECT n_name AS n, r_name AS r, CAST(n_nationkey * 2 AS BIGINT) AS w FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(store):
    g, path, new = store.graph, _place(store), _new(store)
    node = lambda label: g.nodes(label).select(F.struct(F.lit(label).alias("label"), F.struct("name", F.col(f"{label.lower()}key").alias("key")).alias("properties")).alias("n"))
    nodes = node("Nation").unionAll(node("Region")).agg(F.collect_list("n").alias("nodes"))
    end = lambda label, name: F.struct(F.lit(label).alias("label"), F.struct(F.col(name).alias("name")).alias("match"))
    pairs = query(g, "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.name AS a, r.name AS b, n.nationkey * 2 AS w")
    edges = pairs.select(F.struct(end("Nation", "a").alias("source"), end("Region", "b").alias("target"), F.lit("IN").alias("label"), F.struct("w").alias("properties")).alias("e")).agg(F.collect_list("e").alias("edges"))
    nodes.crossJoin(edges).select(F.to_json(F.struct("nodes", "edges")).alias("value")).coalesce(1).write.text(path)
    import_json(new, path)
    return new.execute("MATCH (n:Nation)-[e:IN]->(r:Region) RETURN n.name AS n, r.name AS r, e.w AS w").rows


@stored("s20_script_import", "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey < 12")
def _(store):
    path, new = _place(store), _new(store)
    rows = query(store.graph, "MATCH (n:Nation) WHERE n.nationkey < 12 RETURN n.name AS name, n.nationkey AS k")
    rows.select(F.concat(F.lit("CREATE (:Nation {name: '"), "name", F.lit("', k: "), F.col("k").cast("string"), F.lit("});")).alias("value")).coalesce(1).write.text(path)
    import_script(new, path)
    return new.execute("MATCH (n:Nation) RETURN n.name AS name, n.k AS k").rows


@stored("s19_stored_graph", f"{ALL_EDGES}")
def _(store):
    path = _place(store)
    save_graph(store.graph, path)
    return _types(GraphStore(load_graph(store.spark, path)))


@stored("k11_snapshot_restore", "SELECT (SELECT count(*) FROM region) AS first, (SELECT count(*) FROM region) + 1 AS second, (SELECT count(*) FROM region) AS restored")
def _(store):
    path = _place(store)
    small = GraphStore(PropertyGraph(store.spark, {k: store.graph.vertices[k] for k in ("Region", "Nation")}))
    first = save_graph(small.graph, path)
    small.execute("CREATE (:Region {name: 'later'})")
    save_graph(small.graph, path)
    count = lambda g: g.nodes("Region").count()
    second = count(load_graph(store.spark, path))
    restore_graph(store.spark, path, first)
    return _rows(store, [(count(load_graph(store.spark, path, first)), second, count(load_graph(store.spark, path)))], "first long, second long, restored long")


def _sample(store: GraphStore) -> DataFrame:
    return query(store.graph, "MATCH (n:Nation) RETURN n.nationkey AS k, n.name AS name, n.none AS none ORDER BY n.nationkey")


@stored("k2_json_export", "SELECT n_nationkey :: BIGINT AS k, n_name AS name FROM nation")
def _(store):
    path = _place(store)
    export(_sample(store), path, "json")
    return store.spark.read.json(path).select("k", "name")


@stored("k3_csv_export", "SELECT n_nationkey AS k, n_name AS name, true AS blank FROM nation")
def _(store):
    path = _place(store)
    export(_sample(store), path, "csv")
    return store.spark.read.csv(path, header=True).select(F.col("k").cast("int").alias("k"), "name", F.col("none").isNull().alias("blank"))


@stored("k5_formats", "SELECT * FROM (VALUES ('csv', false), ('gql', false), ('json', false), ('parquet', false), ('xml', true)) t(format, refused)")
def _(store):
    return _rows(store, [(f, _refused(lambda f=f: export(_sample(store), _place(store), f))) for f in ("csv", "gql", "json", "parquet", "xml")], "format string, refused boolean")


@stored("k4_table", "SELECT '| ' || rpad(n_nationkey :: VARCHAR, greatest(1, (SELECT max(length(n_nationkey :: VARCHAR)) FROM nation)) :: INTEGER, ' ') || ' | ' || rpad(n_name, greatest(4, (SELECT max(length(n_name)) FROM nation)) :: INTEGER, ' ') || ' |      |' AS line FROM nation")
def _(store):
    return _rows(store, [(x,) for x in render(_sample(store)).split("\n")[2:]], "line string")


@stored("k6_display", "SELECT n_nationkey :: VARCHAR AS k, '[\"' || n_name || '\",' || n_nationkey || ']' AS list FROM nation")
def _(store):
    df = _sample(store).select("k", F.array(F.col("name"), F.col("k").cast("string")).alias("l"))
    shown = display(F.col("l"), df.schema["l"].dataType)
    return df.select(display(F.col("k"), df.schema["k"].dataType).alias("k"), F.regexp_replace(shown, r'"(\d+)"\]', r"$1]").alias("list"))


@stored("k7_cursor", "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1) // 10 AS page, n_nationkey :: BIGINT AS k, (row_number() OVER (ORDER BY n_nationkey) - 1) // 10 < (SELECT (count(*) - 1) // 10 FROM nation) AS more FROM nation")
def _(store):
    cursor, out, page, more = Cursor(_sample(store)), [], 0, True
    while more:
        rows, more = cursor.pull(10)
        out += [(page, r["k"], more) for r in rows]
        page += 1
    return _rows(store, out, "page long, k long, more boolean")


@stored("k9_dicts", "SELECT n_nationkey :: BIGINT AS k, n_name AS name, 'Nation' AS label FROM nation")
def _(store):
    rows = to_dicts(query(store.graph, "MATCH (n:Nation) RETURN n.nationkey AS k, n.name AS name, labels(n) AS l"))
    return _rows(store, [(r["k"], r["name"], r["l"][0]) for r in rows], "k long, name string, label string")
