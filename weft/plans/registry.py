"""Registered queries over the star-schema tables: one or more for each operator, each
with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.fluent import GraphApi, degree
from weft.operators.graph import PropertyGraph
from weft.operators.session import query
from weft.operators.store import GraphStore
from weft.plans import registry_store
from weft.sources.exports import create_script
from weft.sources.tables import EDGE_BITS, EDGES, VERTICES, event_graph, star_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CUSTOMER = VERTICES["Customer"][0] << 48
PLACED = EDGES.index("PLACED") << EDGE_BITS


def _rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Sums of doubles depend on their order; results are compared rounded."""
    return df.select(*[F.round(f"`{f.name}`", digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def star(name: str, text: str, sql: str | None, params: dict | None = None, graph=star_graph) -> None:
    """A statement of the query language."""
    QUERIES[name] = lambda spark, sf_dir: _rounded(query(graph(spark, sf_dir), text, params))
    if sql:
        SQL[name] = sql


def api(name: str, sql: str | None, graph=star_graph):
    """A function of the graph."""

    def add(f: Callable[[PropertyGraph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _rounded(f(graph(spark, sf_dir)))
        if sql:
            SQL[name] = sql
        return f

    return add


NEXT = "nx AS (SELECT a.user_id AS u, b.user_id AS w, round(sum(abs(a.value)), 6) AS cost FROM events a JOIN events b ON b.event_id = a.event_id + 1 GROUP BY 1, 2)"
BOTH = NEXT + ", bo AS (SELECT u, w FROM nx UNION SELECT w, u FROM nx)"


def _reach(start: str, edges: str, depth: int) -> str:
    """Shortest depths from the starts, by a recursive query bounded by depth."""
    return f"r(s, v, d) AS ({start} UNION SELECT r.s, e.w, r.d + 1 FROM r JOIN {edges} e ON r.v = e.u WHERE r.d < {depth}), m AS (SELECT s, v, min(d) AS d FROM r GROUP BY 1, 2)"


# ---- scans -------------------------------------------------------------------------

star("s1_all_nodes", "MATCH (n) RETURN COUNT(*) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS n")
star("s2_label_scan", "MATCH (c:Customer) RETURN c.custkey AS custkey, c.mktsegment AS seg", "SELECT c_custkey AS custkey, c_mktsegment AS seg FROM customer")
star("s3_property_equality", "MATCH (p:Part {size: 15}) RETURN p.partkey AS k, p.brand AS brand", "SELECT p_partkey AS k, p_brand AS brand FROM part WHERE p_size = 15")
star("s4_multi_property", "MATCH (o:Orders {status: 'F', priority: '1-URGENT'}) RETURN o.orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
star("s8_point_lookup", "MATCH (c:Customer) WHERE id(c) = $id RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE c_custkey = 7", {"id": CUSTOMER + 7})
star("s12_edge_scan", "MATCH ()-[r:PLACED]->() RETURN COUNT(r) AS n", "SELECT count(*) AS n FROM orders")
star("s17_types_by_rel", "MATCH ()-[r]->() RETURN type(r) AS t, COUNT(*) AS n GROUP BY type(r)", "SELECT 'IN_REGION' AS t, count(*) AS n FROM nation UNION ALL SELECT 'LIVES_IN', count(*) FROM customer UNION ALL SELECT 'BASED_IN', count(*) FROM supplier UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)")


@api("s5_range_scan", "SELECT p_partkey AS k, p_size AS size FROM part WHERE p_size >= 10 AND p_size < 20")
def _(g):
    return g.nodes_in_range("Part", "size", 10, 20).select(F.col("partkey").alias("k"), "size")


@api("s6_greatest", "SELECT c_custkey AS k FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1")
def _(g):
    return g.node_of_greatest("Customer", "acctbal").select(F.col("custkey").alias("k"))


@api("s7_missing_property", "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Orders', count(*) FROM orders")
def _(g):
    return query(g, "MATCH (n) WHERE n.acctbal IS NULL RETURN labels(n)[0] AS label, COUNT(*) AS n GROUP BY labels(n)[0]")


@api("s9_projected_read", "SELECT p_name AS name FROM part WHERE p_partkey = 11")
def _(g):
    own = g.node_projected((VERTICES["Part"][0] << 48) + 11, ["name"])
    return g.spark.createDataFrame([(own["name"],)], "name string")


@api("s11_existence", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def _(g):
    rich = g.rels("PLACED").join(g.nodes("Orders").filter("totalprice > 250000").select(F.col("id").alias("dst")), "dst", "left_semi")
    return g.nodes("Customer").join(rich.select(F.col("src").alias("id")), "id", "left_semi").select(F.col("custkey").alias("k"))


@api("s13_adjacency", "SELECT o_orderkey AS k FROM orders WHERE o_custkey = 5")
def _(g):
    return g.outgoing(CUSTOMER + 5, "PLACED").select((F.col("id") - PLACED).alias("k"))


@api("s15_edges_between", "SELECT count(*) AS n FROM lineitem WHERE l_orderkey = 3 AND l_partkey = (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = 3)")
def _(g):
    order = (VERTICES["Orders"][0] << 48) + 3
    part = g.outgoing(order, "CONTAINS").agg(F.min("dst").alias("dst"))
    return g.rels("CONTAINS").filter(F.col("src") == order).join(part, "dst", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@api("s16_counts", "SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM lineitem) AS contained")
def _(g):
    return g.spark.createDataFrame([(g.nodes("Customer").count(), g.rels("CONTAINS").count())], "customers long, contained long")


@api("s18_endpoints", "SELECT o_orderkey AS k, o_custkey AS custkey FROM orders")
def _(g):
    return g.rels("PLACED").select((F.col("id") - PLACED).alias("k"), (F.col("src") - CUSTOMER).alias("custkey"))


# ---- projection and predicates -----------------------------------------------------

star("f1_projection", "MATCH (p:Part) RETURN p.partkey AS k, p.size * 2 + 1 AS twice, p.retailprice / 2 AS half", "SELECT p_partkey AS k, CAST(p_size AS BIGINT) * 2 + 1 AS twice, round(p_retailprice / 2, 2) AS half FROM part")
star("f2_distinct", "MATCH (p:Part) RETURN DISTINCT p.brand AS brand, p.size AS size ORDER BY p.brand", "SELECT DISTINCT p_brand AS brand, p_size AS size FROM part")
star("f3_entities", "MATCH (c:Customer)-[r:LIVES_IN]->(n) RETURN id(c) AS c, type(r) AS t, labels(n)[0] AS l, id(r) AS none", f"SELECT {CUSTOMER} + c_custkey AS c, 'LIVES_IN' AS t, 'Nation' AS l, CAST(NULL AS BIGINT) AS none FROM customer")
star("f4_where", "MATCH (o:Orders) WHERE o.totalprice > 100000 AND o.totalprice <= 120000 RETURN o.orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 120000")
star("f5_constant_return", "RETURN 1 + 2 * 3 AS a, 7 / 2 AS b, -7 / 2 AS c, 1 / 0 AS d, 'x' AS e", "SELECT CAST(7 AS BIGINT) AS a, CAST(3 AS BIGINT) AS b, CAST(-3 AS BIGINT) AS c, CAST(NULL AS BIGINT) AS d, 'x' AS e")
star("f6_missing_property", "MATCH (r:Region) RETURN r.name AS name, r.nothing AS nothing", "SELECT r_name AS name, CAST(NULL AS VARCHAR) AS nothing FROM region")
star("f7_two_valued_equality", "MATCH (n:Nation) RETURN n.nationkey AS k, n.gone = 1 AS a, n.gone <> 1 AS b, n.name = 3 AS c", "SELECT n_nationkey AS k, false AS a, true AS b, false AS c FROM nation")
star("f8_comparison", "MATCH (n:Nation) RETURN n.nationkey AS k, n.nationkey < 5 AS a, n.gone < 5 AS b, n.name < 5 AS c, n.nationkey >= 5.5 AS d", "SELECT n_nationkey AS k, n_nationkey < 5 AS a, CAST(NULL AS BOOLEAN) AS b, CAST(NULL AS BOOLEAN) AS c, n_nationkey >= 5.5 AS d FROM nation")
star("f9_three_valued_logic", "MATCH (n:Nation) RETURN n.nationkey AS k, n.gone < 1 OR n.nationkey > 3 AS a, n.gone < 1 AND n.nationkey > 3 AS b, NOT n.gone < 1 AS c", "SELECT n_nationkey AS k, CASE WHEN n_nationkey > 3 THEN true END AS a, CASE WHEN n_nationkey > 3 THEN NULL ELSE false END AS b, CAST(NULL AS BOOLEAN) AS c FROM nation")
star("f10_is_null", "MATCH (n) WHERE n.mktsegment IS NOT NULL AND n.brand IS NULL RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM customer")
star("f11_string_predicates", "MATCH (p:Part) WHERE p.name CONTAINS 'ring' AND p.brand STARTS WITH 'Brand' AND p.type ENDS WITH 'Y' RETURN p.partkey AS k", "SELECT p_partkey AS k FROM part WHERE contains(p_name, 'ring') AND starts_with(p_brand, 'Brand') AND ends_with(p_type, 'Y')")
star("f12_in_list", "MATCH (c:Customer) WHERE c.mktsegment IN ['BUILDING', 'MACHINERY', NULL, 3] RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
star("f14_list_predicates", "MATCH (p:Part) RETURN p.partkey AS k, ALL(x IN [p.size, 3] WHERE x > 2) AS a, ANY(x IN [p.size, p.none] WHERE x > 20) AS b, NONE(x IN [p.size] WHERE x > 20) AS c, SINGLE(x IN [p.size, 30] WHERE x > 20) AS d", "SELECT p_partkey AS k, p_size > 2 AS a, p_size > 20 AS b, NOT p_size > 20 AS c, NOT p_size > 20 AS d FROM part")
star("f15_arithmetic", "MATCH (c:Customer) RETURN c.custkey AS k, -c.custkey AS neg, c.custkey / 7 AS q, c.custkey / 0 AS z, c.custkey - 2 * 3 AS m, c.custkey + 0.5 AS f", "SELECT c_custkey AS k, -c_custkey AS neg, c_custkey // 7 AS q, CAST(NULL AS BIGINT) AS z, c_custkey - 6 AS m, c_custkey + CAST(0.5 AS DOUBLE) AS f FROM customer")
star("f18_parameters", "MATCH (c:Customer) WHERE c.mktsegment IN $segs AND c.acctbal > $low RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment IN ('BUILDING') AND c_acctbal > 1000.5", {"segs": ["BUILDING"], "low": 1000.5})

# ---- patterns ----------------------------------------------------------------------

star("j1_one_hop", "MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN c.name AS name, o.orderkey AS k", "SELECT c_name AS name, o_orderkey AS k FROM customer JOIN orders ON c_custkey = o_custkey")
star("j1_chain", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Orders) WHERE o.totalprice > 200000 RETURN r.name AS region, COUNT(*) AS n, SUM(o.totalprice) AS total GROUP BY r.name", "SELECT r_name AS region, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 200000 GROUP BY 1")
star("j1_edge_properties", "MATCH (o:Orders)-[l:CONTAINS {returnflag: 'R'}]->(p:Part) WHERE l.quantity > 45 RETURN p.brand AS brand, COUNT(*) AS n, SUM(l.quantity) AS q GROUP BY p.brand", "SELECT p_brand AS brand, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1")
star("j1c_incoming", "MATCH (o:Orders)<-[:PLACED]-(c:Customer {mktsegment: 'BUILDING'}) RETURN c.custkey AS c, COUNT(o) AS n GROUP BY c.custkey", "SELECT c_custkey AS c, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
star("j1c_both", "MATCH (n:Nation)-[r]-(x) RETURN n.name AS name, COUNT(x) AS n GROUP BY n.name", "SELECT n_name AS name, 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation")
star("j1c_both_loops", "MATCH (a:Customer)-[r:NEXT]-(b:Customer) RETURN a.custkey AS a, b.custkey AS b", f"WITH {NEXT} SELECT u AS a, w AS b FROM nx UNION ALL SELECT w, u FROM nx", graph=event_graph)
star("j2_variable_length", "MATCH (a:Customer {custkey: 3})-[:NEXT*1..2]->(b) RETURN b.custkey AS k", f"WITH RECURSIVE {NEXT}, {_reach('SELECT 3, 3, 0', 'nx', 2)} SELECT CAST(v AS BIGINT) AS k FROM m WHERE d BETWEEN 1 AND 2", graph=event_graph)
star("j2_exact_length", "MATCH (a:Customer)-[:NEXT*2]->(b) RETURN a.custkey AS a, COUNT(*) AS n GROUP BY a.custkey", f"WITH RECURSIVE {NEXT}, {_reach('SELECT c_custkey, c_custkey, 0 FROM customer', 'nx', 2)} SELECT CAST(s AS BIGINT) AS a, count(*) AS n FROM m WHERE d = 2 GROUP BY 1", graph=event_graph)
star("j2_from_zero", "MATCH (a:Customer {custkey: 3})-[:NEXT*..4]-(b:Customer) RETURN b.custkey AS k", f"WITH RECURSIVE {BOTH}, {_reach('SELECT 3, 3, 0', 'bo', 4)} SELECT CAST(v AS BIGINT) AS k FROM m", graph=event_graph)
star("j3_shared_variable", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation), (s:Supplier)-[:BASED_IN]->(n) RETURN n.name AS name, COUNT(*) AS n GROUP BY n.name", "SELECT n_name AS name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
star("j3_two_matches", "MATCH (c:Customer)-[:PLACED]->(o:Orders) MATCH (o)-[:CONTAINS]->(p:Part) WHERE p.size = 7 RETURN c.custkey AS c, COUNT(*) AS n GROUP BY c.custkey", "SELECT o_custkey AS c, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size = 7 GROUP BY 1")
star("j4_theta_join", "MATCH (a:Nation), (b:Nation) WHERE a.nationkey < b.nationkey AND a.nationkey + b.nationkey = 20 RETURN a.name AS a, b.name AS b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_nationkey + b.n_nationkey = 20")
star("j5_unwind_match", "UNWIND [1, 2, 3] AS x MATCH (p:Part {size: 10}) WHERE p.partkey > x RETURN x, COUNT(*) AS n GROUP BY x", "SELECT CAST(x AS BIGINT) AS x, count(*) AS n FROM (VALUES (1), (2), (3)) t(x) JOIN part ON p_size = 10 AND p_partkey > x GROUP BY 1")
star("j6_path_length", "MATCH p = (c:Customer)-[:LIVES_IN]->(n)-[:IN_REGION]->(r:Region) RETURN c.custkey AS k, length(p) AS l, size(nodes(p)) AS s", "SELECT c_custkey AS k, CAST(2 AS BIGINT) AS l, CAST(3 AS BIGINT) AS s FROM customer")
star("j6_far_path", "MATCH p = (a:Customer {custkey: 9})-[:NEXT*1..3]->(b:Customer) RETURN b.custkey AS k, length(p) AS l, size(nodes(p)) AS s", f"WITH RECURSIVE {NEXT}, {_reach('SELECT 9, 9, 0', 'nx', 3)} SELECT CAST(v AS BIGINT) AS k, CAST(d AS BIGINT) AS l, CAST(d + 1 AS BIGINT) AS s FROM m WHERE d > 0", graph=event_graph)
star("j7_optional_match", "MATCH (n:Nation) OPTIONAL MATCH (s:Supplier)-[:BASED_IN]->(n) WHERE s.acctbal > 5000 RETURN n.name AS name, s.suppkey AS s", "SELECT n_name AS name, s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000")

# ---- graph API ---------------------------------------------------------------------


@api("g1_neighbour_edges", f"WITH {NEXT} SELECT u, w FROM nx WHERE u = 4 UNION ALL SELECT u, w FROM nx WHERE w = 4", event_graph)
def _(g):
    return GraphApi(g).neighbors(CUSTOMER + 4).edges().select((F.col("src") - CUSTOMER).alias("u"), (F.col("dst") - CUSTOMER).alias("w"))


@api("g2_neighbour_nodes", f"WITH {NEXT} SELECT u AS k FROM nx WHERE w = 4", event_graph)
def _(g):
    return GraphApi(g).neighbors(CUSTOMER + 4).direction("incoming").label("NEXT").nodes().select((F.col("id") - CUSTOMER).alias("k"))


@api("g3_breadth_first", f"WITH RECURSIVE {NEXT}, {_reach('SELECT 8, 8, 0', 'nx', 6)} SELECT CAST(v AS BIGINT) AS k, CAST(d AS INTEGER) AS depth FROM m", event_graph)
def _(g):
    return GraphApi(g).traverse(CUSTOMER + 8).direction("outgoing").max_depth(6).reach().select((F.col("node") - CUSTOMER).alias("k"), "depth")


@api("g4_breadth_first_paths", f"WITH RECURSIVE {NEXT}, {_reach('SELECT 8, 8, 0', 'nx', 3)} SELECT CAST(v AS BIGINT) AS k, CAST(d AS BIGINT) AS n FROM m", event_graph)
def _(g):
    paths = GraphApi(g).traverse(CUSTOMER + 8).direction("outgoing").max_depth(3).paths()
    return g.spark.createDataFrame([(p.end - CUSTOMER, len(p)) for p in paths], "k long, n long")


@api("g5_depth_first", f"WITH RECURSIVE {NEXT}, {_reach('SELECT 8, 8, 0', 'nx', 12)} SELECT CAST(v AS BIGINT) AS k FROM m", event_graph)
def _(g):
    return GraphApi(g).traverse(CUSTOMER + 8).direction("outgoing").depth_first().select((F.col("node") - CUSTOMER).alias("k"))


@api("g7_shortest_path", f"WITH RECURSIVE {NEXT}, {_reach('SELECT 1, 1, 0', 'nx', 8)} SELECT CAST(v AS BIGINT) AS k, CAST(d AS BIGINT) AS hops FROM m WHERE v IN (17, 90)", event_graph)
def _(g):
    found = [(t, GraphApi(g).shortest_path(CUSTOMER + 1, CUSTOMER + t).direction("outgoing").find()) for t in (17, 90)]
    return g.spark.createDataFrame([(t, len(p)) for t, p in found if p], "k long, hops long")


def _cheapest_sql(start: int, rounds: int) -> str:
    """Relaxation, a fixed number of rounds."""
    steps = [NEXT, "ed AS (SELECT u, w, min(cost) AS cost FROM nx WHERE u <> w GROUP BY 1, 2)", f"d0 AS (SELECT CAST({start} AS BIGINT) AS v, CAST(0 AS DOUBLE) AS c)"]
    steps += [f"d{i + 1} AS MATERIALIZED (SELECT v, min(c) AS c FROM (SELECT v, c FROM d{i} UNION ALL SELECT e.w, d.c + e.cost FROM d{i} d JOIN ed e ON d.v = e.u) GROUP BY 1)" for i in range(rounds)]
    return f"WITH {', '.join(steps)} SELECT CAST(v AS BIGINT) AS k, round(c, 2) AS cost FROM d{rounds}"


@api("g8_weighted_paths", _cheapest_sql(2, 24), event_graph)
def _(g):
    return GraphApi(g).weighted_shortest_path(CUSTOMER + 2, CUSTOMER + 2).direction("outgoing").weight_by("cost").all_costs().select((F.col("node") - CUSTOMER).alias("k"), "cost")


@api("g9_subgraph", f"WITH RECURSIVE {NEXT}, {_reach('SELECT 6, 6, 0', 'nx', 1)} SELECT u, w FROM nx WHERE u IN (SELECT v FROM m) AND w IN (SELECT v FROM m)", event_graph)
def _(g):
    _, edges = GraphApi(g).subgraph(CUSTOMER + 6).direction("outgoing").max_depth(1).tables()
    return edges.select((F.col("src") - CUSTOMER).alias("u"), (F.col("dst") - CUSTOMER).alias("w"))


@api("g10_pattern_builder", "SELECT c_custkey AS \"c.custkey\", o_orderkey AS \"o.orderkey\" FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'")
def _(g):
    p = GraphApi(g).pattern().node("c").label("Customer").where_prop("mktsegment", "BUILDING").edge("outgoing").label("PLACED").node("o").label("Orders").where_prop("status", "F")
    return p.project("c", ["custkey"]).project("o", ["orderkey"]).execute()


star("g11_shortest_path_function", "MATCH (a:Customer {custkey: 1}), (b:Customer) RETURN b.custkey AS k, size(shortestPath(a, b)) AS n", f"WITH RECURSIVE {NEXT}, {_reach('SELECT 1, 1, 0', 'nx', 12)} SELECT c_custkey AS k, CAST(d + 1 AS BIGINT) AS n FROM customer LEFT JOIN m ON v = c_custkey", graph=event_graph)
star("g12_shortest_path_pattern", "MATCH (a:Customer {custkey: 1}), (b:Customer) RETURN a.custkey AS a, b.custkey AS k, size(shortestPath((a)-[:NEXT*..2]-(b))) AS n", f"WITH RECURSIVE {BOTH}, {_reach('SELECT 1, 1, 0', 'bo', 2)} SELECT CAST(1 AS BIGINT) AS a, c_custkey AS k, CAST(d + 1 AS BIGINT) AS n FROM customer LEFT JOIN m ON v = c_custkey", graph=event_graph)


@api("g_degrees", f"WITH {NEXT}, k AS (SELECT u AS k FROM nx UNION SELECT w FROM nx) SELECT k, (SELECT count(*) FROM nx WHERE u = k) AS o, (SELECT count(*) FROM nx WHERE w = k) AS i FROM k", event_graph)
def _(g):
    return degree(g, "NEXT").select((F.col("id") - CUSTOMER).alias("k"), F.col("out_degree").alias("o"), F.col("in_degree").alias("i"))


# ---- aggregation, order ------------------------------------------------------------

star("a1_count", "MATCH (n) RETURN COUNT(*) AS a, COUNT(n.brand) AS b, COUNT(n) AS c", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM part) AS b, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS c")
star("a2_sum_avg_min_max", "MATCH (p:Part) RETURN SUM(p.size) AS s, AVG(p.size) AS a, MIN(p.brand) AS lo, MAX(p.retailprice) AS hi", "SELECT CAST(sum(p_size) AS BIGINT) AS s, round(avg(p_size), 2) AS a, min(p_brand) AS lo, round(max(p_retailprice), 2) AS hi FROM part")
star("a5_collect", "MATCH (n:Nation)-[:IN_REGION]->(r) RETURN r.name AS r, size(collect(n.name)) AS n GROUP BY r.name", "SELECT r_name AS r, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
star("a6_empty_aggregate", "MATCH (p:Part) WHERE p.size > 1000 RETURN COUNT(*) AS n, SUM(p.size) AS s, AVG(p.size) AS a", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, avg(p_size) AS a FROM part WHERE p_size > 1000")
star("a7_group_by", "MATCH (o:Orders) RETURN o.status AS status, o.priority AS priority, COUNT(*) AS n, AVG(o.totalprice) AS avg GROUP BY o.status, o.priority ORDER BY COUNT(*) DESC", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(avg(o_totalprice), 2) AS avg FROM orders GROUP BY 1, 2")
star("a8_implicit_grouping", "MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH c, COUNT(o) AS n, SUM(o.totalprice) AS total RETURN c.custkey AS k, n, total", "SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
star("a9_pipeline_sum_of_nothing", "MATCH (p:Part) WHERE p.size > 1000 WITH SUM(p.size) AS s, COUNT(*) AS n RETURN s, n", "SELECT CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS n")
star("a10_nested_aggregates", "MATCH (c:Customer)-[:PLACED]->(o) WITH c.mktsegment AS seg, COUNT(o) * 2 + 1 AS n, size(collect(o.orderkey)) AS m RETURN seg, n, m", "SELECT c_mktsegment AS seg, count(*) * 2 + 1 AS n, count(*) AS m FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
star("a12_aggregate_unwind", "UNWIND [1, 2, 2, NULL] AS x WITH x RETURN x, COUNT(*) AS n", "SELECT CAST(x AS BIGINT) AS x, count(*) AS n FROM (VALUES (1), (2), (2), (NULL)) t(x) GROUP BY 1")
star("a13_count_distinct", "MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN o.status AS s, COUNT(DISTINCT c) AS n GROUP BY o.status", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
star("o1_order_limit", "MATCH (o:Orders) RETURN o.orderkey AS k, o.totalprice AS p ORDER BY o.totalprice DESC, o.orderkey LIMIT 10", "SELECT o_orderkey AS k, round(o_totalprice, 2) AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
star("o1_null_order", "MATCH (n) WHERE n.nationkey < 3 OR n.regionkey < 3 RETURN labels(n)[0] AS l, n.nationkey AS k, n.name AS name ORDER BY n.nationkey DESC, n.name LIMIT 4", "SELECT l, k, name FROM (SELECT 'Region' AS l, CAST(NULL AS INTEGER) AS k, r_name AS name FROM region WHERE r_regionkey < 3 UNION ALL SELECT 'Nation', n_nationkey, n_name FROM nation WHERE n_nationkey < 3) ORDER BY k DESC NULLS FIRST, name LIMIT 4")
star("o2_order_by_aggregate", "MATCH (c:Customer) RETURN c.mktsegment AS seg, COUNT(*) AS n GROUP BY c.mktsegment ORDER BY COUNT(*) DESC, c.mktsegment LIMIT 2", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2")
star("o5_skip", "MATCH (p:Part) WITH p ORDER BY p.retailprice, p.partkey SKIP 5 LIMIT 7 RETURN p.partkey AS k", "SELECT p_partkey AS k FROM part ORDER BY p_retailprice, p_partkey LIMIT 7 OFFSET 5")

# ---- functions and pipelines -------------------------------------------------------

star("x1_functions", "MATCH (n:Nation) RETURN id(n) AS id, labels(n)[0] AS l, size(n.name) AS s, toLower(n.name) AS lo, toUpper(n.name) AS up, coalesce(n.gone, n.nationkey, 3) AS c", f"SELECT {VERTICES['Nation'][0] << 48} + n_nationkey AS id, 'Nation' AS l, CAST(length(n_name) AS BIGINT) AS s, lower(n_name) AS lo, upper(n_name) AS up, CAST(n_nationkey AS BIGINT) AS c FROM nation")
star("x4_properties", "MATCH (r:Region) WITH properties(r) AS p, r RETURN p.name AS name, p.regionkey AS k", "SELECT r_name AS name, r_regionkey AS k FROM region")
star("x6_range_subscript", "UNWIND range(1, 5) AS x WITH x RETURN x, range(1, x)[2] AS a, range(x, 1)[0] AS b, size(range(3, x)) AS n, [x, 9][1] AS c", "SELECT CAST(x AS BIGINT) AS x, CAST(CASE WHEN x >= 3 THEN 3 END AS BIGINT) AS a, CAST(CASE WHEN x = 1 THEN 1 END AS BIGINT) AS b, CAST(greatest(0, x - 2) AS BIGINT) AS n, CAST(9 AS BIGINT) AS c FROM range(1, 6) t(x)")
star("w2_with_distinct", "MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH DISTINCT c, o.status AS s RETURN s, COUNT(*) AS n", "SELECT s, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus AS s FROM orders) GROUP BY 1")
star("w3_having", "MATCH (c:Customer)-[:PLACED]->(o) WITH c, COUNT(o) AS n WHERE n > 12 RETURN c.custkey AS k, n", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
star("w4_top_then_expand", "MATCH (c:Customer) WITH c ORDER BY c.acctbal DESC, c.custkey LIMIT 5 MATCH (c)-[:PLACED]->(o) RETURN c.custkey AS k, COUNT(o) AS n", "SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) GROUP BY 1")
star("w5_collect_unwind", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, collect(n) AS ns UNWIND ns AS n RETURN r.name AS r, n.name AS n, id(n) AS id", f"SELECT r_name AS r, n_name AS n, {VERTICES['Nation'][0] << 48} + n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey")
star("w7_with_star", "MATCH (n:Nation)-[:IN_REGION]->(r) WITH *, n.nationkey * 2 AS d WHERE d > 10 RETURN n.name AS n, r.name AS r, d", "SELECT n_name AS n, r_name AS r, CAST(n_nationkey AS BIGINT) * 2 AS d FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey * 2 > 10")
star("w9_call_yield", "CALL db.vertex_labels() YIELD label RETURN label", "SELECT * FROM (VALUES ('Customer'), ('Nation'), ('Orders'), ('Part'), ('Region'), ('Supplier')) t(label)")
star("w10_edge_types", "CALL db.edge_types() YIELD edge_type AS t RETURN t", "SELECT * FROM (VALUES ('BASED_IN'), ('CONTAINS'), ('IN_REGION'), ('LIVES_IN'), ('PLACED'), ('SUPPLIED_BY')) v(t)")

# ---- writes ------------------------------------------------------------------------


def written(name: str, statements: list[str], text: str, sql: str, params: dict | None = None):
    """Statements against a store, then a query of what they left."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = star_graph(spark, sf_dir)
        store = GraphStore(g)
        with store.batch():
            for one in statements:
                store.execute(one, params)
        return _rounded(store.execute(text).rows)

    QUERIES[name], SQL[name] = run, sql


written("m2_match_create", ["MATCH (n:Nation)-[:IN_REGION]->(r:Region {name: 'ASIA'}) CREATE (t:Team {of: n.name, size: n.nationkey + 1}), (t)-[:PLAYS_FOR {since: 2000}]->(n)"], "MATCH (t:Team)-[p:PLAYS_FOR]->(n:Nation) RETURN t.of AS o, t.size AS s, p.since AS y, n.nationkey AS k", "SELECT n_name AS o, CAST(n_nationkey + 1 AS BIGINT) AS s, CAST(2000 AS BIGINT) AS y, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
written("m3_unwind_create", ["UNWIND [1, 2, 3] AS x CREATE (:Mark {x: x, y: x * x})"], "MATCH (m:Mark) RETURN m.x AS x, m.y AS y", "SELECT CAST(x AS BIGINT) AS x, CAST(x * x AS BIGINT) AS y FROM (VALUES (1), (2), (3)) t(x)")
written("m5_set_where", ["MATCH (s:Supplier) WHERE s.acctbal < 0 SET s.debt = -s.acctbal, s.flag = true"], "MATCH (s:Supplier) RETURN s.suppkey AS k, s.debt AS d, s.flag AS f", "SELECT s_suppkey AS k, round(CASE WHEN s_acctbal < 0 THEN -s_acctbal END, 2) AS d, CASE WHEN s_acctbal < 0 THEN true END AS f FROM supplier")
written("m6_set_map", ["MATCH (r:Region) WHERE r.regionkey > 2 SET r += $map"], "MATCH (r:Region) RETURN r.regionkey AS k, r.name AS name, r.far AS far", "SELECT r_regionkey AS k, CASE WHEN r_regionkey > 2 THEN 'X' ELSE r_name END AS name, CASE WHEN r_regionkey > 2 THEN true END AS far FROM region", {"map": {"name": "X", "far": True}})
written("m7_detach_delete", ["MATCH (n:Nation)-[:IN_REGION]->(r:Region {regionkey: 1}) DETACH DELETE n"], "MATCH (n:Nation)-[e:IN_REGION]->(r) RETURN n.name AS n, r.name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 1")
written("m7_delete_edges", ["MATCH (s:Supplier)-[e:BASED_IN]->(n:Nation) WHERE n.nationkey < 10 DELETE e"], "MATCH (s:Supplier)-[e:BASED_IN]->(n) RETURN s.suppkey AS s, n.nationkey AS n", "SELECT s_suppkey AS s, s_nationkey AS n FROM supplier WHERE s_nationkey >= 10")
written("m9_merge", ["MERGE (r:Region {name: 'ATLANTIS'}) ON CREATE SET r.regionkey = 99 ON MATCH SET r.regionkey = 98", "MERGE (r:Region {name: 'ATLANTIS'}) ON CREATE SET r.regionkey = 97 ON MATCH SET r.seen = 2"], "MATCH (r:Region) RETURN r.name AS name, r.regionkey AS k, r.seen AS seen", "SELECT r_name AS name, CAST(r_regionkey AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seen FROM region UNION ALL SELECT 'ATLANTIS', 99, 2")
written("m12_remove", ["MATCH (s:Supplier) WHERE s.suppkey < 50 REMOVE s.name"], "MATCH (s:Supplier) WHERE s.name IS NULL RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM supplier WHERE s_suppkey < 50")


@api("k1_create_script", "SELECT 'CREATE ({n: ''' || n_name || ''', k: ' || n_nationkey || '});' AS value FROM nation")
def _(g):
    return create_script(query(g, "MATCH (n:Nation) RETURN n.name AS n, n.nationkey AS k, n.none AS x"))


star("f16_scope", "MATCH (c:Customer) WITH c.custkey AS k, c.acctbal AS b WHERE b < 0 WITH k AS x RETURN x ORDER BY x LIMIT 7", "SELECT c_custkey AS x FROM customer WHERE c_acctbal < 0 ORDER BY 1 LIMIT 7")
star("f17_aggregate_placement", "MATCH (c:Customer)-[:PLACED]->(o) RETURN c.mktsegment AS seg, COUNT(*) + 1 AS n, MAX(o.orderkey) - MIN(o.orderkey) AS span GROUP BY c.mktsegment", "SELECT c_mktsegment AS seg, count(*) + 1 AS n, max(o_orderkey) - min(o_orderkey) AS span FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
star("j1b_fixed_beside_variable", "MATCH (a:Customer {custkey: 3})-[:NEXT*1..2]->(b:Customer)-[:NEXT]->(c:Customer) RETURN b.custkey AS b, COUNT(*) AS n GROUP BY b.custkey", f"WITH RECURSIVE {NEXT}, {_reach('SELECT 3, 3, 0', 'nx', 2)} SELECT CAST(v AS BIGINT) AS b, count(*) AS n FROM m JOIN nx ON nx.u = m.v WHERE d BETWEEN 1 AND 2 GROUP BY 1", graph=event_graph)
star("a13_sum_distinct", "MATCH (p:Part) RETURN p.brand AS b, SUM(DISTINCT p.size) AS s, size(collect(DISTINCT p.size)) AS n GROUP BY p.brand", "SELECT p_brand AS b, CAST(sum(DISTINCT p_size) AS BIGINT) AS s, count(DISTINCT p_size) AS n FROM part GROUP BY 1")

FLAGSHIP = "MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE o.totalprice > 100000 RETURN c.mktsegment AS seg, COUNT(*) AS n, SUM(o.totalprice) AS total GROUP BY c.mktsegment"
star("q_flagship", FLAGSHIP, "SELECT c_mktsegment AS seg, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY 1")

QUERIES.update(registry_store.QUERIES)
SQL.update(registry_store.SQL)
