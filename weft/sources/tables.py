"""The star-schema tables as a property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.graph import PropertyGraph, element_id

#: label: id ordinal, table, key, and properties by column.
VERTICES = {
    "Region": (0, "region", "r_regionkey", {"regionkey": "r_regionkey", "name": "r_name"}),
    "Nation": (1, "nation", "n_nationkey", {"nationkey": "n_nationkey", "name": "n_name"}),
    "Customer": (2, "customer", "c_custkey", {"custkey": "c_custkey", "name": "c_name", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment"}),
    "Supplier": (3, "supplier", "s_suppkey", {"suppkey": "s_suppkey", "name": "s_name", "acctbal": "s_acctbal"}),
    "Part": (4, "part", "p_partkey", {"partkey": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "retailprice": "p_retailprice"}),
    "Orders": (5, "orders", "o_orderkey", {"orderkey": "o_orderkey", "status": "o_orderstatus", "totalprice": "o_totalprice", "orderdate": "o_orderdate", "priority": "o_orderpriority"}),
}


def vertex_id(label: str, key: Column) -> Column:
    return element_id(VERTICES[label][0], key)


#: Edge types in the order of their ids; the type's ordinal stands above this many bits.
EDGES = ("IN_REGION", "LIVES_IN", "BASED_IN", "PLACED", "CONTAINS", "SUPPLIED_BY", "NEXT")
EDGE_BITS = 59


def edge_id(label: str, key: Column) -> Column:
    """Ids of different types never meet. Keys below 2^59."""
    return F.lit(EDGES.index(label) << EDGE_BITS) + key.cast("long")


def _hash_id(*cols: str | Column) -> Column:
    """Keys of tables without one: a hash, of 59 bits; of 10^9 rows less than one pair meets."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - EDGE_BITS)


_registered: dict[tuple[str, str, str], PropertyGraph] = {}


def _once(build):
    """A graph is registered once a session and folder: its tables' schemas aren't read again."""

    def get(spark: SparkSession, sf_dir: str) -> PropertyGraph:
        key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
        held = _registered.get(key)
        if held is None or held.spark is not spark:
            held = _registered[key] = build(spark, sf_dir)
        return held

    get.__name__, get.__doc__ = build.__name__, build.__doc__
    return get


@_once
def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    g = PropertyGraph(spark)
    for label, (_, name, key, props) in VERTICES.items():
        g = g.with_vertices(label, read(name).select(vertex_id(label, F.col(key)).alias("id"), *[F.col(c).alias(k) for k, c in props.items()]))
    nation, customer, supplier, orders, line = (read(n) for n in ("nation", "customer", "supplier", "orders", "lineitem"))

    def link(label: str, df: DataFrame, key: Column, src: str, a: str, dst: str, b: str, **props: str) -> DataFrame:
        return df.select(edge_id(label, key).alias("id"), vertex_id(src, F.col(a)).alias("src"), vertex_id(dst, F.col(b)).alias("dst"), *[F.col(c).alias(k) for k, c in props.items()])

    g = g.with_edges("IN_REGION", link("IN_REGION", nation, F.col("n_nationkey"), "Nation", "n_nationkey", "Region", "n_regionkey"), "Nation", "Region")
    g = g.with_edges("LIVES_IN", link("LIVES_IN", customer, F.col("c_custkey"), "Customer", "c_custkey", "Nation", "c_nationkey"), "Customer", "Nation")
    g = g.with_edges("BASED_IN", link("BASED_IN", supplier, F.col("s_suppkey"), "Supplier", "s_suppkey", "Nation", "s_nationkey"), "Supplier", "Nation")
    g = g.with_edges("PLACED", link("PLACED", orders, F.col("o_orderkey"), "Customer", "o_custkey", "Orders", "o_orderkey", orderdate="o_orderdate"), "Customer", "Orders")
    contains = link("CONTAINS", line, _hash_id(F.col("_metadata.file_path"), F.col("_metadata.row_index")), "Orders", "l_orderkey", "Part", "l_partkey", linenumber="l_linenumber", quantity="l_quantity", extendedprice="l_extendedprice", discount="l_discount", tax="l_tax", returnflag="l_returnflag", linestatus="l_linestatus", shipdate="l_shipdate")
    g = g.with_edges("CONTAINS", contains, "Orders", "Part")
    by = line.select("l_orderkey", "l_suppkey").dropDuplicates()
    return g.with_edges("SUPPLIED_BY", link("SUPPLIED_BY", by, _hash_id("l_orderkey", "l_suppkey"), "Orders", "l_orderkey", "Supplier", "l_suppkey"), "Orders", "Supplier")


@_once
def event_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers linked by consecutive events: user to next user, cost the sum of values.

    Consecutive means by event_id; the next event is found by joining on the id, so no
    global order is needed.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    a = events.select("event_id", F.col("user_id").alias("u"), "value")
    b = events.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("w"))
    pairs = a.join(b, "event_id").groupBy("u", "w").agg(F.sum(F.abs("value")).alias("cost"))
    edges = pairs.select(edge_id("NEXT", _hash_id("u", "w")).alias("id"), vertex_id("Customer", F.col("u")).alias("src"), vertex_id("Customer", F.col("w")).alias("dst"), F.round("cost", 6).alias("cost"))
    users = customer.select(vertex_id("Customer", F.col("c_custkey")).alias("id"), F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("mktsegment"))
    return PropertyGraph(spark).with_vertices("Customer", users).with_edges("NEXT", edges, "Customer", "Customer")
