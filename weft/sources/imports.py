"""Imports: statement scripts, CSV and JSON files, and stored graphs."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.graph import Catalog, EdgeTable, PropertyGraph, union_tables
from weft.operators.store import Counters, GraphStore
from weft.plans.syntax import QueryError


def import_script(store: GraphStore, path: str) -> Counters:
    """Run the statements of a script file, split at semicolons outside of quotes."""
    text = "\n".join(r[0] for r in store.spark.read.text(path, wholetext=True).collect())
    return store.script(text)


def _sniffed(df: DataFrame, names: list[str]) -> DataFrame:
    """Text columns as long or double where every value is one; blanks are absent. One pass
    over the file decides all columns."""
    blank = {c: F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`")) for c in names}
    if not names:
        return df
    tests = []
    for i, c in enumerate(names):
        v = blank[c]
        tests += [F.bool_and(v.isNull() | v.rlike(r"^[+-]?\d{1,18}$")).alias(f"l{i}"), F.bool_and(v.isNull() | v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")).alias(f"d{i}"), F.count(v).alias(f"n{i}")]
    seen = df.agg(*tests).first()
    out = df
    for i, c in enumerate(names):
        kind = "string" if not seen[f"n{i}"] else "long" if seen[f"l{i}"] else "double" if seen[f"d{i}"] else "string"
        out = out.withColumn(c, blank[c].try_cast(kind) if kind != "string" else blank[c])
    return out


def import_csv_nodes(store: GraphStore, path: str) -> Counters:
    """A header row; the first column is the label, the others are properties."""
    df = store.spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    first, *props = df.columns
    total = Counters()
    with store.batch():
        for (label,) in df.select(F.trim(F.col(f"`{first}`"))).dropDuplicates().collect():  # a row per label
            if not label:
                continue
            own = _sniffed(df.filter(F.trim(F.col(f"`{first}`")) == label).select(*[F.col(f"`{c}`") for c in props]), props)
            before = store._first_id("v")
            store.add_nodes(label, own)
            total.nodes_created += store._first_id("v") - before
    return total


def import_csv_edges(store: GraphStore, path: str, key: str) -> Counters:
    """Columns src, dst, label, then properties; ends are found by the node property ``key``."""
    df = store.spark.read.csv(path, header=True, inferSchema=False)
    src, dst, label, *props = df.columns
    nodes = store.graph.nodes().select("id", F.col(f"`{key}`").cast("string").alias("k"))
    a, b = nodes.toDF("__src", "__a"), nodes.toDF("__dst", "__b")
    found = df.join(a, F.col(f"`{src}`") == F.col("__a")).join(b, F.col(f"`{dst}`") == F.col("__b"))
    return _add_edges(store, found.select(F.col("__src").alias("src"), F.col("__dst").alias("dst"), F.col(f"`{label}`").alias("__label"), *[F.col(f"`{c}`") for c in props]), props)


def _add_edges(store: GraphStore, found: DataFrame, props: list[str]) -> Counters:
    total = Counters()
    with store.batch():
        for (label,) in found.select("__label").dropDuplicates().collect():
            own = found.filter(F.col("__label") == label).drop("__label")
            before = store._first_id("e")
            store.add_edges(label, _sniffed(own, [c for c in props if isinstance(own.schema[c].dataType, T.StringType)]))
            total.edges_created += store._first_id("e") - before
    return total


def _flat(df: DataFrame, column: str) -> list:
    """A struct's fields as columns; what is nested becomes its JSON text."""
    kind = df.schema[column].dataType
    out = []
    for f in kind.fields if isinstance(kind, T.StructType) else ():
        col = F.col(f"`{column}`")[f.name]
        out.append((F.to_json(col) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else col).alias(f.name))
    return out


def import_json(store: GraphStore, path: str) -> Counters:
    """{"nodes": [{label, properties}], "edges": [{source, target, label, properties}]};
    source and target are {label, match: {key: value}} with one key."""
    doc = store.spark.read.json(path, multiLine=True)
    total = Counters()
    with store.batch():
        if "nodes" in doc.columns:
            nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
            for (label,) in nodes.select("label").dropDuplicates().collect():
                own = nodes.filter(F.col("label") == label)
                cols = _flat(own, "properties") if "properties" in own.columns else []
                before = store._first_id("v")
                store.add_nodes(label, _without_empty(own.select(*cols)))
                total.nodes_created += store._first_id("v") - before
    if "edges" not in doc.columns:
        return total
    edges = doc.select(F.explode("edges").alias("e")).select("e.*")
    ends = {}
    for side in ("source", "target"):
        kind = edges.schema[side].dataType["match"].dataType
        if not isinstance(kind, T.StructType):
            raise QueryError(f"{side} has no match")
        ends[side] = kind.names
    found = edges
    for side, name in (("source", "src"), ("target", "dst")):
        tables = []
        for key in ends[side]:
            for label, df in store.graph.vertices.items():
                if key in df.columns:
                    tables.append(df.select(F.col("id").alias(name), F.lit(label).alias("__l"), F.lit(key).alias("__k"), F.col(f"`{key}`").cast("string").alias("__v")))
        if not tables:
            raise QueryError(f"no node has {', '.join(ends[side])}")
        value = F.coalesce(*[F.col(side)["match"][k].cast("string") for k in ends[side]])
        key = F.coalesce(*[F.when(F.col(side)["match"][k].isNotNull(), F.lit(k)) for k in ends[side]])
        found = found.withColumn("__want", F.struct(F.col(side)["label"].alias("l"), key.alias("k"), value.alias("v")))
        known = union_tables(tables)
        found = found.join(known, (F.col("__want.l") == F.col("__l")) & (F.col("__want.k") == F.col("__k")) & (F.col("__want.v") == F.col("__v"))).drop("__want", "__l", "__k", "__v")
    cols = _flat(found, "properties") if "properties" in found.columns else []
    made = found.select("src", "dst", F.col("label").alias("__label"), *cols)
    total.add(_add_edges(store, made, [c for c in made.columns if c not in ("src", "dst", "__label")]))
    return total


def _without_empty(df: DataFrame) -> DataFrame:
    """Properties that no row of the label has are left out."""
    if not df.columns:
        return df
    seen = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if seen[f"c{i}"]])


# ---- stored graphs -----------------------------------------------------------------


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_graph(graph: PropertyGraph, path: str, version: int | None = None) -> int:
    """Write a version to a folder of its own, then point to it: readers see the old version
    or the new one, never a part. Edge tables are laid out by source for later hops."""
    spark = graph.spark
    if version is None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        version = _pointer(spark, path) + 1 if there else 0
    at = f"{path}/v{version}"
    layout: dict = {"vertices": {}, "edges": {}, "catalog": {"indexes": graph.catalog.indexes, "unique": graph.catalog.unique, "append_only": graph.catalog.append_only}}
    for i, (label, df) in enumerate(graph.vertices.items()):
        df.write.mode("overwrite").parquet(f"{at}/vertices/{i}")
        layout["vertices"][label] = i
    k = 0
    for label, tables in graph.edges.items():
        for t in tables:
            t.df.write.mode("overwrite").parquet(f"{at}/edges/{k}")
            layout["edges"].setdefault(label, []).append([k, t.src_label, t.dst_label])
            k += 1
    _write_text(spark, f"{at}/layout", json.dumps(layout))
    _write_text(spark, f"{path}/current", str(version))
    return version


def _pointer(spark: SparkSession, path: str) -> int:
    return int(spark.read.text(f"{path}/current").first()[0])


def load_graph(spark: SparkSession, path: str, version: int | None = None) -> PropertyGraph:
    at = f"{path}/v{_pointer(spark, path) if version is None else version}"
    layout = json.loads(spark.read.text(f"{at}/layout", wholetext=True).first()[0])
    own = layout["catalog"]
    return PropertyGraph(
        spark,
        {label: spark.read.parquet(f"{at}/vertices/{i}") for label, i in layout["vertices"].items()},
        {label: tuple(EdgeTable(spark.read.parquet(f"{at}/edges/{k}"), a, b) for k, a, b in tables) for label, tables in layout["edges"].items()},
        Catalog(tuple(map(tuple, own["indexes"])), tuple(map(tuple, own["unique"])), tuple(own["append_only"])),
    )


def restore_graph(spark: SparkSession, path: str, version: int) -> PropertyGraph:
    """Point back to an earlier version."""
    graph = load_graph(spark, path, version)
    _write_text(spark, f"{path}/current", str(version))
    return graph


def from_tables(spark: SparkSession, vertices: dict[str, str], edges: dict[str, str], format: str = "parquet") -> PropertyGraph:
    """A graph from files of any format that Spark reads; edge files hold id, src and dst."""
    g = PropertyGraph(spark)
    for label, path in vertices.items():
        g = g.with_vertices(label, spark.read.format(format).load(path))
    for label, path in edges.items():
        g = g.with_edges(label, spark.read.format(format).load(path))
    return g


def with_catalog(graph: PropertyGraph, catalog: Catalog) -> PropertyGraph:
    return replace(graph, catalog=catalog)
