"""A property graph as a registry of DataFrames.

Each label has a vertex table (``id`` and its properties); each edge type has one or
more edge tables (``id``, ``src``, ``dst`` and properties) that state which labels they
connect where that is known. Tables are immutable: a write returns a new graph. Ids are
64-bit; vertex and edge ids are separate spaces. Vertex ids are distinct over all labels, edge
ids over all types: :func:`element_id` gives such ids. Writes tell edges by type and id, so
tables that break the rule lose nothing, but a lookup by id alone refuses an id of two types.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.plans.syntax import QueryError

ID_BITS = 48


def element_id(ordinal: int, key: Column) -> Column:
    """An id that stays the same between runs: the table's ordinal and its business key."""
    return F.lit(ordinal << ID_BITS) + key.cast("long")


@dataclass(frozen=True)
class EdgeTable:
    df: DataFrame
    src_label: str | None = None
    dst_label: str | None = None


@dataclass(frozen=True)
class Catalog:
    """Declarations. An index is a hint only: Parquet statistics serve every property."""

    indexes: tuple[tuple[str, str], ...] = ()
    unique: tuple[tuple[str, str], ...] = ()
    append_only: tuple[str, ...] = ()


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of a property that two tables hold."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(a, whole) and isinstance(b, whole):
        return T.LongType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    return T.StringType()


def union_tables(dfs: list[DataFrame]) -> DataFrame:
    """Rows of all tables; a property that a table lacks is null, one of several types is
    widened (numbers to double, otherwise text)."""
    kinds: dict[str, T.DataType] = {}
    for df in dfs:
        for f in df.schema.fields:
            kinds[f.name] = common_type(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    lined = [df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]) for df in dfs]
    return reduce(DataFrame.unionAll, lined)


@dataclass(frozen=True)
class PropertyGraph:
    spark: SparkSession
    vertices: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, tuple[EdgeTable, ...]] = field(default_factory=dict)
    catalog: Catalog = Catalog()

    # -- building

    def with_vertices(self, label: str, df: DataFrame, key: str = "id") -> PropertyGraph:
        if key != "id":
            df = df.withColumnRenamed(key, "id")
        if "id" not in df.columns:
            raise QueryError(f"vertices of {label} have no id")
        df = df.withColumn("id", F.col("id").cast("long"))
        return replace(self, vertices=self.vertices | {label: df})

    def with_edges(self, label: str, df: DataFrame, src_label: str | None = None, dst_label: str | None = None) -> PropertyGraph:
        if missing := {"id", "src", "dst"} - set(df.columns):
            raise QueryError(f"edges of {label} lack {', '.join(sorted(missing))}")
        df = df.select(*[F.col(c).cast("long") if c in ("id", "src", "dst") else F.col(f"`{c}`") for c in df.columns])
        return replace(self, edges=self.edges | {label: (*self.edges.get(label, ()), EdgeTable(df, src_label, dst_label))})

    # -- scans

    def nodes(self, label: str | None = None) -> DataFrame:
        """id, label and properties of one label, or of all."""
        if label is not None:
            df = self.vertices.get(label)
            return self._no_nodes() if df is None else df.withColumn("label", F.lit(label))
        dfs = [df.withColumn("label", F.lit(name)) for name, df in self.vertices.items()]
        return union_tables(dfs) if dfs else self._no_nodes()

    def nodes_of(self, labels: list[str]) -> DataFrame:
        dfs = [self.vertices[name].withColumn("label", F.lit(name)) for name in labels if name in self.vertices]
        return union_tables(dfs) if dfs else self._no_nodes()

    def rels(self, types: list[str] | str | None = None, src: str | None = None, dst: str | None = None) -> DataFrame:
        """id, src, dst, label and properties; src, dst: labels that leave other tables out."""
        names = list(self.edges) if not types else [types] if isinstance(types, str) else list(types)
        dfs = []
        for name in names:
            for t in self.edges.get(name, ()):
                if (src and t.src_label and t.src_label != src) or (dst and t.dst_label and t.dst_label != dst):
                    continue
                dfs.append(t.df.withColumn("label", F.lit(name)))
        return union_tables(dfs) if dfs else self._no_edges()

    def _no_nodes(self) -> DataFrame:
        return self.spark.createDataFrame([], "id long, label string")

    def _no_edges(self) -> DataFrame:
        return self.spark.createDataFrame([], "id long, src long, dst long, label string")

    def nodes_where(self, label: str, **props) -> DataFrame:
        """Label and property equality; several properties are a conjunction."""
        df = self.nodes(label)
        for k, v in props.items():
            df = df.filter(F.col(f"`{k}`") == F.lit(v)) if k in df.columns else df.filter(F.lit(False))
        return df

    def nodes_in_range(self, label: str, key: str, low, high) -> DataFrame:
        """low <= key < high."""
        return self.nodes(label).filter((F.col(f"`{key}`") >= F.lit(low)) & (F.col(f"`{key}`") < F.lit(high)))

    def node_of_greatest(self, label: str, key: str) -> DataFrame:
        """The node of the greatest value; ties go to the least id."""
        return self.nodes(label).filter(F.col(f"`{key}`").isNotNull()).orderBy(F.desc(f"`{key}`"), F.asc("id")).limit(1)

    def nodes_without(self, label: str, key: str) -> DataFrame:
        df = self.nodes(label)
        return df.filter(F.col(f"`{key}`").isNull()) if key in df.columns else df

    def node(self, node_id: int) -> dict:
        return _only(self.nodes().filter(F.col("id") == node_id), f"no node {node_id}")

    def edge(self, edge_id: int, label: str | None = None) -> dict:
        return _only(self.rels(label).filter(F.col("id") == edge_id), f"no edge {edge_id}")

    def node_projected(self, node_id: int, keys: list[str]) -> dict:
        df = self.nodes().filter(F.col("id") == node_id)
        return _only(df.select("id", "label", *[F.col(f"`{k}`") for k in keys if k in df.columns]), f"no node {node_id}")

    def node_label(self, node_id: int) -> str:
        return _only(self.nodes().filter(F.col("id") == node_id).select("label"), f"no node {node_id}")["label"]

    def node_exists(self, node_id: int) -> bool:
        return not self.nodes().filter(F.col("id") == node_id).isEmpty()

    def outgoing(self, node_id: int, label: str | None = None) -> DataFrame:
        return self.rels(label).filter(F.col("src") == node_id)

    def incoming(self, node_id: int, label: str | None = None) -> DataFrame:
        return self.rels(label).filter(F.col("dst") == node_id)

    def edges_between(self, a: int, b: int, label: str | None = None) -> DataFrame:
        return self.rels(label).filter((F.col("src") == a) & (F.col("dst") == b))

    def has_edge(self, a: int, b: int, label: str | None = None) -> bool:
        return not self.edges_between(a, b, label).isEmpty()

    def edge_endpoints(self, edge_id: int, label: str | None = None) -> tuple[int, int]:
        row = _only(self.rels(label).filter(F.col("id") == edge_id).select("src", "dst"), f"no edge {edge_id}")
        return row["src"], row["dst"]

    def edge_label_hashes(self) -> DataFrame:
        return self.rels().select("id", F.crc32(F.encode("label", "UTF-8")).alias("label_hash"))

    def node_count(self) -> int:
        return sum(df.count() for df in self.vertices.values())

    def edge_count(self) -> int:
        return sum(t.df.count() for ts in self.edges.values() for t in ts)

    def node_labels(self) -> list[str]:
        return sorted(self.vertices)

    def edge_types(self) -> list[str]:
        return sorted(self.edges)


def _only(df: DataFrame, otherwise: str) -> dict:
    rows = df.take(2)
    if not rows:
        raise QueryError(otherwise)
    if len(rows) > 1:
        raise QueryError("the id stands for several elements; name the type")
    return rows[0].asDict(recursive=True)
