"""The graph API: neighbours, traversal, shortest paths, subgraph and pattern builders."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from enum import Enum

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators import depth_first, frontier
from weft.operators.graph import PropertyGraph
from weft.operators.storage import computed, cut, forget, lenient, put, reread
from weft.plans import syntax as s
from weft.plans.lowering import Compiler
from weft.plans.syntax import QueryError

#: Levels that a depth-first search looks ahead for the reachable part; if that goes on, it takes all steps.
AHEAD = 4
UNBOUNDED = 1 << 30


class Direction(Enum):
    OUTGOING = "out"
    INCOMING = "in"
    BOTH = "both"

    @classmethod
    def of(cls, value: Direction | str) -> Direction:
        if isinstance(value, cls):
            return value
        for d in cls:
            if value.lower() in (d.value, d.name.lower()):
                return d
        raise QueryError(f"unknown direction {value!r}: outgoing, incoming or both")


class Strategy(Enum):
    BFS = "bfs"
    DFS = "dfs"

    @classmethod
    def of(cls, value: Strategy | str) -> Strategy:
        if isinstance(value, cls):
            return value
        try:
            return cls(value.lower())
        except ValueError:
            raise QueryError(f"unknown strategy {value!r}: bfs or dfs") from None


@dataclass(frozen=True)
class PathResult:
    nodes: tuple[int, ...]
    edges: tuple[int, ...] = ()

    @property
    def start(self) -> int:
        return self.nodes[0]

    @property
    def end(self) -> int:
        return self.nodes[-1]

    def __len__(self) -> int:
        return len(self.edges)

    @property
    def is_empty(self) -> bool:
        return not self.edges


class _Paths(Sequence):
    """Paths of a depth-first order, each made when it is asked for: together they may take
    the square of the nodes' number."""

    def __init__(self, visits: depth_first.Visits) -> None:
        self._visits = visits

    def __len__(self) -> int:
        return len(self._visits)

    def __getitem__(self, at):
        places = range(len(self))[at]
        return [self[i] for i in places] if isinstance(at, slice) else PathResult(*self._visits.path(places))


@dataclass(frozen=True)
class _Query:
    graph: PropertyGraph
    start: int
    way: Direction = Direction.BOTH
    type: str | None = None

    def direction(self, way: Direction | str):
        return replace(self, way=Direction.of(way))

    def label(self, name: str):
        return replace(self, type=name)

    def _steps(self) -> DataFrame:
        return frontier.oriented(self.graph.rels(self.type), self.way.value)

    def _check(self, *ids: int) -> None:
        for i in ids:
            if not self.graph.node_exists(i):
                raise QueryError(f"no node {i}")

    def _starts(self) -> DataFrame:
        return self.graph.spark.createDataFrame([(self.start,)], "start long")


class Neighbors(_Query):
    def edges(self) -> DataFrame:
        """The incident edges; a loop of both directions is there twice."""
        self._check(self.start)
        rels = self.graph.rels(self.type)
        out, into = rels.filter(F.col("src") == self.start), rels.filter(F.col("dst") == self.start)
        return out if self.way is Direction.OUTGOING else into if self.way is Direction.INCOMING else out.unionAll(into)

    def nodes(self) -> DataFrame:
        """The other ends, duplicates kept."""
        e = self.edges()
        if self.way is Direction.OUTGOING:
            return e.select(F.col("dst").alias("id"))
        if self.way is Direction.INCOMING:
            return e.select(F.col("src").alias("id"))
        return e.select(F.when(F.col("src") == self.start, F.col("dst")).otherwise(F.col("src")).alias("id"))


@dataclass(frozen=True)
class Traversal(_Query):
    depth: int = UNBOUNDED
    strategy_: Strategy = Strategy.BFS

    def max_depth(self, n: int):
        return replace(self, depth=n)

    def strategy(self, value: Strategy | str):
        return replace(self, strategy_=Strategy.of(value))

    def reach(self) -> DataFrame:
        """node and depth of all that is reached (breadth first)."""
        self._check(self.start)
        return frontier.expand(self._starts(), self._steps(), 0, self.depth).select("node", "depth", "edge")

    def nodes(self) -> list[int]:
        """Ids in the order of the visit: by depth and discovery, or depth first."""
        if self.strategy_ is Strategy.DFS:
            return self._depth_first().ids()
        rows = self.reach().collect()
        return [r["node"] for r in sorted(rows, key=lambda r: (r["depth"], r["edge"] or -1, r["node"]))]

    def paths(self) -> Sequence[PathResult]:
        """A path to every node visited, the trivial one first."""
        if self.strategy_ is Strategy.DFS:
            return _Paths(self._depth_first())
        self._check(self.start)
        rows = frontier.expand(self._starts(), self._steps(), 0, self.depth, path=True).collect()
        return [PathResult(tuple(r["nodes"]), tuple(r["rels"])) for r in sorted(rows, key=lambda r: (r["depth"], r["rels"]))]

    def depth_first(self) -> DataFrame:
        """place, node, depth and edge of all that is reached, in pre-order of a depth-first search."""
        return self._depth_first().table(self.graph.spark)

    def _depth_first(self) -> depth_first.Visits:
        """Pre-order; the first edge (least id) is followed first. A node counts as visited
        when it is met, at whatever depth that is."""
        self._check(self.start)
        spark = self.graph.spark
        steps = self._both() if self.way is Direction.BOTH else self._steps().withColumn("way", F.lit(0))
        steps = steps.filter("a is not null and b is not null")
        spent, levels = [], min(self.depth - 1, AHEAD)

        def once(df: DataFrame) -> DataFrame:
            if not computed(df):
                return df
            spent.append(put(df))
            return reread(spark, df.schema, spent[-1:])

        far = levels > frontier.LAZY_LEVELS
        steps = once(steps) if far else steps
        # no node is left at the greatest depth, so the steps of those nearer are all that counts
        near = frontier.expand(self._starts(), steps, 0, max(levels, 0))
        if far:
            spent += sorted({f.rpartition("/")[0] for f in near.inputFiles()})
        if self.depth - 1 <= AHEAD or near.filter(F.col("depth") == AHEAD).isEmpty():
            steps = steps.join(near.select(F.col("node").alias("a")), "a", "left_semi").filter(F.lit(self.depth > 0))
        visits = depth_first.search(self.start, once(steps), self.depth)
        forget(spark, *spent)
        return visits

    def _both(self) -> DataFrame:
        rels = self.graph.rels(self.type)
        return frontier.oriented(rels, "out").withColumn("way", F.lit(0)).unionAll(frontier.oriented(rels, "in").withColumn("way", F.lit(1)))


@dataclass(frozen=True)
class ShortestPath(_Query):
    target: int = 0

    def find(self) -> PathResult | None:
        self._check(self.start, self.target)
        pairs = self.graph.spark.createDataFrame([(self.start, self.target)], "start long, target long")
        rows = frontier.shortest(pairs, self._steps()).collect()
        return PathResult(tuple(rows[0]["nodes"]), tuple(rows[0]["rels"])) if rows else None


Weight = Column | str | Callable[[dict], float] | None


@dataclass(frozen=True)
class WeightedPath(_Query):
    target: int = 0
    weight: Weight = None

    def weight_by(self, weight: Weight):
        """A column expression over the edge's properties (preferred), the name of a
        property, or a Python function of the edge's row; without one, 1 an edge."""
        return replace(self, weight=weight)

    def _weighted(self) -> DataFrame:
        rels = self.graph.rels(self.type)
        w = self.weight
        if callable(w) and not isinstance(w, Column):
            def one(row: dict) -> float:
                try:
                    return float(w(row))
                except Exception:  # noqa: BLE001  the caller's function: an edge that it can't weigh counts 1
                    return 1.0

            @F.pandas_udf("double")
            def weigh(rows: pd.DataFrame) -> pd.Series:
                return pd.Series([one(r) for r in rows.to_dict("records")], dtype="float64")

            col = weigh(F.struct(*[F.col(f"`{c}`") for c in rels.columns]))
        else:
            col = F.lit(1.0) if w is None else F.col(f"`{w}`") if isinstance(w, str) else w
        steps = rels.withColumn("__w", F.coalesce(col.cast("double"), F.lit(1.0)))
        out = steps.select(F.col("id").alias("eid"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("__w").alias("w"))
        back = steps.select(F.col("id").alias("eid"), F.col("dst").alias("a"), F.col("src").alias("b"), F.col("__w").alias("w"))
        both = out if self.way is Direction.OUTGOING else back if self.way is Direction.INCOMING else out.unionAll(back)
        # parallel edges: the cheapest, then the least id
        return both.filter("a <> b").groupBy("a", "b").agg(F.min(F.struct("w", "eid")).alias("m")).select("m.eid", "a", "b", "m.w")

    def _costs(self, target: int | None) -> DataFrame:
        steps = cut(self._weighted())
        if not steps.filter("w < 0 or isnan(w)").isEmpty():
            raise QueryError("weights must not be negative")
        return frontier.cheapest(self._starts(), steps, target, path=target is not None)

    def find(self) -> tuple[float, PathResult] | None:
        self._check(self.start, self.target)
        if self.start == self.target:
            return 0.0, PathResult((self.start,))
        rows = self._costs(self.target).filter(F.col("node") == self.target).collect()
        return (rows[0]["cost"], PathResult(tuple(rows[0]["nodes"]), tuple(rows[0]["rels"]))) if rows else None

    def all_costs(self) -> DataFrame:
        """node and cost of everything reachable."""
        self._check(self.start)
        return self._costs(None).select("node", "cost")


class Subgraph(Traversal):
    def tables(self) -> tuple[DataFrame, DataFrame]:
        """Nodes within the depth, and all edges among them, whatever their direction."""
        inside = cut(self.reach().select(F.col("node").alias("id")))
        nodes = self.graph.nodes().join(inside, "id", "left_semi")
        rels = self.graph.rels(self.type)
        edges = rels.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return nodes, edges  # each edge is a row of one table, so none is there twice


@dataclass(frozen=True)
class Pattern:
    """Steps of a chain: node, edge, node, ...; ``execute`` lowers it as the query language does."""

    graph: PropertyGraph
    nodes: tuple[s.NodePat, ...] = ()
    rels: tuple[s.RelPat, ...] = ()
    kept: dict = field(default_factory=dict)
    last: str = ""

    def node(self, var: str):
        if self.last == "node":
            raise QueryError("an edge stands between two nodes")
        return replace(self, nodes=(*self.nodes, s.NodePat(var, None)), last="node")

    def edge(self, direction: Direction | str = Direction.OUTGOING):
        if self.last != "node":
            raise QueryError("a pattern begins with a node, and nodes and edges alternate")
        return replace(self, rels=(*self.rels, s.RelPat(None, (), Direction.of(direction).value)), last="edge")

    def edge_var(self, var: str):
        return self._edge("edge_var", var=var)

    def label(self, name: str):
        if self.last == "node":
            return replace(self, nodes=(*self.nodes[:-1], replace(self.nodes[-1], label=name)))
        return self._edge("label", types=(name,))

    def where_prop(self, key: str, value):
        if self.last != "node":
            raise QueryError("where_prop follows a node")
        n = self.nodes[-1]
        return replace(self, nodes=(*self.nodes[:-1], replace(n, props=(*n.props, (key, s.Lit(value))))))

    def where_edge_prop(self, key: str, value):
        return self._edge("where_edge_prop", props=(*(self.rels[-1].props if self.rels else ()), (key, s.Lit(value))))

    def _edge(self, what: str, **changes):
        if self.last != "edge":
            raise QueryError(f"{what} follows an edge")
        return replace(self, rels=(*self.rels[:-1], replace(self.rels[-1], **changes)))

    def project(self, var: str, keys: list[str]):
        return replace(self, kept=self.kept | {var: tuple(keys)})

    def execute(self) -> DataFrame:
        """A row per match: a struct for every variable, or the projected properties."""
        if not self.nodes or self.last == "edge":
            raise QueryError("a pattern ends with a node")
        path = s.Path(self.nodes, self.rels)
        names = [n.var for n in self.nodes if n.var] + [r.var for r in self.rels if r.var]
        items = []
        for n in names:
            items += [s.Item(s.Prop(n, k)) for k in self.kept[n]] if n in self.kept else [s.Item(s.Var(n), n)]
        if not items:
            items = [s.Item(s.Agg("count", None))]
        with lenient(self.graph.spark):
            return Compiler(self.graph).run(s.Statement((s.Match((path,)), s.Project(tuple(items), True))))


@dataclass(frozen=True)
class GraphApi:
    graph: PropertyGraph

    def neighbors(self, node: int) -> Neighbors:
        return Neighbors(self.graph, node)

    def traverse(self, node: int) -> Traversal:
        return Traversal(self.graph, node)

    def shortest_path(self, a: int, b: int) -> ShortestPath:
        return ShortestPath(self.graph, a, target=b)

    def weighted_shortest_path(self, a: int, b: int) -> WeightedPath:
        return WeightedPath(self.graph, a, target=b)

    def subgraph(self, node: int) -> Subgraph:
        return Subgraph(self.graph, node)

    def pattern(self) -> Pattern:
        return Pattern(self.graph)


def degree(graph: PropertyGraph, label: str | None = None) -> DataFrame:
    """id, out_degree and in_degree of every node with an edge."""
    e = graph.rels(label)
    ends = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select(F.col("dst"), F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
