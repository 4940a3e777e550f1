"""Writes: a mutable handle on immutable graph versions.

A statement with MATCH binds first, on the version it began with, and then applies its
changes as one new version (unions, joins and anti joins). Versions of changed tables are
written to the shared folder, so plans don't grow with the number of writes; in a batch
they are written once at its end. A statement, batch or script that ends in an error
leaves the version that it began with. One thread at a time writes through a store; readers hold a
version (``snapshot``) and aren't touched. WHERE counts in writes, SET evaluates with bindings, and
SET or REMOVE to null takes a property away. Ids of created elements continue from the
greatest id, in an order that the statement's rows fix.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.expressions import Entity, Lowering, literal
from weft.operators.graph import Catalog, EdgeTable, PropertyGraph, common_type, union_tables
from weft.operators.storage import cut, lenient
from weft.plans import syntax as s
from weft.plans.lowering import Compiler, Frame, _df
from weft.plans.parser import parse, split_script
from weft.plans.syntax import QueryError


@dataclass
class Counters:
    nodes_created: int = 0
    edges_created: int = 0
    nodes_deleted: int = 0
    edges_deleted: int = 0
    properties_set: int = 0
    labels_added: int = 0

    @property
    def elements_changed(self) -> int:
        return self.nodes_created + self.edges_created + self.nodes_deleted + self.edges_deleted

    def add(self, other: Counters) -> None:
        for k in self.__dataclass_fields__:
            setattr(self, k, getattr(self, k) + getattr(other, k))


@dataclass
class Result:
    rows: DataFrame | None = None
    counters: Counters = field(default_factory=Counters)


class GraphStore:
    """The current version, statements against it, batches and transactions."""

    def __init__(self, graph: PropertyGraph | SparkSession):
        self.graph = graph if isinstance(graph, PropertyGraph) else PropertyGraph(graph)
        self.spark = self.graph.spark
        self.version = 0
        self._saved: PropertyGraph | None = None
        self._batch = False
        self._dirty: set[tuple[str, str]] = set()
        self._next: dict[str, int] = {}

    # -- statements

    def execute(self, text: str, params: dict | None = None) -> Result:
        statement = parse(text)
        with lenient(self.spark):
            if isinstance(statement, s.Ddl):
                if self._saved is not None:
                    raise QueryError("declarations can't stand in a transaction")
                return self._declare(statement)
            if not statement.writes:
                return Result(Compiler(self.graph, params).run(statement))
            before = self.graph, set(self._dirty), dict(self._next)
            try:
                return self._write(statement, params or {})
            except Exception:  # a statement counts as a whole or not at all
                self.graph, self._dirty, self._next = before
                raise

    def script(self, text: str) -> Counters:
        """All statements of a script in one batch: all of them count, or none."""
        total = Counters()
        with self.batch():
            for one in split_script(text):
                total.add(self.execute(one).counters)
        return total

    # -- batches and transactions

    def batch(self):
        store = self

        class _Batch:
            def __enter__(self):
                self.before = store.graph, set(store._dirty), dict(store._next)
                store._batch = True
                return store

            def __exit__(self, kind, *_):
                store._batch = False
                if kind is None:
                    store._settle()
                else:
                    store.graph, store._dirty, store._next = self.before

        return _Batch()

    def begin(self) -> None:
        if self._saved is not None:
            raise QueryError("a transaction is open already")
        self._saved = self.graph

    def commit(self) -> None:
        if self._saved is None:
            raise QueryError("no transaction is open")
        self._saved = None

    def rollback(self) -> None:
        if self._saved is None:
            raise QueryError("no transaction is open")
        self.graph, self._saved = self._saved, None
        self._next.clear()
        self._dirty.clear()

    def snapshot(self) -> PropertyGraph:
        """The current version; later writes don't touch it."""
        return self.graph

    def vacuum(self) -> None:
        """Rewrite every table once, so that the version stands on its own files."""
        self._dirty = {("v", k) for k in self.graph.vertices} | {("e", k) for k in self.graph.edges}
        self._settle()

    def _settle(self) -> None:
        g = self.graph
        vertices = {k: cut(df) if ("v", k) in self._dirty else df for k, df in g.vertices.items()}
        edges = {k: tuple(replace(t, df=cut(t.df)) for t in ts) if ("e", k) in self._dirty else ts for k, ts in g.edges.items()}
        self._dirty.clear()
        self.graph = replace(g, vertices=vertices, edges=edges)
        self.version += 1

    def _changed(self, graph: PropertyGraph, *tables: tuple[str, str]) -> None:
        self.graph = graph
        self._dirty.update(tables)
        if not self._batch:
            self._settle()

    # -- ids

    def _first_id(self, kind: str) -> int:
        if kind not in self._next:
            dfs = list(self.graph.vertices.values()) if kind == "v" else [t.df for ts in self.graph.edges.values() for t in ts]
            tops = [df.agg(F.max("id")).first()[0] for df in dfs]
            self._next[kind] = max([t for t in tops if t is not None], default=-1) + 1
        return self._next[kind]

    def _numbered(self, df: DataFrame, kind: str) -> tuple[DataFrame, int]:
        """Adds ``id``: dense numbers after the greatest, from counts per partition and a
        row number within each, so no task sees all rows."""
        df = cut(df.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
        counts = sorted((r["__part"], r["count"]) for r in df.groupBy("__part").count().collect())
        at, first, rows = self._first_id(kind), {}, 0
        for part, n in counts:
            first[part] = at + rows
            rows += n
        self._next[kind] = at + rows
        if not rows:
            return df.withColumn("id", F.lit(0).cast("long")).drop("__part", "__row"), 0
        offsets = self.spark.createDataFrame(sorted(first.items()), "__part int, __first long")
        place = F.row_number().over(Window.partitionBy("__part").orderBy("__row")) - 1
        return df.withColumn("__place", place).join(offsets, "__part").withColumn("id", F.col("__first") + F.col("__place")).drop("__part", "__row", "__place", "__first"), rows

    # -- writing statements

    def _write(self, statement: s.Statement, params: dict) -> Result:
        compiler = Compiler(self.graph, params)
        clauses = list(statement.clauses)
        last = None
        if isinstance(clauses[-1], s.Project) and clauses[-1].last:
            last = compiler.bind(clauses.pop())
        cut_at = next(i for i, c in enumerate(clauses) if isinstance(c, (s.Create, s.SetAll, s.Delete, s.Merge)))
        reads, writes = [compiler.bind(c) for c in clauses[:cut_at]], clauses[cut_at:]
        if not all(isinstance(c, (s.Create, s.SetAll, s.Delete, s.Merge)) for c in writes):
            raise QueryError("reading clauses come before writing ones")
        for c in writes:
            for x in _whole_params(c):
                if x.name in params and not isinstance(params[x.name], dict):
                    raise QueryError(f"${x.name} must be a map")
        writes = [self._bind_write(compiler, c, params) for c in writes]
        if last is not None and not all(isinstance(i.expr, (s.Var, s.Prop, s.Call)) for i in last.items):
            raise QueryError("RETURN after a write shows variables and their properties")
        result = Result()
        frame = compiler.frame(reads, [*reads, *writes]) if reads else Frame(None, {})
        if reads:
            frame = Frame(cut(_df(compiler, frame)), frame.scope)
        for c in writes:
            if isinstance(c, s.Create):
                frame = self._create(compiler, frame, c, result.counters)
            elif isinstance(c, s.SetAll):
                self._set(compiler, frame, c.items, result.counters)
                frame = self._refreshed(compiler, frame)
            elif isinstance(c, s.Delete):
                self._delete(frame, c, result.counters)
            else:
                if reads:
                    raise QueryError("MERGE stands alone")
                frame = self._merge(compiler, c, result.counters)
        if last is not None:
            result.rows = Compiler(self.graph, params)._return(frame, last, False)
        return result

    def _bind_write(self, compiler: Compiler, c, params: dict):
        if isinstance(c, s.Create):
            paths = []
            for p in c.paths:
                nodes = []
                for n in p.nodes:
                    if n.whole is not None:
                        value = params.get(n.whole.name)
                        if not isinstance(value, dict):
                            raise QueryError(f"parameter ${n.whole.name} must be a map")
                        n = replace(n, whole=None, props=tuple((k, s.Lit(v)) for k, v in value.items()))
                    nodes.append(n)
                paths.append(replace(p, nodes=tuple(nodes)))
            c = s.Create(tuple(paths))
        return compiler.bind(c)

    def _row_values(self, compiler: Compiler, frame: Frame, props) -> dict:
        low = compiler._lowering(frame)
        found = {}
        for k, e in props:
            v = low.value(e)
            if isinstance(v.kind, T.NullType) or isinstance(v.kind, (T.StructType, T.ArrayType, T.MapType)):
                continue  # null and what isn't a scalar can't be stored
            found[k] = v
        return found

    def _create(self, compiler: Compiler, frame: Frame, c: s.Create, counters: Counters) -> Frame:
        df, scope = _df(compiler, frame), dict(frame.scope)
        for path in c.paths:
            ends = []
            for n in path.nodes:
                if n.var and n.var in scope:
                    if n.label or n.props:
                        raise QueryError(f"{n.var} is bound already")
                    ends.append(scope[n.var])
                    continue
                if not n.label:
                    raise QueryError("a created node needs a label")
                values = self._row_values(compiler, Frame(df, scope), n.props)
                df, rows = self._numbered(df, "v")
                p = f"v{next(compiler.fresh)}_"
                df = cut(df.withColumn(p + "label", F.lit(n.label)).withColumnRenamed("id", p + "id").withColumns({f"{p}p{i}": v.col for i, (k, v) in enumerate(values.items())}))
                entity = Entity("node", p + "id", p + "label", {k: (f"{p}p{i}", v.kind) for i, (k, v) in enumerate(values.items())})
                new = df.select(F.col(entity.id).alias("id"), *[F.col(col).alias(k) for k, (col, _) in entity.props.items()])
                if n.label not in self.graph.vertices:
                    counters.labels_added += 1
                self._insert_nodes(n.label, new)
                counters.nodes_created += rows
                counters.properties_set += rows * len(values)
                if n.var:
                    scope[n.var] = entity
                ends.append(entity)
            for r, a, b in zip(path.rels, ends, ends[1:], strict=False):
                if len(r.types) != 1 or r.low is not None:
                    raise QueryError("a created relationship has one type and one hop")
                if r.direction == "both":
                    raise QueryError("a created relationship has a direction")
                if r.direction == "in":
                    a, b = b, a
                values = self._row_values(compiler, Frame(df, scope), r.props)
                df, rows = self._numbered(df, "e")
                p = f"v{next(compiler.fresh)}_"
                df = cut(df.withColumn(p + "label", F.lit(r.types[0])).withColumnRenamed("id", p + "id").withColumns({p + "src": F.col(a.id), p + "dst": F.col(b.id)} | {f"{p}p{i}": v.col for i, (k, v) in enumerate(values.items())}))
                entity = Entity("rel", p + "id", p + "label", {k: (f"{p}p{i}", v.kind) for i, (k, v) in enumerate(values.items())}, (p + "src", p + "dst"))
                new = df.select(F.col(entity.id).alias("id"), F.col(p + "src").alias("src"), F.col(p + "dst").alias("dst"), *[F.col(col).alias(k) for k, (col, _) in entity.props.items()])
                self._insert_edges(r.types[0], new)
                counters.edges_created += rows
                counters.properties_set += rows * len(values)
                if r.var:
                    scope[r.var] = entity
        return Frame(df, scope)

    def _insert_nodes(self, label: str, new: DataFrame) -> None:
        self._check_unique(label, new)
        if label in self.graph.catalog.append_only and self._saved is not None:
            raise QueryError(f"label {label} is append only; no writes in a transaction")
        old = self.graph.vertices.get(label)
        self._changed(replace(self.graph, vertices=self.graph.vertices | {label: new if old is None else union_tables([old, new])}), ("v", label))

    def _insert_edges(self, label: str, new: DataFrame) -> None:
        tables = self.graph.edges.get(label, ())
        merged = EdgeTable(union_tables([*(t.df for t in tables), new]))  # ends of any label from now on
        self._changed(replace(self.graph, edges=self.graph.edges | {label: (merged,)}), ("e", label))

    def _check_unique(self, label: str, new: DataFrame, old: DataFrame | None = None) -> None:
        old = self.graph.vertices.get(label) if old is None else old
        for own, key in self.graph.catalog.unique:
            if own != label or key not in new.columns:
                continue
            fresh = new.filter(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("k"))
            twice = not fresh.groupBy("k").count().filter("count > 1").isEmpty()
            if not twice and old is not None and key in old.columns:
                kept = old.join(new.select("id"), "id", "left_anti").select(F.col(f"`{key}`").alias("k"))
                twice = not fresh.join(kept, "k", "left_semi").isEmpty()
            if twice:
                raise QueryError(f"{label}.{key} is unique; the value is there already")

    def _set(self, compiler: Compiler, frame: Frame, items, counters: Counters) -> None:
        changes: dict[str, dict] = {}
        for one in items:
            entity = frame.scope.get(one.var)
            if not isinstance(entity, Entity):
                raise QueryError(f"{one.var} is not a node or relationship")
            own = changes.setdefault(one.var, {})
            if one.key is not None:
                own[one.key] = compiler._lowering(frame).value(one.value)
                continue
            if not isinstance(one.value, s.Lit) or not isinstance(one.value.value, dict):
                raise QueryError("an entity is set from a map parameter")
            if not one.merge:
                for k in entity.props:
                    own[k] = literal(None)
                own["*"] = True
            own.update({k: literal(v) for k, v in one.value.value.items()})
        for var, own in changes.items():
            self._apply(frame, frame.scope[var], own, counters)

    def _apply(self, frame: Frame, entity: Entity, own: dict, counters: Counters) -> None:
        whole = own.pop("*", False)
        names = list(own)
        cols = [(own[k].col.cast("string") if isinstance(own[k].kind, T.NullType) else own[k].col).alias(f"__n{i}") for i, k in enumerate(names)]
        # several rows may bind one element: the last value of an order that the rows fix wins
        found = frame.df.select(F.col(entity.id).alias("id"), F.col(entity.label).alias("__of"), *cols).filter("id is not null")
        found = cut(found.groupBy("id", "__of").agg(F.max(F.struct(*[f"__n{i}" for i in range(len(names))])).alias("__new")) if names else found.dropDuplicates())
        rows = found.count()
        counters.properties_set += rows * len([k for k in names if not isinstance(own[k].kind, T.NullType)])

        def changed(df: DataFrame, label: str) -> DataFrame:
            joined = df.join(found.filter(F.col("__of") == label).drop("__of").withColumn("__hit", F.lit(True)), "id", "left")
            out = []
            for c in df.columns:
                if c in names:
                    i, v = names.index(c), own[c]
                    kind = df.schema[c].dataType if isinstance(v.kind, T.NullType) else common_type(df.schema[c].dataType, v.kind)
                    out.append(F.when(F.col("__hit"), F.col(f"__new.__n{i}").cast(kind)).otherwise(F.col(f"`{c}`").cast(kind)).alias(c))
                elif whole and c not in ("id", "src", "dst"):
                    out.append(F.when(F.col("__hit").isNull(), F.col(f"`{c}`")).alias(c))
                else:
                    out.append(F.col(f"`{c}`"))
            for i, k in enumerate(names):
                if k not in df.columns and not isinstance(own[k].kind, T.NullType):
                    out.append(F.when(F.col("__hit"), F.col(f"__new.__n{i}")).alias(k))
            return joined.select(*out)

        labels = [r[0] for r in frame.df.select(entity.label).dropDuplicates().collect() if r[0] is not None]
        if entity.kind == "node":
            for label in labels:
                if label in self.graph.catalog.append_only:
                    raise QueryError(f"label {label} is append only")
                new = changed(self.graph.vertices[label], label)
                self._check_unique(label, new.join(found, "id", "left_semi"))
                self._changed(replace(self.graph, vertices=self.graph.vertices | {label: new}), ("v", label))
        else:
            for label in labels:
                tables = tuple(replace(t, df=changed(t.df, label)) for t in self.graph.edges[label])
                self._changed(replace(self.graph, edges=self.graph.edges | {label: tables}), ("e", label))

    def _refreshed(self, compiler: Compiler, frame: Frame) -> Frame:
        """The frame's entities with the properties they have now."""
        df, scope = frame.df, dict(frame.scope)
        for name, e in frame.scope.items():
            if not isinstance(e, Entity):
                continue
            labels = [r[0] for r in frame.df.select(e.label).dropDuplicates().collect() if r[0] is not None]
            table = self.graph.nodes_of(labels) if e.kind == "node" else self.graph.rels(labels) if labels else self.graph.rels().limit(0)
            p = f"v{next(compiler.fresh)}_"
            fixed = ("id", "label", "src", "dst")
            props = [f for f in table.schema.fields if f.name not in fixed]
            now = table.select(F.col("id").alias(p + "id"), F.col("label").alias(p + "of"), *[F.col(f"`{f.name}`").alias(f"{p}p{i}") for i, f in enumerate(props)])
            df = df.join(now, (F.col(e.id) == F.col(p + "id")) & (F.col(e.label) == F.col(p + "of")), "left").drop(p + "id", p + "of")
            scope[name] = replace(e, props={f.name: (f"{p}p{i}", f.dataType) for i, f in enumerate(props)})
        return Frame(cut(df), scope)

    def _delete(self, frame: Frame, c: s.Delete, counters: Counters) -> None:
        nodes, rels = [], []
        for name in c.vars:
            e = frame.scope.get(name)
            if not isinstance(e, Entity):
                raise QueryError(f"{name} is not a node or relationship")
            (nodes if e.kind == "node" else rels).append(frame.df.select(F.col(e.id).alias("id"), F.col(e.label).alias("label")).filter("id is not null"))
        gone_rels, gone_nodes = cut(_all(self.spark, rels)), cut(_all(self.spark, nodes))
        # what is bound names the labels; tables of others aren't read
        rel_labels, node_labels = ({r[0] for r in df.select("label").dropDuplicates().collect()} for df in (gone_rels, gone_nodes))
        for label in self.graph.catalog.append_only:
            if label in node_labels:
                raise QueryError(f"label {label} is append only")
        g, edges, vertices = self.graph, dict(self.graph.edges), dict(self.graph.vertices)
        ids = gone_nodes.select("id")
        for label, tables in g.edges.items():
            kept = []
            for t in tables:
                df = t.df
                if label in rel_labels:
                    df, n = _without(df, gone_rels.filter(F.col("label") == label).select("id"), ["id"])
                    counters.edges_deleted += n
                sides = [side for side, of in (("src", t.src_label), ("dst", t.dst_label)) if node_labels and (of is None or of in node_labels)]
                if sides:
                    df, n = _without(df, ids, sides)
                    if n and not c.detach:
                        raise QueryError("the node has relationships; DETACH DELETE removes them with it")
                    counters.edges_deleted += n
                kept.append(replace(t, df=df))
            edges[label] = tuple(kept)
        for label in node_labels:
            vertices[label], n = _without(vertices[label], ids, ["id"])
            counters.nodes_deleted += n
        self.graph = replace(g, vertices=vertices, edges=edges)
        self.version += 1

    def _merge(self, compiler: Compiler, c: s.Merge, counters: Counters) -> Frame:
        known = tuple((k, e) for k, e in c.node.props if not (isinstance(e, s.Lit) and e.value is None))
        node = replace(c.node, var=c.node.var or "__merged", props=())
        where = None
        for k, e in known:
            one = s.Op("=", (s.Prop(node.var, k), e))
            where = one if where is None else s.Op("AND", (where, one))
        find = s.Match((s.Path((node,), ()),), where)
        everything = s.Project((s.Item(s.Var(node.var)),), True)
        found = compiler.frame([find], [find, everything])
        entity = found.scope[node.var]
        first = Frame(cut(found.df.orderBy(entity.id).limit(1)), found.scope)  # the least id among the matches
        if first.df.isEmpty():
            frame = self._create(compiler, Frame(None, {}), s.Create((s.Path((replace(node, props=known),), ()),)), counters)
            sets = c.on_create
        else:
            frame, sets = first, c.on_match
        if sets:
            self._set(compiler, frame, sets, counters)
            frame = self._refreshed(compiler, frame)
        return frame

    # -- element API

    def add_nodes(self, label: str, df: DataFrame) -> None:
        """Bulk insert of rows with properties; ids are given."""
        new, _ = self._numbered(df, "v")
        self._insert_nodes(label, new)

    def add_edges(self, label: str, df: DataFrame) -> None:
        """Bulk insert of rows with src, dst and properties; both ends must exist."""
        ids = self.graph.nodes().select("id")
        ends = df.select(F.col("src").alias("id")).unionAll(df.select(F.col("dst").alias("id"))).dropDuplicates()
        if not ends.join(ids, "id", "left_anti").isEmpty():
            raise QueryError("an edge's end doesn't exist")
        new, _ = self._numbered(df, "e")
        self._insert_edges(label, new)

    def add_node(self, label: str, **props) -> int:
        at = self._first_id("v")
        self.execute(f"CREATE (n:`{label}` $map)", {"map": props})
        return at

    def add_edge(self, label: str, src: int, dst: int, **props) -> int:
        at = self._first_id("e")
        row = self.spark.createDataFrame([(src, dst)], "src long, dst long").withColumns({k: literal(v).col for k, v in props.items()})
        self.add_edges(label, row)
        return at

    def update_node(self, node_id: int, props: dict, label: str | None = None) -> None:
        own = self.graph.node_label(node_id)
        if own in self.graph.catalog.append_only:
            raise QueryError(f"label {own} is append only")
        if label is None or label == own:
            self.execute(f"MATCH (n:`{own}`) WHERE id(n) = $id SET n = $map", {"id": node_id, "map": props})
            return
        old = self.graph.vertices[own]
        row = self.spark.createDataFrame([(node_id,)], "id long").withColumns({k: literal(v).col for k, v in props.items()})
        self._changed(replace(self.graph, vertices=self.graph.vertices | {own: old.filter(F.col("id") != node_id)}), ("v", own))
        self._insert_nodes(label, row)

    def remove_node(self, node_id: int) -> None:
        self.graph.node(node_id)
        self.execute("MATCH (n) WHERE id(n) = $id DETACH DELETE n", {"id": node_id})

    def remove_edge(self, edge_id: int, label: str | None = None) -> None:
        label = self.graph.edge(edge_id, label)["label"]
        g = self.graph
        tables = tuple(replace(t, df=t.df.filter(F.col("id") != edge_id)) for t in g.edges[label])
        self._changed(replace(g, edges=g.edges | {label: tables}), ("e", label))

    # -- declarations

    def _declare(self, d: s.Ddl) -> Result:
        c = self.graph.catalog
        pair = (d.label, d.key)
        if d.kind == "create_index":
            c = replace(c, indexes=tuple(sorted({*c.indexes, pair})))
        elif d.kind == "drop_index":
            c = replace(c, indexes=tuple(i for i in c.indexes if i != pair))
        elif d.kind == "create_unique":
            c = replace(c, unique=tuple(sorted({*c.unique, pair})))
        elif d.kind == "drop_unique":
            c = replace(c, unique=tuple(u for u in c.unique if u != pair))
        elif d.kind == "append_only":
            c = replace(c, append_only=tuple(sorted({*c.append_only, d.label} if d.on else {*c.append_only} - {d.label})))
        elif d.kind == "show_index":
            return Result(self.spark.createDataFrame([("label+property", *i, 0) for i in c.indexes], "`index type` string, label string, property string, count long"))
        elif d.kind == "show_constraint":
            return Result(self.spark.createDataFrame([("unique", *u) for u in c.unique], "`constraint type` string, label string, properties string"))
        else:
            return Result(self.spark.createDataFrame([(a,) for a in c.append_only], "label string"))
        self.graph = replace(self.graph, catalog=c)
        return Result()


def _whole_params(c):
    if isinstance(c, s.Create):
        for p in c.paths:
            for n in p.nodes:
                if n.whole is not None:
                    yield n.whole


def _all(spark: SparkSession, dfs: list[DataFrame]) -> DataFrame:
    out = spark.createDataFrame([], "id long, label string")
    for df in dfs:
        out = out.unionAll(df)
    return out.dropDuplicates()


def _without(df: DataFrame, gone: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """The rows none of whose keys is gone, written, and how many the others are; a table that
    loses none stays as it is. One count of matches decides."""
    marks = df
    for i, k in enumerate(keys):
        marks = marks.join(gone.select(F.col("id").alias(k), F.lit(True).alias(f"__gone{i}")), k, "left")
    hit = F.coalesce(*[F.col(f"__gone{i}") for i in range(len(keys))])
    n = marks.filter(hit).count()
    return (cut(marks.filter(hit.isNull()).select(*df.columns)), n) if n else (df, 0)


__all__ = ["Catalog", "Counters", "GraphStore", "Lowering", "Result"]
