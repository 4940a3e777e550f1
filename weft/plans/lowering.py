"""Statements to DataFrames.

A frame is a DataFrame with flat columns for every bound variable (``v3_id``,
``v3_label``, ``v3_p0`` ...), so Catalyst prunes what a query doesn't use. Patterns become
equi-joins along the edges; a vertex table is joined only if its label, its properties or
an inline constraint need it. Variables shared between patterns join on their ids.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.expressions import LONG, NULL, STRING, Entity, Lowering, PathValue, Scalar, Value, group_of, is_number, literal, nothing
from weft.operators import frontier
from weft.operators.graph import PropertyGraph
from weft.plans import syntax as s
from weft.plans.syntax import QueryError

EVERYTHING = "*"


@dataclass(frozen=True)
class Frame:
    df: DataFrame | None  # None: one row without columns
    scope: dict


class Compiler:
    """Lowers one statement over one graph."""

    def __init__(self, graph: PropertyGraph, params: dict | None = None):
        self.graph, self.params = graph, params or {}
        self.spark = graph.spark
        self.fresh = count()
        self.used: dict[str, set[str]] = {}

    # -- entry

    def run(self, statement: s.Statement) -> DataFrame:
        clauses = [self.bind(c) for c in statement.clauses]
        if not isinstance(clauses[-1], s.Project) or not clauses[-1].last:
            if isinstance(clauses[-1], s.CallProc) and len(clauses) == 1:
                return self._procedure(clauses[0])
            raise QueryError("a query ends with RETURN")
        frame = self.frame(clauses[:-1], clauses)
        return self._return(frame, clauses[-1], piped=any(isinstance(c, (s.Project, s.CallProc)) for c in clauses[:-1]))

    def frame(self, clauses: list, every: list | None = None) -> Frame:
        self.used = _usage(every if every is not None else clauses)
        frame = Frame(None, {})
        for c in clauses:
            if isinstance(c, s.Match):
                frame = self._match(frame, c)
            elif isinstance(c, s.Unwind):
                frame = self._unwind(frame, c)
            elif isinstance(c, s.Project) and not c.last:
                frame = self._with(frame, c)
            elif isinstance(c, s.CallProc):
                df = self._procedure(c)
                frame = Frame(df, {f.name: Scalar(f"`{f.name}`", f.dataType) for f in df.schema.fields})
            else:
                raise QueryError(f"{type(c).__name__} can't stand here")
        return frame

    # -- parameters

    def bind(self, x):
        """The tree with parameters replaced by their values."""
        if isinstance(x, s.Param):
            if x.name not in self.params:
                raise QueryError(f"parameter ${x.name} is missing")
            return s.Lit(_plain(self.params[x.name]))
        if isinstance(x, tuple):
            return tuple(self.bind(i) for i in x)
        if hasattr(x, "__dataclass_fields__"):
            own = {k: self.bind(getattr(x, k)) for k in x.__dataclass_fields__}
            return type(x)(**own)
        return x

    # -- scans

    def _entity(self, kind: str, df: DataFrame, var: str | None) -> tuple[DataFrame, Entity]:
        """The table's columns under names of their own; only properties that the statement uses."""
        p = f"v{next(self.fresh)}_"
        wanted = self.used.get(var, set()) if var else set()
        fixed = ("id", "label", "src", "dst") if kind == "rel" else ("id", "label")
        props, cols = {}, [F.col(c).alias(p + c) for c in fixed]
        for i, f in enumerate(f for f in df.schema.fields if f.name not in fixed):
            if EVERYTHING in wanted or f.name in wanted:
                props[f.name] = (f"{p}p{i}", f.dataType)
                cols.append(F.col(f"`{f.name}`").alias(f"{p}p{i}"))
        entity = Entity(kind, p + "id", p + "label", props, (p + "src", p + "dst") if kind == "rel" else None)
        return df.select(*cols), entity

    def _inline(self, df: DataFrame, props: tuple) -> DataFrame:
        """Inline constraints: equal in type and value; null is no constraint."""
        for key, expr in props:
            if not isinstance(expr, s.Lit):
                raise QueryError("properties in a pattern are literals")
            v = literal(expr.value)
            if isinstance(v.kind, T.NullType):
                continue
            kind = df.schema[key].dataType if key in df.columns else NULL
            whole = lambda k: "whole" if is_number(k) and not isinstance(k, (T.FloatType, T.DoubleType, T.DecimalType)) else group_of(k)
            df = df.filter(F.col(f"`{key}`") == v.col) if whole(kind) == whole(v.kind) else df.filter(F.lit(False))
        return df

    def _scan(self, node: s.NodePat) -> tuple[DataFrame, Entity]:
        df = self.graph.nodes(node.label)
        return self._entity("node", self._inline(df, _known(node)), node.var)

    # -- MATCH

    def _match(self, frame: Frame, m: s.Match) -> Frame:
        if m.optional and frame.df is not None:
            return self._optional(frame, m)
        out = frame
        where = list(_conjuncts(m.where))
        for path in m.paths:
            out = self._join_path(out, path)
            ready = [w for w in where if _names(w) <= out.scope.keys()]
            where = [w for w in where if w not in ready]
            out = self._filter(out, ready)
        out = self._filter(out, where)
        if m.optional:  # nothing stands before it: one row of nulls if there is no match
            one = self.spark.range(1).select(F.lit(1).alias("__one"))
            return Frame(one.join(out.df, F.lit(True), "left").drop("__one"), out.scope)
        return out

    def _optional(self, frame: Frame, m: s.Match) -> Frame:
        row = f"v{next(self.fresh)}_row"
        left = frontier.cut(frame.df.withColumn(row, F.monotonically_increasing_id()))  # row numbers must not be drawn twice
        inner = self._match(Frame(left, frame.scope), replace(m, optional=False))
        added = [c for name, b in inner.scope.items() if name not in frame.scope for c in b.columns()]
        right = inner.df.select(F.col(row).alias("__row"), *[c for c in added])
        return Frame(left.join(right, F.col(row) == F.col("__row"), "left").drop("__row", row), inner.scope)

    def _filter(self, frame: Frame, tests: list[s.Expr]) -> Frame:
        for w in tests:
            if any(isinstance(e, s.Agg) for e in _walk(w)):
                raise QueryError("aggregates can't stand in WHERE")
            frame = self._paths_in(frame, [w])
            frame = Frame(_df(self, frame).filter(self._lowering(frame).predicate(w)), frame.scope)
        return frame

    def _join_path(self, frame: Frame, path: s.Path) -> Frame:
        names = [n.var for n in path.nodes if n.var]
        if not any(r.low is not None for r in path.rels):
            for n in names:
                if names.count(n) > 1:
                    raise QueryError(f"duplicate node variable {n}")
        bound = [i for i, n in enumerate(path.nodes) if n.var and n.var in frame.scope]
        if path.var and path.var in frame.scope:
            raise QueryError(f"variable {path.var} is bound already")
        if bound:
            at = bound[0]
            entity = frame.scope[path.nodes[at].var]
            if not isinstance(entity, Entity) or entity.kind != "node":
                raise QueryError(f"{path.nodes[at].var} is not a node")
            out = self._constrain(frame, entity, path.nodes[at])
        else:
            at = 0
            scanned, entity = self._scan(path.nodes[0])
            df = scanned if frame.df is None else frame.df.crossJoin(scanned)
            out = Frame(df, frame.scope | ({path.nodes[0].var: entity} if path.nodes[0].var else {}))
        steps: dict[int, tuple] = {}
        ids: dict[int, str] = {at: entity.id}
        here = entity
        for i in range(at, len(path.rels)):
            out, here, steps[i] = self._hop(out, here, path.rels[i], path.nodes[i + 1], path.rels[i].direction, path.var is not None)
            ids[i + 1] = here.id
        here = entity
        for i in range(at - 1, -1, -1):
            turned = {"out": "in", "in": "out", "both": "both"}[path.rels[i].direction]
            out, here, step = self._hop(out, here, path.rels[i], path.nodes[i], turned, path.var is not None)
            ids[i] = here.id
            steps[i] = (*step, "turned")
        if path.var:
            out = self._path_value(out, path, ids, steps)
        return out

    def _path_value(self, frame: Frame, path: s.Path, ids: dict, steps: dict) -> Frame:
        nodes, rels = [F.array(ids[0])], []
        for i in range(len(path.rels)):
            kind, a, *rest = steps[i]
            if kind == "one":
                rels.append(F.array(a))
                nodes.append(F.array(ids[i + 1]))
            else:
                inner, own = F.col(a), F.col(rest[0])
                if "turned" in steps[i]:
                    inner, own = F.reverse(inner), F.reverse(own)
                rels.append(own)
                nodes.append(F.slice(inner, 2, F.greatest(F.size(inner) - 1, F.lit(0))))
        p = f"v{next(self.fresh)}_"
        df = frame.df.withColumn(p + "nodes", F.concat(*nodes)).withColumn(p + "rels", F.concat(*rels) if rels else F.array().cast("array<bigint>"))
        return Frame(df, frame.scope | {path.var: PathValue(p + "nodes", p + "rels")})

    def _constrain(self, frame: Frame, entity: Entity, node: s.NodePat) -> Frame:
        """A bound node in a pattern: its label and inline properties must hold."""
        df = frame.df
        if node.label:
            df = df.filter(F.col(entity.label) == node.label)
        for key, expr in _known(node):
            if isinstance(expr, s.Lit) and expr.value is not None:
                df = df.filter(Lowering({"x": entity}).predicate(s.Op("=", (s.Prop("x", key), expr))))
        return Frame(df, frame.scope)

    def _edges(self, rel: s.RelPat, direction: str, near: str | None, far: str | None) -> DataFrame:
        if direction == "both":
            near = far = None
        src, dst = (near, far) if direction == "out" else (far, near)
        return self._inline(self.graph.rels(list(rel.types[:1]), src, dst), rel.props)

    def _hop(self, frame: Frame, here: Entity, rel: s.RelPat, node: s.NodePat, direction: str, path: bool):
        if rel.var and rel.var in frame.scope:
            raise QueryError(f"variable {rel.var} is bound already")
        if rel.low is not None:
            return self._far_hop(frame, here, rel, node, direction, path)
        edges = self._edges(rel, direction, None, node.label)
        table, edge = self._entity("rel", edges, rel.var)
        near, far = edge.ends if direction != "in" else edge.ends[::-1]
        if direction == "both":  # orientation of a step is not that of the edge: columns of their own
            table = table.withColumn("__a", F.col(edge.ends[0])).withColumn("__b", F.col(edge.ends[1])).unionAll(table.withColumn("__a", F.col(edge.ends[1])).withColumn("__b", F.col(edge.ends[0])))
            k = next(self.fresh)
            near, far = f"v{k}_a", f"v{k}_b"
            table = table.withColumnRenamed("__a", near).withColumnRenamed("__b", far)
        scope = frame.scope | ({rel.var: edge} if rel.var else {})
        end = frame.scope.get(node.var) if node.var else None
        if end is not None:
            df = frame.df.join(table, (F.col(here.id) == F.col(near)) & (F.col(end.id) == F.col(far)))
            out = self._constrain(Frame(df, scope), end, node)
            return out, end, ("one", edge.id)
        df = frame.df.join(table, F.col(here.id) == F.col(near))
        out, end = self._arrive(Frame(df, scope), far, node, edges)
        return out, end, ("one", edge.id)

    def _arrive(self, frame: Frame, far: str, node: s.NodePat, edges: DataFrame | None) -> tuple[Frame, Entity]:
        """Join the vertex table at the end of a hop, unless the id is all that is needed."""
        wanted = self.used.get(node.var, set()) if node.var else set()
        if not node.label and not _known(node) and not wanted:
            p = f"v{next(self.fresh)}_"
            end = Entity("node", p + "id", p + "label")
            df = frame.df.withColumn(p + "id", F.col(far)).withColumn(p + "label", F.lit(None).cast("string"))
        else:
            table, end = self._scan(node)
            df = frame.df.join(table, F.col(far) == F.col(end.id))
        return Frame(df, frame.scope | ({node.var: end} if node.var else {})), end

    def _far_hop(self, frame: Frame, here: Entity, rel: s.RelPat, node: s.NodePat, direction: str, path: bool):
        """Reachability: one row per end node, at its shortest depth."""
        edges = self._edges(rel, direction, None, None)
        starts = frame.df.select(F.col(here.id).alias("start")).filter("start is not null")
        reach = frontier.expand(starts, frontier.oriented(edges, direction), rel.low, rel.high, path)
        p = f"v{next(self.fresh)}_"
        reach = reach.select(*[F.col(c).alias(p + c) for c in reach.columns])
        scope = dict(frame.scope)
        end = frame.scope.get(node.var) if node.var else None
        cond = F.col(here.id) == F.col(p + "start")
        if end is not None:
            out = self._constrain(Frame(frame.df.join(reach, cond & (F.col(end.id) == F.col(p + "node"))), scope), end, node)
        else:
            out, end = self._arrive(Frame(frame.df.join(reach, cond), scope), p + "node", node, None)
        if rel.var:  # the last edge; null where the start itself is the end
            table, edge = self._entity("rel", edges, rel.var)
            out = Frame(out.df.join(table, F.col(p + "edge") == F.col(edge.id), "left"), out.scope | {rel.var: edge})
        return out, end, ("far", p + "nodes", p + "rels") if path else ("far", p + "node", p + "edge")

    # -- shortest paths within expressions

    def _paths_in(self, frame: Frame, exprs: list[s.Expr]) -> Frame:
        """Columns for every shortestPath of these expressions."""
        for e in exprs:
            for x in _walk(e):
                if isinstance(x, s.PathSearch) or (isinstance(x, s.Call) and x.name == "shortestpath"):
                    if ("search", x) not in frame.scope:
                        frame = self._search(frame, x)
        return frame

    def _search(self, frame: Frame, x: s.Expr) -> Frame:
        if isinstance(x, s.PathSearch):
            rel, ends = x.path.rels[0], [n.var for n in x.path.nodes]
            steps = frontier.oriented(self.graph.rels(list(rel.types[:1])), rel.direction)
            high = 1 if rel.low is None else rel.high
        else:
            if len(x.args) != 2 or not all(isinstance(a, s.Var) for a in x.args):
                raise QueryError("shortestPath takes two nodes or a pattern")
            ends, steps, high = [a.name for a in x.args], frontier.oriented(self.graph.rels(), "out"), None
        for n in ends:
            if not isinstance(frame.scope.get(n), Entity):
                raise QueryError(f"shortestPath needs bound nodes, {n} is none")
        a, b = (frame.scope[n].id for n in ends)
        found = frontier.shortest(frame.df.select(F.col(a).alias("start"), F.col(b).alias("target")), steps, high)
        p = f"v{next(self.fresh)}_"
        found = found.select(F.col("start").alias(p + "start"), F.col("target").alias(p + "target"), F.col("nodes").alias(p + "nodes"))
        df = frame.df.join(found, (F.col(a) == F.col(p + "start")) & (F.col(b) == F.col(p + "target")), "left").drop(p + "start", p + "target")
        return Frame(df, frame.scope | {("search", x): Scalar(p + "nodes", T.ArrayType(LONG))})

    def _lowering(self, frame: Frame, more: dict | None = None) -> Lowering:
        more = more or {}

        def special(e: s.Expr) -> Value | None:
            if e in more:
                return more[e]
            found = frame.scope.get(("search", e)) if isinstance(e, (s.PathSearch, s.Call)) else None
            return Value(F.col(found.col), found.kind) if found else None

        return Lowering(frame.scope, special)

    # -- UNWIND

    def _unwind(self, frame: Frame, c: s.Unwind) -> Frame:
        if c.var in frame.scope:
            raise QueryError(f"variable {c.var} is bound already")
        if isinstance(c.expr, s.Lit) and isinstance(c.expr.value, tuple) and c.expr.value and all(isinstance(v, dict) for v in c.expr.value):
            return self._unwind_maps(frame, c)
        v = self._lowering(frame).value(c.expr)
        df, p = _df(self, frame), f"v{next(self.fresh)}_x"
        if not isinstance(v.kind, T.ArrayType):
            if isinstance(v.kind, T.NullType) or frame.df is not None:  # no list: no rows
                return Frame(df.withColumn(p, F.lit(None).cast("string")).filter(F.lit(False)), frame.scope | {c.var: Scalar(p, STRING)})
            return Frame(df.withColumn(p, v.col), frame.scope | {c.var: Scalar(p, v.kind)})
        return Frame(df.withColumn(p, F.explode(v.col)), frame.scope | {c.var: Scalar(p, v.kind.elementType)})

    def _unwind_maps(self, frame: Frame, c: s.Unwind) -> Frame:
        rows = [{k: v for k, v in m.items()} for m in c.expr.value]
        keys = list(dict.fromkeys(k for m in rows for k in m))
        kinds = {}
        for k in keys:
            own = [literal(m.get(k)).kind for m in rows if m.get(k) is not None]
            kinds[k] = own[0] if own and all(o == own[0] for o in own) else T.DoubleType() if own and all(is_number(o) for o in own) else STRING
        kind = T.StructType([T.StructField(k, kinds[k]) for k in keys])
        cast = {k: (float if kinds[k] == T.DoubleType() else str if kinds[k] == STRING else lambda x: x) for k in keys}
        p = f"v{next(self.fresh)}_x"
        made = self.spark.createDataFrame([(tuple(None if m.get(k) is None else cast[k](m[k]) for k in keys),) for m in rows], T.StructType([T.StructField(p, kind)]))
        df = made if frame.df is None else frame.df.crossJoin(made)
        return Frame(df, frame.scope | {c.var: Scalar(p, kind)})

    # -- WITH and RETURN

    def _with(self, frame: Frame, c: s.Project) -> Frame:
        items = list(c.items)
        if c.star:
            items = [s.Item(s.Var(n)) for n in frame.scope if isinstance(n, str)] + items
        out, scope, _ = self._projected(frame, items, None, True)
        if c.distinct:
            out = out.dropDuplicates(_identity(scope))
        new = Frame(out, scope)
        if c.where is not None:
            new = self._filter(new, [c.where])
        df = new.df
        if c.order:
            low = self._lowering(new)
            df = df.orderBy(*[_sort_key(low.value(o.expr), o.down) for o in c.order])
        df = df.offset(c.skip) if c.skip else df
        df = df.limit(c.limit) if c.limit is not None else df
        return Frame(df, new.scope)

    def _projected(self, frame: Frame, items: list[s.Item], group: tuple | None, piped: bool, also: tuple = ()):
        """Project or aggregate; frame columns, their scope, and the values of ``also``."""
        seen: set[str] = set()
        for i in items:
            if i.name in seen:
                raise QueryError(f"column {i.name} appears twice")
            seen.add(i.name)
        exprs = [i.expr for i in items] + list(also)
        frame = self._paths_in(frame, exprs + list(group or ()))
        aggregates = list(dict.fromkeys(x for e in exprs for x in _walk(e) if isinstance(x, s.Agg)))
        if aggregates or group is not None:
            frame, low = self._grouped(frame, items, aggregates, group, piped)
        else:
            low = self._lowering(frame)
        scope, cols = {}, []
        for i in items:
            b = frame.scope.get(i.expr.name) if isinstance(i.expr, s.Var) else None
            if b is not None and not callable(b):
                scope[i.name] = b
                cols += [F.col(c) for c in b.columns()]
                continue
            v = low.value(i.expr)
            name = f"v{next(self.fresh)}_x"
            kind = STRING if isinstance(v.kind, T.NullType) else v.kind
            scope[i.name] = Scalar(name, kind)
            cols.append((v.col.cast(kind) if isinstance(v.kind, T.NullType) else v.col).alias(name))
        extra = []
        for e in also:
            v, name = low.value(e), f"v{next(self.fresh)}_s"
            cols.append(v.col.alias(name) if v.entity is None else F.col(v.entity.id).alias(name))
            extra.append((name, v))
        cols = list({c._jc.toString(): c for c in cols}.values())
        return _df(self, frame).select(*cols), scope, extra

    def _grouped(self, frame: Frame, items, aggregates, group, piped):
        plain = [i for i in items if not any(isinstance(x, s.Agg) for x in _walk(i.expr))]
        if group is None:
            if plain and not piped:
                raise QueryError(f"{plain[0].name} is neither an aggregate nor a GROUP BY key")
            keys = [i.expr for i in plain]
        else:
            keys = list(group)
            for i in plain:
                if i.expr not in keys:
                    raise QueryError(f"{i.name} is neither an aggregate nor a GROUP BY key")
        low = self._lowering(frame)
        by, carried, scope, known = [], [], {}, {}
        for k in keys:
            b = frame.scope.get(k.name) if isinstance(k, s.Var) else None
            if isinstance(b, (Entity, PathValue)):
                lead = b.id if isinstance(b, Entity) else b.nodes
                by += [F.col(c) for c in ([lead] if isinstance(b, Entity) else b.columns())]
                if isinstance(b, Entity):
                    carried += [F.first(c).alias(c) for c in b.columns() if c != lead]
                scope[k.name] = b
            else:
                v, name = low.value(k), f"v{next(self.fresh)}_k"
                by.append((v.col.cast("string") if isinstance(v.kind, T.NullType) else v.col).alias(name))
                known[k] = Value(F.col(name), v.kind)
                if isinstance(k, s.Var):
                    scope[k.name] = Scalar(name, v.kind)
        aggs = []
        for a in aggregates:
            name = f"v{next(self.fresh)}_g"
            col, kind = self._aggregate(low, a, piped)
            aggs.append(col.alias(name))
            known[a] = Value(F.col(name), kind)
        seen_cols: dict[str, object] = {c._jc.toString(): c for c in carried}
        rest = [*seen_cols.values(), *aggs]
        df = _df(self, frame).groupBy(*by)
        df = df.agg(*rest) if rest else _df(self, frame).select(*by).dropDuplicates()
        new = Frame(df, scope)
        return new, self._lowering(new, known)

    def _aggregate(self, low: Lowering, a: s.Agg, piped: bool):
        if a.arg is None:
            return F.count(F.lit(1)), LONG
        v = low.value(a.arg)
        col = F.col(v.entity.id) if v.entity and a.func == "count" else v.col
        if a.func == "count":
            return (F.count_distinct(col) if a.distinct else F.count(col)), LONG
        if a.func in ("sum", "avg"):
            if not is_number(v.kind):
                return (F.lit(0 if piped else None).cast("long") if a.func == "avg" or piped else F.sum(F.lit(None).cast("long"))), LONG
            whole = not isinstance(v.kind, (T.FloatType, T.DoubleType, T.DecimalType))
            kind = LONG if whole and a.func == "sum" else T.DoubleType()
            arg = v.col.cast("long" if whole else "double")
            out = (F.sum_distinct(arg) if a.distinct else F.sum(arg)) if a.func == "sum" else F.avg(arg)
            if a.func == "sum" and piped:
                out = F.coalesce(out, F.lit(0).cast(kind))
            return out, kind
        if a.func in ("min", "max"):
            return (F.min if a.func == "min" else F.max)(v.col), v.kind
        if isinstance(v.kind, T.NullType):
            return F.collect_list(F.lit(None).cast("string")), T.ArrayType(STRING)
        return (F.collect_set if a.distinct else F.collect_list)(v.col), T.ArrayType(v.kind)

    def _return(self, frame: Frame, c: s.Project, piped: bool) -> DataFrame:
        items = list(c.items)
        if c.star:
            items = [s.Item(s.Var(n)) for n in frame.scope if isinstance(n, str)] + items
            if not items:
                raise QueryError("nothing to return")
        alias = {i.alias: i.expr for i in items if i.alias}
        order = [s.Sort(_aliased(o.expr, alias, frame.scope), o.down) for o in c.order]
        df, scope, extra = self._projected(frame, items, c.group, piped, tuple(o.expr for o in order))
        out = Lowering(scope)
        final = [self._shown(scope[i.name], out, i.name) for i in items]
        hidden = [F.col(n) for n, _ in extra]
        if c.distinct:
            # equal rows keep the first in the order asked for: the least sort key of each
            ids = _identity(scope)
            keep = [F.first(x).alias(x) for b in scope.values() for x in b.columns() if x not in ids]
            keys = [(F.max(n) if o.down else F.min(n)).alias(n) for (n, _), o in zip(extra, order, strict=True)]
            df = df.groupBy(*ids).agg(*keep, *keys) if keep or keys else df.dropDuplicates(ids)
        shown = df.select(*final, *hidden)
        if order:
            shown = shown.orderBy(*[_sort_key(Value(F.col(n), v.kind), o.down) for (n, v), o in zip(extra, order, strict=True)])
        shown = shown.offset(c.skip) if c.skip else shown
        shown = shown.limit(c.limit) if c.limit is not None else shown
        return shown.drop(*[n for n, _ in extra])

    def _shown(self, b, out: Lowering, name: str):
        v = out._var(name)
        col = v.col
        if isinstance(v.kind, T.BinaryType):
            col = F.lit(None).cast("string")
        return col.alias(name)

    # -- CALL

    def _procedure(self, c: s.CallProc) -> DataFrame:
        last = c.name.rpartition(".")[2]
        if last in ("vertex_labels", "labels"):
            column, rows = "label", self.graph.node_labels()
        elif last in ("edge_types", "relationshiptypes"):
            column, rows = "edge_type", self.graph.edge_types()
        elif last in ("snapshot", "restore"):
            raise QueryError(f"{c.name} isn't a procedure here: save_graph and restore_graph of the sources do that")
        else:
            raise QueryError(f"unknown procedure {c.name}")
        df = self.spark.createDataFrame([(r,) for r in rows], f"{column} string")
        if c.yields:
            if any(k not in (column, "label", "type", "relationshiptype", last[:-1]) for k, _ in c.yields):
                raise QueryError(f"{c.name} has no column {c.yields[0][0]}")
            df = df.select(*[F.col(column).alias(a) for _, a in c.yields])
        return df


# ---- helpers -----------------------------------------------------------------------


def _df(compiler: Compiler, frame: Frame) -> DataFrame:
    return frame.df if frame.df is not None else compiler.spark.range(1).select()


def _known(node: s.NodePat) -> tuple:
    return node.props


def _plain(v):
    return tuple(_plain(i) for i in v) if isinstance(v, (list, tuple)) else v


def _sort_key(v: Value, down: bool):
    col = F.col(v.entity.id) if v.entity else v.col
    return col.desc_nulls_first() if down else col.asc_nulls_last()


def _identity(scope: dict) -> list[str]:
    """Columns that tell rows apart: entities by id."""
    out = []
    for b in scope.values():
        out += [b.id] if isinstance(b, Entity) else b.columns()
    return list(dict.fromkeys(out))


def _aliased(e: s.Expr, alias: dict, scope: dict) -> s.Expr:
    """ORDER BY may name a column of the result."""
    if isinstance(e, s.Var) and e.name in alias and e.name not in scope:
        return alias[e.name]
    if isinstance(e, s.Op):
        return s.Op(e.name, tuple(_aliased(a, alias, scope) for a in e.args))
    if isinstance(e, s.Call):
        return s.Call(e.name, tuple(_aliased(a, alias, scope) for a in e.args))
    return e


def _conjuncts(e: s.Expr | None):
    if isinstance(e, s.Op) and e.name == "AND":
        yield from _conjuncts(e.args[0])
        yield from _conjuncts(e.args[1])
    elif e is not None:
        yield e


def _walk(e):
    if isinstance(e, s.Expr):
        yield from e.walk()


def _names(e: s.Expr, inner: frozenset = frozenset()) -> set[str]:
    """Free variables of an expression."""
    if isinstance(e, s.Var):
        return {e.name} - inner
    if isinstance(e, s.Prop):
        return {e.var} - inner
    if isinstance(e, s.Quant):
        return _names(e.source, inner) | _names(e.test, inner | {e.var})
    if isinstance(e, s.PathSearch):
        return {n.var for n in e.path.nodes if n.var}
    return reduce(set.union, (_names(c, inner) for c in e.children()), set())


def _usage(clauses) -> dict[str, set[str]]:
    """Which properties of each variable a statement reads. A variable that stands for
    itself, other than in id() or count(), needs them all."""
    used: dict[str, set[str]] = {}

    def note(e, bare: bool = True):
        if isinstance(e, s.Prop):
            used.setdefault(e.var, set()).add(e.key)
        elif isinstance(e, s.Var):
            if bare:
                used.setdefault(e.name, set()).add(EVERYTHING)
        elif isinstance(e, s.Call) and e.name in ("id", "shortestpath", "length", "nodes", "relationships"):
            for a in e.args:
                note(a, bare=False)
        elif isinstance(e, s.Call) and e.name in ("labels", "type"):
            for a in e.args:
                note(a, bare=False)
                if isinstance(a, s.Var):
                    used.setdefault(a.name, set()).add("label")
        elif isinstance(e, s.Agg) and e.func == "count" and e.arg is not None:
            note(e.arg, bare=False)
        elif isinstance(e, s.Op) and e.name in ("=", "<>", "ISNULL", "NOTNULL"):
            for a in e.args:
                note(a, bare=not isinstance(a, s.Var))
        elif isinstance(e, s.Expr):
            for c in e.children():
                note(c)

    names: dict[str, str] = {}
    for c in clauses:
        if isinstance(c, s.Match):
            note(c.where) if c.where is not None else None
        elif isinstance(c, s.Unwind):
            note(c.expr)
        elif isinstance(c, s.Project):
            if c.star:
                return _Everything()
            for i in c.items:
                if isinstance(i.expr, s.Var) and not c.last:
                    if i.alias and i.alias != i.expr.name:
                        names[i.alias] = i.expr.name
                else:
                    note(i.expr)
            for e in (c.where, *(c.group or ()), *(o.expr for o in c.order)):
                if e is not None:
                    # keys and sort keys that are a bare variable work by id
                    note(e, bare=False)
        else:
            return _Everything()
    for _ in names:  # a renamed variable reads for the one that it stands for
        for new, old in names.items():
            used.setdefault(old, set()).update(used.get(new, ()))
    return used


class _Everything(dict):
    """Every property of every variable."""

    def get(self, key, default=None):
        return {EVERYTHING}


__all__ = ["Compiler", "Frame", "nothing"]
