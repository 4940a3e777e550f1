"""Expressions of the query language as typed Spark columns.

Types are known when a query is lowered, so comparisons of unlike types become literals
(``=`` false, ``<`` null) instead of casts. Equality has two values, the other operators
three; where a predicate stands alone in a filter, equality is emitted plainly, so that
Catalyst sees join keys and pushes it to the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.plans import syntax as s
from weft.plans.syntax import QueryError

#: Elements that range() may have.
MOST_RANGE = 1_000_000


@dataclass(frozen=True)
class Value:
    """A column and its type; entity: the node or relationship that it shows."""

    col: Column
    kind: T.DataType
    entity: Entity | None = None
    literal: bool = False


@dataclass(frozen=True)
class Entity:
    """A bound node (or relationship): flat columns of the frame."""

    kind: str  # node rel
    id: str
    label: str
    props: dict[str, tuple[str, T.DataType]] = field(default_factory=dict)
    ends: tuple[str, str] | None = None  # of a relationship

    def struct(self) -> Column:
        props = F.struct(*[F.col(c).alias(k) for k, (c, _) in self.props.items()]) if self.props else F.struct(F.lit(None).cast("string").alias("none"))
        if self.kind == "node":
            own = F.struct(F.col(self.id).alias("id"), F.array(F.col(self.label)).alias("labels"), props.alias("properties"))
        else:
            own = F.struct(F.col(self.id).alias("id"), F.col(self.label).alias("type"), F.col(self.ends[0]).alias("start"), F.col(self.ends[1]).alias("end"), props.alias("properties"))
        return F.when(F.col(self.id).isNotNull(), own)

    def struct_type(self) -> T.StructType:
        props = T.StructType([T.StructField(k, t) for k, (_, t) in self.props.items()] or [T.StructField("none", T.StringType())])
        if self.kind == "node":
            return T.StructType([T.StructField("id", T.LongType()), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("properties", props)])
        return T.StructType([T.StructField("id", T.LongType()), T.StructField("type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("properties", props)])

    def columns(self) -> list[str]:
        return [self.id, self.label, *(self.ends or ()), *(c for c, _ in self.props.values())]


@dataclass(frozen=True)
class PathValue:
    """A bound path: arrays of node and relationship ids."""

    nodes: str
    rels: str

    def columns(self) -> list[str]:
        return [self.nodes, self.rels]


@dataclass(frozen=True)
class Scalar:
    col: str
    kind: T.DataType

    def columns(self) -> list[str]:
        return [self.col]


NULL = T.NullType()
BOOL, LONG, DOUBLE, STRING = T.BooleanType(), T.LongType(), T.DoubleType(), T.StringType()


def is_whole(t) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_real(t) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType))


def is_number(t) -> bool:
    return is_whole(t) or is_real(t)


def group_of(t: T.DataType) -> str:
    """Types within a group compare with each other."""
    if is_number(t):
        return "number"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return t.typeName()


def literal(value: object) -> Value:
    if value is None:
        return Value(F.lit(None), NULL, literal=True)
    if isinstance(value, bool):
        return Value(F.lit(value), BOOL, literal=True)
    if isinstance(value, int):
        return Value(F.lit(value).cast("long"), LONG, literal=True)
    if isinstance(value, float):
        return Value(F.lit(value).cast("double"), DOUBLE, literal=True)
    if isinstance(value, str):
        return Value(F.lit(value), STRING, literal=True)
    if isinstance(value, (list, tuple)):
        return array_of([literal(v) for v in value])
    if isinstance(value, dict):
        return _map_literal(value)
    raise QueryError(f"a {type(value).__name__} can't be a value")


def _map_literal(value: dict) -> Value:
    own = {k: literal(v) for k, v in value.items()}
    own = {k: (Value(v.col.cast("string"), STRING) if v.kind == NULL else v) for k, v in own.items()}
    return Value(F.struct(*[v.col.alias(k) for k, v in own.items()]), T.StructType([T.StructField(k, v.kind) for k, v in own.items()]))


def array_of(items: list[Value]) -> Value:
    """A list; numbers widen, other mixtures become text."""
    from weft.operators.graph import common_type

    kind: T.DataType = NULL
    for i in items:
        own = LONG if is_whole(i.kind) else DOUBLE if is_real(i.kind) else i.kind
        kind = own if isinstance(kind, T.NullType) else common_type(kind, own)
    if isinstance(kind, T.NullType):
        kind = STRING
    cols = [i.col.cast(kind) if i.kind != kind else i.col for i in items]
    return Value(F.array(*cols) if cols else F.array().cast(T.ArrayType(kind)), T.ArrayType(kind))


def nothing(kind: T.DataType = BOOL) -> Value:
    return Value(F.lit(None).cast(kind), kind)


Special = Callable[[s.Expr], Value | None]


class Lowering:
    """Lowers expressions over the variables of a frame.

    special: answers for expressions that the frame already holds as columns, such as
    aggregates after grouping or shortest paths.
    """

    def __init__(self, scope: dict, special: Special = lambda e: None):
        self.scope, self.special = scope, special

    # -- predicates

    def predicate(self, e: s.Expr) -> Column:
        """A filter's condition: true keeps the row, anything else drops it."""
        if isinstance(e, s.Op) and e.name == "AND":
            return self.predicate(e.args[0]) & self.predicate(e.args[1])
        if isinstance(e, s.Op) and e.name == "=" and self.special(e) is None:
            a, b = (self.value(x) for x in e.args)
            return self._equal(a, b, plain=True).col
        v = self.value(e)
        return v.col if isinstance(v.kind, T.BooleanType) else F.lit(False)

    # -- values

    def value(self, e: s.Expr) -> Value:
        known = self.special(e)
        if known is not None:
            return known
        match e:
            case s.Lit(v):
                return literal(v)
            case s.Param(name):
                raise QueryError(f"parameter ${name} is missing")
            case s.Var(name):
                return self._var(name)
            case s.Prop(var, key):
                return self._prop(var, key)
            case s.Op():
                return self._op(e)
            case s.Call(name, args):
                return self._call(name, args)
            case s.Quant():
                return self._quant(e)
            case s.Index(source, at):
                a, i = self.value(source), self.value(at)
                if not isinstance(a.kind, T.ArrayType) or not is_whole(i.kind):
                    return nothing(a.kind.elementType if isinstance(a.kind, T.ArrayType) else STRING)
                fit = (i.col >= 0) & (i.col < F.size(a.col))
                return Value(F.when(fit, F.get(a.col, i.col.cast("int"))), a.kind.elementType)
            case s.ListOf(items):
                return array_of([self.value(i) for i in items])
            case s.Agg():
                raise QueryError(f"{s.text_of(e)} can't stand here")
        raise QueryError(f"{s.text_of(e)} can't be evaluated here")

    def binding(self, name: str):
        if name not in self.scope:
            raise QueryError(f"variable {name} is not defined")
        return self.scope[name]

    def _var(self, name: str) -> Value:
        b = self.binding(name)
        if isinstance(b, Entity):
            return Value(b.struct(), b.struct_type(), entity=b)
        if isinstance(b, PathValue):
            kind = T.StructType([T.StructField("nodes", T.ArrayType(LONG)), T.StructField("relationships", T.ArrayType(LONG))])
            return Value(F.when(F.col(b.nodes).isNotNull(), F.struct(F.col(b.nodes).alias("nodes"), F.col(b.rels).alias("relationships"))), kind)
        if callable(b):
            return b()
        return Value(F.col(b.col), b.kind)

    def _prop(self, var: str, key: str) -> Value:
        b = self.binding(var)
        if isinstance(b, Entity):
            if key not in b.props:
                return nothing(NULL)
            col, kind = b.props[key]
            return nothing(NULL) if isinstance(kind, T.BinaryType) else Value(F.col(col), kind)
        v = self._var(var)
        if isinstance(v.kind, T.StructType):  # a node from a list, or a map
            inner = v.kind["properties"].dataType if "properties" in v.kind.names and "id" in v.kind.names else v.kind
            at = v.col["properties"] if inner is not v.kind else v.col
            if key in inner.names:
                return Value(at[key], inner[key].dataType)
        return nothing(NULL)

    # -- operators

    def _op(self, e: s.Op) -> Value:
        name = e.name
        if name in ("AND", "OR"):
            a, b = (self._bool(x) for x in e.args)
            return Value(a & b if name == "AND" else a | b, BOOL)
        if name == "NOT":
            return Value(~self._bool(e.args[0]), BOOL)
        if name in ("ISNULL", "NOTNULL"):
            a = self.value(e.args[0])
            col = F.col(a.entity.id) if a.entity else a.col
            return Value(col.isNull() if name == "ISNULL" else col.isNotNull(), BOOL)
        args = [self.value(x) for x in e.args]
        if name == "NEG":
            a = args[0]
            if not is_number(a.kind):
                return nothing(NULL)
            if is_real(a.kind):
                return Value(-a.col, a.kind)
            wide = a.col.cast("long")
            return Value(F.when(wide != F.lit(-(1 << 63)), -wide), LONG)
        a, b = args
        if name in ("+", "-", "*", "/"):
            return self._arithmetic(name, a, b)
        if name == "=":
            return self._equal(a, b)
        if name == "<>":
            return Value(~self._equal(a, b).col, BOOL)
        if name == "IN":
            if not isinstance(b.kind, T.ArrayType):
                return nothing()
            items = e.args[1]
            if isinstance(items, s.Lit):  # a literal list becomes one IN that scans can use
                fit = [literal(v) for v in items.value if v is not None]
                fit = [v for v in fit if group_of(v.kind) == group_of(a.kind)]
                return Value(F.coalesce(a.col.isin(*[v.col for v in fit]), F.lit(False)) if fit else F.lit(False), BOOL)
            parts = [self._equal(a, self.value(i)).col for i in items.items] if isinstance(items, s.ListOf) else []
            if isinstance(items, s.ListOf):
                out = F.lit(False)
                for p in parts:
                    out = out | p
                return Value(out, BOOL)
            return Value(F.coalesce(F.array_contains(F.filter(b.col, lambda x: x.isNotNull()), a.col), F.lit(False)), BOOL)
        if name in ("STARTS", "ENDS", "CONTAINS"):
            if not (isinstance(a.kind, T.StringType) and isinstance(b.kind, T.StringType)):
                return nothing()
            return Value({"STARTS": a.col.startswith, "ENDS": a.col.endswith, "CONTAINS": a.col.contains}[name](b.col), BOOL)
        if group_of(a.kind) != group_of(b.kind) or isinstance(a.kind, (T.NullType, T.StructType)):
            if not ({group_of(a.kind), group_of(b.kind)} == {"time", "string"}):
                return nothing()
        col = {"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[name]
        return Value(_no_nan(col, a, b), BOOL)

    def _bool(self, e: s.Expr) -> Column:
        v = self.value(e)
        return v.col if isinstance(v.kind, T.BooleanType) else F.lit(None).cast("boolean")

    def _equal(self, a: Value, b: Value, plain: bool = False) -> Value:
        if a.entity or b.entity or (isinstance(a.kind, T.StructType) and isinstance(b.kind, T.StructType)):
            x, y = (F.col(v.entity.id) if v.entity else v.col["id"] if isinstance(v.kind, T.StructType) and "id" in v.kind.names else None for v in (a, b))
            if x is None or y is None:
                same = a.kind == b.kind
                return Value(F.coalesce(a.col == b.col, F.lit(False)) if same else F.lit(False), BOOL)
            col = x == y
        elif isinstance(a.kind, T.NullType) or isinstance(b.kind, T.NullType):
            return Value(F.lit(False), BOOL)
        elif group_of(a.kind) != group_of(b.kind) and {group_of(a.kind), group_of(b.kind)} != {"time", "string"}:
            return Value(F.lit(False), BOOL)
        else:
            col = _no_nan(a.col == b.col, a, b, equal=True)
        return Value(col if plain else F.coalesce(col, F.lit(False)), BOOL)

    @staticmethod
    def _arithmetic(name: str, a: Value, b: Value) -> Value:
        if not (is_number(a.kind) and is_number(b.kind)):
            return nothing(NULL)
        if is_whole(a.kind) and is_whole(b.kind):
            x, y = a.col.cast("long"), b.col.cast("long")
            return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.call_function("div", x, y)}[name](), LONG)
        x, y = a.col.cast("double"), b.col.cast("double")
        return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y}[name](), DOUBLE)

    # -- functions

    def _call(self, name: str, args: tuple[s.Expr, ...]) -> Value:
        if name in ("nodes", "relationships", "length") and len(args) == 1 and isinstance(args[0], s.Var) and isinstance(self.scope.get(args[0].name), PathValue):
            p = self.binding(args[0].name)
            if name == "length":
                return Value(F.when(F.col(p.rels).isNotNull(), F.size(p.rels)).cast("long"), LONG)
            return Value(F.col(p.nodes if name == "nodes" else p.rels), T.ArrayType(LONG))
        if name not in FUNCTIONS:
            raise QueryError(f"unknown function {name}")
        low, high, f = FUNCTIONS[name]
        if not low <= len(args) <= high:
            raise QueryError(f"{name} takes {low if low == high else f'{low} or more'} arguments, got {len(args)}")
        return f(*[self.value(a) for a in args])

    def _quant(self, e: s.Quant) -> Value:
        source = self.value(e.source)
        if not isinstance(source.kind, T.ArrayType):
            return nothing()

        def test(x: Column) -> Column:
            inner = Lowering(self.scope | {e.var: lambda: Value(x, source.kind.elementType)}, self.special)
            v = inner.value(e.test)
            return F.coalesce(v.col, F.lit(False)) if isinstance(v.kind, T.BooleanType) else F.lit(False)

        col = {"all": lambda: F.forall(source.col, test), "any": lambda: F.exists(source.col, test), "none": lambda: ~F.exists(source.col, test), "single": lambda: F.size(F.filter(source.col, test)) == 1}[e.kind]()
        return Value(F.when(source.col.isNotNull(), col), BOOL)


def _no_nan(col: Column, a: Value, b: Value, equal: bool = False) -> Column:
    """IEEE: nothing equals, or is less or greater than, NaN."""
    real = [v for v in (a, b) if isinstance(v.kind, (T.FloatType, T.DoubleType)) and not v.literal]
    if equal:  # only NaN equals NaN
        real = real[:1] if len(real) == 2 else []
    for v in real:
        col = col & ~F.isnan(v.col)
    return col


# ---- function registry -------------------------------------------------------------


def _id(v: Value) -> Value:
    if v.entity is not None:
        return Value(F.col(v.entity.id), LONG) if v.entity.kind == "node" else nothing(LONG)
    if isinstance(v.kind, T.StructType) and "labels" in v.kind.names:
        return Value(v.col["id"], LONG)
    return nothing(LONG)


def _type(v: Value) -> Value:
    if v.entity is not None and v.entity.kind == "rel":
        return Value(F.col(v.entity.label), STRING)
    if isinstance(v.kind, T.StructType) and "type" in v.kind.names:
        return Value(v.col["type"], STRING)
    return nothing(STRING)


def _labels(v: Value) -> Value:
    kind = T.ArrayType(STRING)
    if v.entity is not None and v.entity.kind == "node":
        return Value(F.when(F.col(v.entity.id).isNotNull(), F.array(F.col(v.entity.label))), kind)
    if isinstance(v.kind, T.StructType) and "labels" in v.kind.names:
        return Value(v.col["labels"], kind)
    return nothing(kind)


def _properties(v: Value) -> Value:
    if isinstance(v.kind, T.StructType) and "properties" in v.kind.names:
        return Value(v.col["properties"], v.kind["properties"].dataType)
    return nothing(NULL)


def _range(a: Value, b: Value) -> Value:
    kind = T.ArrayType(LONG)
    if not (is_whole(a.kind) and is_whole(b.kind)):
        return nothing(kind)
    x, y = a.col.cast("long"), b.col.cast("long")
    # the bounds of sequence() are clamped, as both branches may be evaluated
    made = F.sequence(x, F.greatest(x, F.least(y, x + F.lit(MOST_RANGE - 1))), F.lit(1).cast("long"))
    return Value(F.when(x > y, F.array().cast(kind)).when(y - x < MOST_RANGE, made), kind)


def _size(v: Value) -> Value:
    if isinstance(v.kind, T.ArrayType):
        return Value(F.when(v.col.isNotNull(), F.size(v.col)).cast("long"), LONG)
    if isinstance(v.kind, T.StringType):
        return Value(F.length(v.col).cast("long"), LONG)
    return nothing(LONG)


def _text(f: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda v: Value(f(v.col), STRING) if isinstance(v.kind, T.StringType) else nothing(STRING)


def _coalesce(*args: Value) -> Value:
    from weft.operators.graph import common_type

    fit = [a for a in args if not isinstance(a.kind, T.NullType)]
    if not fit:
        return nothing(NULL)
    kind = fit[0].kind
    for a in fit[1:]:
        kind = common_type(kind, a.kind)
    return Value(F.coalesce(*[a.col.cast(kind) if a.kind != kind else a.col for a in fit]), kind)


def _of_path(field_name: str) -> Callable[[Value], Value]:
    def f(v: Value) -> Value:
        if isinstance(v.kind, T.StructType) and v.kind.names == ["nodes", "relationships"]:
            if field_name == "length":
                return Value(F.size(v.col["relationships"]).cast("long"), LONG)
            return Value(v.col[field_name], T.ArrayType(LONG))
        return nothing(LONG if field_name == "length" else T.ArrayType(LONG))

    return f


#: name: least and most arguments, and the function.
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Value]]] = {
    "id": (1, 1, _id),
    "type": (1, 1, _type),
    "labels": (1, 1, _labels),
    "properties": (1, 1, _properties),
    "nodes": (1, 1, _of_path("nodes")),
    "relationships": (1, 1, _of_path("relationships")),
    "length": (1, 1, _of_path("length")),
    "range": (2, 2, _range),
    "size": (1, 1, _size),
    "tolower": (1, 1, _text(F.lower)),
    "toupper": (1, 1, _text(F.upper)),
    "coalesce": (1, 1 << 20, _coalesce),
}
