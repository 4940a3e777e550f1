"""Syntax tree of the query language, and the text that names unaliased result columns."""

from __future__ import annotations

from dataclasses import dataclass, field


class QueryError(ValueError):
    """A statement that can't be parsed, analysed or executed."""


# ---- expressions -------------------------------------------------------------------


class Expr:
    """Base of all expressions; ``children()`` in source order."""

    def children(self) -> list[Expr]:
        return []

    def walk(self):
        yield self
        for c in self.children():
            yield from c.walk()


@dataclass(frozen=True)
class Lit(Expr):
    value: object


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    var: str
    key: str


@dataclass(frozen=True)
class Op(Expr):
    """Operators, unary ones too: NOT, NEG, ISNULL, NOTNULL, = <> < <= > >= + - * / AND OR
    STARTS ENDS CONTAINS IN."""

    name: str
    args: tuple[Expr, ...]

    def children(self):
        return list(self.args)


@dataclass(frozen=True)
class Call(Expr):
    name: str  # lower case
    args: tuple[Expr, ...]

    def children(self):
        return list(self.args)


@dataclass(frozen=True)
class Agg(Expr):
    func: str  # count sum avg min max collect
    arg: Expr | None
    distinct: bool = False

    def children(self):
        return [self.arg] if self.arg is not None else []


@dataclass(frozen=True)
class Quant(Expr):
    kind: str  # all any none single
    var: str
    source: Expr
    test: Expr

    def children(self):
        return [self.source, self.test]


@dataclass(frozen=True)
class Index(Expr):
    source: Expr
    at: Expr

    def children(self):
        return [self.source, self.at]


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]

    def children(self):
        return list(self.items)


@dataclass(frozen=True)
class PathSearch(Expr):
    """shortestPath over a one-hop pattern."""

    path: Path


# ---- patterns ----------------------------------------------------------------------


@dataclass(frozen=True)
class NodePat:
    var: str | None
    label: str | None
    props: tuple[tuple[str, Expr], ...] = ()
    whole: Param | None = None  # (n:L $map)


@dataclass(frozen=True)
class RelPat:
    var: str | None
    types: tuple[str, ...]
    direction: str  # out in both
    props: tuple[tuple[str, Expr], ...] = ()
    low: int | None = None  # None: exactly one hop, not variable
    high: int | None = None


@dataclass(frozen=True)
class Path:
    nodes: tuple[NodePat, ...]
    rels: tuple[RelPat, ...]
    var: str | None = None


# ---- clauses -----------------------------------------------------------------------


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or text_of(self.expr)


@dataclass(frozen=True)
class Sort:
    expr: Expr
    down: bool


@dataclass(frozen=True)
class Match:
    paths: tuple[Path, ...]
    where: Expr | None = None
    optional: bool = False


@dataclass(frozen=True)
class Unwind:
    expr: Expr
    var: str


@dataclass(frozen=True)
class Project:
    """WITH (``last`` false) and RETURN."""

    items: tuple[Item, ...]
    last: bool
    star: bool = False
    distinct: bool = False
    where: Expr | None = None
    group: tuple[Expr, ...] | None = None
    order: tuple[Sort, ...] = ()
    skip: int | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Create:
    paths: tuple[Path, ...]


@dataclass(frozen=True)
class SetOne:
    var: str
    key: str | None  # None: the whole entity
    value: Expr
    merge: bool = False  # +=


@dataclass(frozen=True)
class SetAll:
    items: tuple[SetOne, ...]


@dataclass(frozen=True)
class Delete:
    vars: tuple[str, ...]
    detach: bool


@dataclass(frozen=True)
class Merge:
    node: NodePat
    on_create: tuple[SetOne, ...] = ()
    on_match: tuple[SetOne, ...] = ()


@dataclass(frozen=True)
class CallProc:
    name: str
    yields: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Ddl:
    kind: str  # create_index drop_index create_unique drop_unique append_only show_index show_constraint show_append_only
    label: str | None = None
    key: str | None = None
    on: bool = True


@dataclass(frozen=True)
class Statement:
    clauses: tuple = field(default_factory=tuple)

    @property
    def writes(self) -> bool:
        return any(isinstance(c, (Create, SetAll, Delete, Merge)) for c in self.clauses)


# ---- names of unaliased columns ----------------------------------------------------

_WORDS = {"STARTS": "STARTS WITH", "ENDS": "ENDS WITH"}


def text_of(e: Expr) -> str:
    match e:
        case Lit(value):
            return literal_text(value)
        case Param(name):
            return f"${name}"
        case Var(name):
            return name
        case Prop(var, key):
            return f"{var}.{key}"
        case Op("NOT", (a,)):
            return f"NOT {text_of(a)}"
        case Op("NEG", (a,)):
            return f"-{text_of(a)}"
        case Op("ISNULL", (a,)):
            return f"{text_of(a)} IS NULL"
        case Op("NOTNULL", (a,)):
            return f"{text_of(a)} IS NOT NULL"
        case Op(name, (a, b)):
            return f"({text_of(a)} {_WORDS.get(name, name)} {text_of(b)})"
        case Call(name, args):
            return f"{name}({', '.join(map(text_of, args))})"
        case Agg(func, arg, distinct):
            return f"{func.upper()}({'DISTINCT ' if distinct else ''}{'*' if arg is None else text_of(arg)})"
        case Quant(kind, var, source, test):
            return f"{kind.upper()}({var} IN {text_of(source)} WHERE {text_of(test)})"
        case Index(source, at):
            return f"{text_of(source)}[{text_of(at)}]"
        case ListOf(items):
            return f"[{', '.join(map(text_of, items))}]"
        case PathSearch():
            return "shortestPath(...)"
    raise QueryError(f"no text for {e!r}")


def literal_text(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return f"'{value}'"
    if isinstance(value, float):
        return str(int(value)) if value == int(value) and abs(value) < 1e16 else repr(value)
    if isinstance(value, (list, tuple)):
        return f"[{', '.join(map(literal_text, value))}]"
    return str(value)
