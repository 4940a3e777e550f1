"""Text to syntax tree: one regular expression for the tokens, precedence climbing for
expressions, one function per clause."""

from __future__ import annotations

import re
from functools import lru_cache

from weft.plans import syntax as s
from weft.plans.syntax import QueryError

#: Nesting that a statement's expressions may reach.
DEPTH = 128
#: Hops of a variable-length pattern without an upper bound.
MOST_HOPS = 100

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
    |(?P<int>\d+)
    |(?P<str>'(?:[^'\\]|\\.)*')
    |(?P<quoted>"(?:[^"\\]|\\.)*"|`[^`]+`)
    |(?P<param>\$[A-Za-z_0-9]+)
    |(?P<name>[A-Za-z_][A-Za-z_0-9]*)
    |(?P<sym><>|!=|<=|>=|\+=|\.\.|[-+*/=<>()\[\]{},.:;|])""",
    re.X | re.S,
)
#: Words that can't be variables or labels without quotes.
RESERVED = frozenset("MATCH RETURN WHERE ORDER BY LIMIT AND OR NOT IS NULL ASC DESC AS DISTINCT CREATE SET DELETE DETACH MERGE UNWIND GROUP WITH SKIP TRUE FALSE".split())
_AGGREGATES = frozenset("count sum avg min max collect".split())
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
#: Binary operators by how tightly they bind.
_BINDING = {"OR": 1, "AND": 2, "+": 5, "-": 5, "*": 6, "/": 6}
_COMPARE = {"=": "=", "<>": "<>", "!=": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


def _unescape(body: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.S)


class _Tokens:
    def __init__(self, text: str):
        self.items: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"{_place(text, at)}: unexpected {text[at]!r}")
            if m.lastgroup != "skip":
                self.items.append((m.lastgroup, m[0], at))
            at = m.end()
        self.items.append(("end", "", at))
        self.text, self.i, self.depth = text, 0, 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        kind, text, _ = self.items[min(self.i + ahead, len(self.items) - 1)]
        return kind, text

    def word(self, *words: str, ahead: int = 0) -> bool:
        """Whether these keywords come next."""
        return all(self.peek(ahead + k)[0] == "name" and self.peek(ahead + k)[1].upper() == w for k, w in enumerate(words))

    def sym(self, text: str, ahead: int = 0) -> bool:
        return self.peek(ahead) == ("sym", text)

    def take(self, *words: str) -> bool:
        if self.word(*words):
            self.i += len(words)
            return True
        return False

    def take_sym(self, text: str) -> bool:
        if self.sym(text):
            self.i += 1
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            self.fail(f"expected {' '.join(words)}")

    def need_sym(self, text: str) -> None:
        if not self.take_sym(text):
            self.fail(f"expected {text!r}")

    def fail(self, message: str):
        kind, text, at = self.items[self.i]
        raise QueryError(f"{_place(self.text, at)}: {message}, found {text or 'the end'!r}")

    def name(self, what: str = "a name") -> str:
        kind, text = self.peek()
        if kind == "quoted":
            self.i += 1
            return _unescape(text[1:-1]) if text[0] == '"' else text[1:-1]
        if kind != "name" or text.upper() in RESERVED:
            self.fail(f"expected {what}")
        self.i += 1
        return text

    def key(self) -> str:
        """Property keys may be any word."""
        kind, text = self.peek()
        if kind == "name":
            self.i += 1
            return text
        return self.name("a property name")

    def natural(self) -> int:
        kind, text = self.peek()
        if kind != "int":
            self.fail("expected a whole number")
        self.i += 1
        return int(text)


def _place(text: str, at: int) -> str:
    return f"line {text.count(chr(10), 0, at) + 1}, column {at - text.rfind(chr(10), 0, at)}"


# ---- expressions -------------------------------------------------------------------


def _expr(t: _Tokens, least: int = 1) -> s.Expr:
    t.depth += 1
    if t.depth > DEPTH:
        t.fail("nested too deeply")
    if least <= 3 and t.take("NOT"):
        left: s.Expr = s.Op("NOT", (_expr(t, 3),))
    elif least <= 4:
        left = _comparison(t)
    else:
        left = _unary(t)
    while True:
        kind, text = t.peek()
        op = text.upper() if kind == "name" else text if kind == "sym" else ""
        bind = _BINDING.get(op, 0)
        if not bind or bind < least or (bind > 4 and least <= 4):
            break
        t.i += 1
        left = s.Op(op, (left, _expr(t, bind + 1)))
    t.depth -= 1
    return left


def _sum(t: _Tokens) -> s.Expr:
    return _expr(t, 5)


def _comparison(t: _Tokens) -> s.Expr:
    left = _sum(t)
    if t.take("IS"):
        negated = t.take("NOT")
        t.need("NULL")
        return s.Op("NOTNULL" if negated else "ISNULL", (left,))
    for words, name in ((("STARTS", "WITH"), "STARTS"), (("ENDS", "WITH"), "ENDS"), (("CONTAINS",), "CONTAINS")):
        if t.take(*words):
            return s.Op(name, (left, _sum(t)))
    if t.take("IN"):
        if t.peek()[0] != "param" and not t.sym("["):
            t.fail("IN needs a list in brackets")
        return s.Op("IN", (left, _postfix(t)))
    kind, text = t.peek()
    if kind == "sym" and text in _COMPARE:
        t.i += 1
        return s.Op(_COMPARE[text], (left, _sum(t)))
    return left


def _unary(t: _Tokens) -> s.Expr:
    if t.take_sym("-"):
        kind, text = t.peek()
        if kind == "int":
            t.i += 1
            return _subscripts(t, _integer(t, -int(text)))
        if kind == "float":
            t.i += 1
            return s.Lit(-float(text))
        t.depth += 1
        if t.depth > DEPTH:
            t.fail("nested too deeply")
        inner = _unary(t)
        t.depth -= 1
        return s.Op("NEG", (inner,))
    return _postfix(t)


def _integer(t: _Tokens, value: int) -> s.Lit:
    if not -(1 << 63) <= value < 1 << 63:
        t.fail("the number doesn't fit 64 bits")
    return s.Lit(value)


def _postfix(t: _Tokens) -> s.Expr:
    return _subscripts(t, _atom(t))


def _subscripts(t: _Tokens, e: s.Expr) -> s.Expr:
    while t.take_sym("["):
        at = _expr(t)
        t.need_sym("]")
        e = s.Index(e, at)
    return e


def _atom(t: _Tokens) -> s.Expr:
    kind, text = t.peek()
    upper = text.upper()
    if kind == "int":
        t.i += 1
        return _integer(t, int(text))
    if kind == "float":
        t.i += 1
        return s.Lit(float(text))
    if kind == "str":
        t.i += 1
        return s.Lit(_unescape(text[1:-1]))
    if kind == "param":
        t.i += 1
        return s.Param(text[1:])
    if t.take_sym("("):
        inner = _expr(t)
        t.need_sym(")")
        return inner
    if t.take_sym("["):
        items = []
        while not t.take_sym("]"):
            if items:
                t.need_sym(",")
            items.append(_expr(t))
        if all(isinstance(i, s.Lit) for i in items):
            return s.Lit(tuple(i.value for i in items))
        return s.ListOf(tuple(items))
    if kind == "name" and upper in ("TRUE", "FALSE", "NULL"):
        t.i += 1
        return s.Lit({"TRUE": True, "FALSE": False, "NULL": None}[upper])
    if kind == "name" and t.sym("(", 1):
        if text.lower() in _AGGREGATES:
            return _aggregate(t)
        if upper in ("ALL", "ANY", "NONE", "SINGLE") and t.word("IN", ahead=3):
            return _quantifier(t)
        if text.lower() == "shortestpath" and t.sym("(", 2):
            t.i += 2
            path = _path(t)
            t.need_sym(")")
            if len(path.rels) != 1:
                t.fail("shortestPath takes a pattern of one hop")
            return s.PathSearch(path)
        if upper in RESERVED:
            t.fail("expected an expression")
        t.i += 2
        args = []
        while not t.take_sym(")"):
            if args:
                t.need_sym(",")
            args.append(_expr(t))
        return s.Call(text.lower(), tuple(args))
    name = t.name("an expression")
    if t.sym(".") and t.peek(1)[0] in ("name", "quoted"):
        t.i += 1
        return s.Prop(name, t.key())
    return s.Var(name)


def _aggregate(t: _Tokens) -> s.Agg:
    func = t.peek()[1].lower()
    t.i += 2
    if func == "count" and t.take_sym("*"):
        t.need_sym(")")
        return s.Agg("count", None)
    distinct = t.take("DISTINCT")
    arg = _expr(t)
    t.need_sym(")")
    if any(isinstance(e, s.Agg) for e in arg.walk()):
        t.fail("aggregates can't be nested")
    return s.Agg(func, arg, distinct)


def _quantifier(t: _Tokens) -> s.Quant:
    kind = t.peek()[1].lower()
    t.i += 2
    var = t.name("a variable")
    t.need("IN")
    source = _sum(t)
    t.need("WHERE")
    test = _expr(t)
    t.need_sym(")")
    return s.Quant(kind, var, source, test)


# ---- patterns ----------------------------------------------------------------------


def _path(t: _Tokens) -> s.Path:
    var = None
    if t.peek()[0] in ("name", "quoted") and t.sym("=", 1):
        var = t.name()
        t.need_sym("=")
    nodes, rels = [_node(t)], []
    while t.sym("-") or (t.sym("<") and t.sym("-", 1)):
        rels.append(_rel(t))
        nodes.append(_node(t))
    return s.Path(tuple(nodes), tuple(rels), var)


def _props(t: _Tokens) -> tuple[tuple[str, s.Expr], ...]:
    out: dict[str, s.Expr] = {}
    t.need_sym("{")
    while not t.take_sym("}"):
        if out:
            t.need_sym(",")
        key = t.key()
        t.need_sym(":")
        out[key] = _expr(t)
    return tuple(out.items())


def _node(t: _Tokens) -> s.NodePat:
    t.need_sym("(")
    var = t.name() if t.peek()[0] in ("name", "quoted") else None
    label = t.name("a label") if t.take_sym(":") else None
    if t.sym(":"):
        t.fail("a node has one label")
    props, whole = (), None
    if t.sym("{"):
        props = _props(t)
    elif t.peek()[0] == "param":
        whole = s.Param(t.peek()[1][1:])
        t.i += 1
    t.need_sym(")")
    return s.NodePat(var, label, props, whole)


def _rel(t: _Tokens) -> s.RelPat:
    back = t.take_sym("<")
    t.need_sym("-")
    t.need_sym("[")
    var = t.name() if t.peek()[0] in ("name", "quoted") else None
    types = []
    while t.take_sym(":") or (types and t.take_sym("|")):
        t.take_sym(":")
        types.append(t.name("a relationship type"))
    low = high = None
    if t.take_sym("*"):
        low, high = 0, MOST_HOPS
        if t.peek()[0] == "int":
            low = high = t.natural()
            if t.take_sym(".."):
                high = t.natural() if t.peek()[0] == "int" else MOST_HOPS
        elif t.take_sym(".."):
            high = t.natural() if t.peek()[0] == "int" else MOST_HOPS
        if low > high:
            t.fail("the least number of hops is above the most")
    props = _props(t) if t.sym("{") else ()
    t.need_sym("]")
    t.need_sym("-")
    ahead = t.take_sym(">")
    return s.RelPat(var, tuple(types), "both" if back == ahead else "in" if back else "out", props, low, high)


def _paths(t: _Tokens) -> tuple[s.Path, ...]:
    out = [_path(t)]
    while t.take_sym(","):
        out.append(_path(t))
    return tuple(out)


# ---- clauses -----------------------------------------------------------------------


def _project(t: _Tokens, last: bool) -> s.Project:
    distinct, star, items = t.take("DISTINCT"), False, []
    if t.take_sym("*"):
        star = True
        t.take_sym(",")
    while not star or t.peek()[0] not in ("end",) and not _clause_next(t):
        expr = _expr(t)
        alias = t.name("an alias") if t.take("AS") else None
        if not last and alias is None and not isinstance(expr, s.Var):
            t.fail("an expression in WITH needs an alias")
        items.append(s.Item(expr, alias))
        if not t.take_sym(","):
            break
    where = group = skip = limit = None
    order: list[s.Sort] = []
    if not last and t.take("WHERE"):
        where = _expr(t)
    if last and t.take("GROUP", "BY"):
        keys = [_expr(t)]
        while t.take_sym(","):
            keys.append(_expr(t))
        group = tuple(keys)
    if t.take("ORDER", "BY"):
        while True:
            e = _expr(t)
            down = t.take("DESC") or t.take("DESCENDING")
            if not down:
                t.take("ASC") or t.take("ASCENDING")
            order.append(s.Sort(e, down))
            if not t.take_sym(","):
                break
    if t.take("SKIP"):
        skip = t.natural()
    if t.take("LIMIT"):
        limit = t.natural()
    if not last and where is None and t.take("WHERE"):
        where = _expr(t)
    return s.Project(tuple(items), last, star, distinct, where, group, tuple(order), skip, limit)


def _clause_next(t: _Tokens) -> bool:
    return any(t.word(w) for w in ("MATCH", "RETURN", "WHERE", "ORDER", "LIMIT", "SKIP", "UNWIND", "WITH", "CREATE", "SET", "DELETE", "DETACH", "MERGE", "OPTIONAL", "REMOVE"))


def _sets(t: _Tokens) -> list[s.SetOne]:
    out = []
    while True:
        var = t.name("a variable")
        if t.take_sym("."):
            key = t.key()
            t.need_sym("=")
            out.append(s.SetOne(var, key, _expr(t)))
        else:
            merge = t.take_sym("+=")
            if not merge:
                t.need_sym("=")
            out.append(s.SetOne(var, None, _expr(t), merge))
        if not t.take_sym(","):
            return out


def _removes(t: _Tokens) -> list[s.SetOne]:
    out = []
    while True:
        var = t.name("a variable")
        t.need_sym(".")
        out.append(s.SetOne(var, t.key(), s.Lit(None)))
        if not t.take_sym(","):
            return out


def _clause(t: _Tokens):
    if t.word("OPTIONAL", "MATCH") or t.word("MATCH"):
        optional = t.take("OPTIONAL")
        t.need("MATCH")
        paths = _paths(t)
        return s.Match(paths, _expr(t) if t.take("WHERE") else None, optional)
    if t.take("UNWIND"):
        e = _expr(t)
        t.need("AS")
        return s.Unwind(e, t.name("a variable"))
    if t.take("WITH"):
        return _project(t, False)
    if t.take("RETURN"):
        return _project(t, True)
    if t.take("CREATE"):
        return s.Create(_paths(t))
    if t.take("SET"):
        return s.SetAll(tuple(_sets(t)))
    if t.take("REMOVE"):
        return s.SetAll(tuple(_removes(t)))
    if t.word("DETACH") or t.word("DELETE"):
        detach = t.take("DETACH")
        t.need("DELETE")
        names = [t.name("a variable")]
        while t.take_sym(","):
            names.append(t.name("a variable"))
        return s.Delete(tuple(names), detach)
    if t.take("MERGE"):
        node = _node(t)
        if not node.label:
            t.fail("MERGE needs a label")
        found: dict[str, list] = {"CREATE": [], "MATCH": []}
        while t.word("ON"):
            kind = next((k for k in found if t.take("ON", k, "SET")), None)
            if kind is None:
                t.fail("expected ON CREATE SET or ON MATCH SET")
            found[kind] += _sets(t)
        return s.Merge(node, tuple(found["CREATE"]), tuple(found["MATCH"]))
    if t.take("CALL"):
        name = [t.name("a procedure")]
        while t.take_sym("."):
            name.append(t.name("a procedure"))
        if t.take_sym("("):
            t.need_sym(")")
        yields = []
        if t.take("YIELD"):
            while True:
                column = t.name("a column")
                yields.append((column, t.name("an alias") if t.take("AS") else column))
                if not t.take_sym(","):
                    break
        return s.CallProc(".".join(name).lower(), tuple(yields))
    t.fail("expected a clause")


def _ddl(t: _Tokens) -> s.Ddl | None:
    start = t.i
    for verb, on in (("CREATE", True), ("DROP", False)):
        if t.take(verb, "INDEX"):
            if t.take("ON"):
                t.need_sym(":")
                label = t.name("a label")
                t.need_sym("(")
                key = t.key()
                t.need_sym(")")
            else:
                t.need("FOR")
                t.need_sym("(")
                var = t.name("a variable")
                t.need_sym(":")
                label = t.name("a label")
                t.need_sym(")")
                t.need("ON")
                t.need_sym("(")
                if t.name("the variable") != var:
                    t.fail("the index names another variable")
                t.need_sym(".")
                key = t.key()
                t.need_sym(")")
            return s.Ddl("create_index" if on else "drop_index", label, key)
        if t.take(verb, "CONSTRAINT"):
            t.need("ON")
            t.need_sym("(")
            var = t.name("a variable")
            t.need_sym(":")
            label = t.name("a label")
            t.need_sym(")")
            t.need("ASSERT")
            if t.name("the variable") != var:
                t.fail("the constraint names another variable")
            t.need_sym(".")
            key = t.key()
            t.need("IS")
            t.need("UNIQUE")
            return s.Ddl("create_unique" if on else "drop_unique", label, key)
    if t.take("ALTER", "LABEL"):
        t.need_sym(":")
        label = t.name("a label")
        on = t.take("SET")
        if not on:
            t.need("REMOVE")
        t.need("APPEND")
        t.need("ONLY")
        return s.Ddl("append_only", label, on=on)
    for words, kind in ((("SHOW", "INDEX", "INFO"), "show_index"), (("SHOW", "CONSTRAINT", "INFO"), "show_constraint"), (("SHOW", "APPEND", "ONLY", "INFO"), "show_append_only")):
        if t.take(*words):
            return s.Ddl(kind)
    t.i = start
    return None


@lru_cache(maxsize=4096)
def parse(text: str) -> s.Statement | s.Ddl:
    t = _Tokens(text)
    found = _ddl(t)
    clauses = []
    if found is None:
        while t.peek()[0] != "end" and not t.sym(";"):
            clauses.append(_clause(t))
        if not clauses:
            t.fail("an empty statement")
        found = s.Statement(tuple(clauses))
    t.take_sym(";")
    if t.peek()[0] != "end":
        t.fail("expected the end of the statement")
    return found


def split_script(text: str) -> list[str]:
    """Statements of a script: split at semicolons outside of quotes and comments."""
    out, start = [], 0
    for m in re.finditer(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|//[^\n]*|/\*.*?\*/|;""", text, re.S):
        if m[0] == ";":
            out.append(text[start : m.start()])
            start = m.end()
    out.append(text[start:])
    return [x.strip() for x in out if re.sub(r"//[^\n]*|/\*.*?\*/", "", x, flags=re.S).strip()]
