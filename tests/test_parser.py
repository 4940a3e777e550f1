import pytest
from hypothesis import given
from hypothesis import strategies as st

from weft.plans import syntax as s
from weft.plans.parser import parse, split_script
from weft.plans.syntax import QueryError, text_of


def returned(text):
    return [text_of(i.expr) for i in parse(f"RETURN {text}").clauses[0].items]


@pytest.mark.parametrize(
    "text, shown",
    [
        ("1 + 2 * 3", "(1 + (2 * 3))"),
        ("1 - 2 - 3", "((1 - 2) - 3)"),
        ("(1 + 2) * 3", "((1 + 2) * 3)"),
        ("NOT a = 1 AND b < 2 OR c", "((NOT (a = 1) AND (b < 2)) OR c)"),
        ("a.x IS NOT NULL", "a.x IS NOT NULL"),
        ("a IN [1, 'x', NULL]", "(a IN [1, 'x', NULL])"),
        ("a.n STARTS WITH 'x'", "(a.n STARTS WITH 'x')"),
        ("count(*)", "COUNT(*)"),
        ("sum(a.x) / 2", "(SUM(a.x) / 2)"),
        ("toUpper(a.x)", "toupper(a.x)"),
        ("l[0][1]", "l[0][1]"),
        ("none(x IN l WHERE x.y > 0)", "NONE(x IN l WHERE (x.y > 0))"),
        ("-5", "-5"),
        ("-a", "-a"),
        ("1.50", "1.5"),
        ("2.0", "2"),
        ("TRUE", "true"),
        ("a <> b", "(a <> b)"),
        ("shortestPath((a)-[*]->(b))", "shortestPath(...)"),
    ],
)
def test_expressions(text, shown):
    assert returned(text) == [shown]


@pytest.mark.parametrize("text, low, high", [("*", 0, 100), ("*3", 3, 3), ("*2..", 2, 100), ("*..4", 0, 4), ("*1..3", 1, 3)])
def test_hops(text, low, high):
    rel = parse(f"MATCH (a)-[:R{text}]->(b) RETURN a").clauses[0].paths[0].rels[0]
    assert (rel.low, rel.high) == (low, high)


@pytest.mark.parametrize(
    "text",
    ["", "MATCH (a RETURN a", "MATCH (a:A:B) RETURN a", "MATCH (a)--(b) RETURN a", "RETURN 1 < 2 < 3", "RETURN 'open", "MATCH (a) WHERE a IN 5 RETURN a", "RETURN 99999999999999999999", "MATCH (a)-[*3..1]->(b) RETURN a", "RETURN 1 2", "MERGE (n {a: 1})", "RETURN " + "(" * 200 + "1" + ")" * 200, "WITH 1 + 1 RETURN 2", "RETURN sum(count(a))"],
)
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_comments_quotes_and_case():
    st_ = parse('match /* x */ (`odd name`:"Label") // end\n where `odd name`.a = \'it\\\'s\' return `odd name`')
    m = st_.clauses[0]
    assert m.paths[0].nodes[0] == s.NodePat("odd name", "Label")
    assert m.where == s.Op("=", (s.Prop("odd name", "a"), s.Lit("it's")))


def test_scripts():
    assert split_script("CREATE (:A {x: 'a;b'}); // no; not here\nMATCH (n) RETURN n;;") == ["CREATE (:A {x: 'a;b'})", "// no; not here\nMATCH (n) RETURN n"]


def test_declarations():
    assert parse("CREATE INDEX FOR (n:L) ON (n.p)") == parse("create index on :L(p);") == s.Ddl("create_index", "L", "p")
    assert parse("ALTER LABEL :L REMOVE APPEND ONLY") == s.Ddl("append_only", "L", on=False)
    assert parse("DROP CONSTRAINT ON (n:L) ASSERT n.p IS UNIQUE") == s.Ddl("drop_unique", "L", "p")


@given(st.recursive(st.integers(0, 99).map(str), lambda x: st.tuples(x, st.sampled_from("+-*/"), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=12))
def test_text_of_parsed_text_is_stable(text):
    once = returned(text)[0]
    assert returned(once)[0] == once


@given(st.text(max_size=20))
def test_string_literals_round_trip(value):
    quoted = "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    assert parse(f"RETURN {quoted}").clauses[0].items[0].expr == s.Lit(value)
