import pytest
from hypothesis import given
from hypothesis import strategies as st

from flatsql.errors import QueryError
from flatsql.plans.ast import Between, Call, Case, Compare, In, IsNull, Like, Literal, Logic, Name, Not, Star
from flatsql.plans.lexer import tokenize
from flatsql.plans.parser import parse, parse_predicate
from flatsql.plans.simple import parse_simple


def test_all_clauses():
    q = parse("SELECT a, COUNT(*) AS n FROM 'x.csv' WHERE b > 1 GROUP BY a HAVING n > 2 ORDER BY n DESC, a LIMIT 3;")
    assert q.source.path == "x.csv"
    assert q.items[0].expr == Name("a") and q.items[1].alias == "n"
    assert isinstance(q.items[1].expr, Call) and q.items[1].expr.args == (Star(),)
    assert [o.descending for o in q.order_by] == [True, False]
    assert q.limit == 3 and not q.distinct


def test_precedence():
    p = parse_predicate("a = 1 OR b = 2 AND NOT c = 3")
    assert isinstance(p, Logic) and p.op == "OR"
    assert isinstance(p.items[1], Logic) and p.items[1].op == "AND" and isinstance(p.items[1].items[1], Not)
    p = parse_predicate("(a = 1 OR b = 2) AND c = 3")
    assert p.op == "AND" and p.items[0].op == "OR"
    p = parse_predicate("x IS NULL AND y BETWEEN 1 AND 2 AND z IN (1, 'b')")
    assert [type(i) for i in p.items] == [IsNull, Between, In]


@pytest.mark.parametrize(
    ("text", "kind"),
    [("a NOT IN (1)", Not), ("a NOT LIKE 'x%'", Not), ("a ILIKE 'x'", Like), ("a IS NOT NULL", Not), ("a <> 1", Compare), ("a NOT BETWEEN 1 AND 2", Not)],
)
def test_predicates(text, kind):
    assert isinstance(parse_predicate(text), kind)


def test_bare_word_on_the_right_is_text():
    assert parse_predicate("a = b").right == Literal("b")
    assert parse_predicate("x.a = y.b").right == Name("b", "y")
    assert parse_predicate("a = -5").right == Literal("-5")


def test_names_and_text():
    q = parse('SELECT "first name", t.b, CASE WHEN a > 1 THEN 2 ELSE 3 END, CAST(a AS VARCHAR(10)), EXTRACT(year FROM d) FROM data.csv t')
    assert q.items[0].expr == Name("first name") and q.items[1].expr == Name("b", "t")
    assert isinstance(q.items[2].expr, Case)
    assert q.items[4].expr.text == "EXTRACT(year FROM d)"
    assert q.source.path == "data.csv" and q.source.alias == "t"


@pytest.mark.parametrize(
    "text",
    ["", "SELECT", "SELECT a", "SELECT a FROM", "SELECT a FROM x LIMIT 1.5", "SELECT a FROM x LIMIT b", "SELECT a FROM x LEFT JOIN y ON x.a = y.a", "SELECT a FROM x CROSS JOIN y", "SELECT a FROM x WHERE", "SELECT a FROM x WHERE a", "SELECT a FROM x GROUP a", "SELECT a FROM x JOIN y ON a > b", "SELECT CASE END FROM x", "SELECT a FROM x extra words", "SELECT a FROM x WHERE a = 'open"],
)
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_simple_mode():
    q = parse_simple(["f.csv"])
    assert q.limit == 10 and isinstance(q.items[0].expr, Star)
    q = parse_simple(["f.csv", "a, b", "a>1 AND b=x OR c<=2", "0", "a:desc"])
    assert q.limit is None and q.where.op == "OR" and q.order_by[0].descending
    for bad in ([], ["f", "a", "", "x"], ["f", "a", "", "", "a:up"], ["f"] * 6):
        with pytest.raises(QueryError):
            parse_simple(bad)


@given(st.text(alphabet="abc'\"`1.=<>!(),*%_ \n", max_size=30))
def test_tokenizer_never_loops_or_crashes(text):
    try:
        tokens = tokenize(text)
    except QueryError:
        return
    assert tokens[-1].kind == "end"
    assert all(a.end <= b.start for a, b in zip(tokens, tokens[1:]))


@given(st.text(alphabet="abcxyz '%", max_size=12))
def test_string_literals_round_trip(value):
    quoted = value.replace("'", "''")
    assert parse_predicate(f"a = '{quoted}'").right == Literal(value)
