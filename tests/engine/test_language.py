import random

import pytest

from sawmill.operators import search
from sawmill.plans import ast, command, engine
from sawmill.plans.lexer import split_pipe, tokenize

from .lines import holds

LINES = [
    "",
    " :=,\t",
    "2017-06-09 20:10:40 ERROR sending result StreamResponse{streamId=1} to /10.1.2.3:5000",
    "[error] [client 10.0.0.1] Invalid URI in request GET / HTTP/1.1",
    "xInvalid URI in requestY",
    "Invalid URIx in request",
    "Received disconnect from 10.0.0.7: 11: Bye Bye",
    "failed Err:-1 Errno:1 from host=alpha, user=root",
    "authentication failure; rhost=221.230.128.214",
    "HTTPS play.google.com:443 open",
    "alpha , gamma",
    "delta value",
    'say "quoted" a*b \\E \\Q $1 (x) [y]',
    "Straße 東京 ошибка",
    "a b c",
    "a  b",
    "a=b",
    "not and or",
    "long " * 5000,
    "HTTPS play.google.com:443 open",
]
QUERIES = [
    "error", "ERROR", "Invalid URI in request", '"Invalid URI in request"', "error AND Invalid URI in request", "HTTPS AND play.google.com:443",
    "failed AND Err:-1 Errno:1", "alpha*gamma", "( alpha*gamma )", "*alpha", "alpha*", "a*b*c", "*", "**", "a b", "a AND b", "a OR delta", "NOT a", "not not a",
    "a not b", "( a or delta ) and not ( b or value )", "alpha , gamma", '"alpha , gamma"', "a=b", '"a b"', "Straße", "東京 ошибка", "/[0-9]{3}/", '"not"', "rhost=221.230.128.214", "\\E", '"$1 "', "",
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(LINES)] + [(99, None)], "line_no long, raw string")


def found(lines, tree):
    return sorted(r.line_no for r in search.matching(lines, tree).collect() if r.line_no != 99)


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("piped", [False, True])
def test_search_like_the_plain_matcher(lines, query, piped):
    tree = ast.parse(query, piped=piped)
    assert found(lines, tree) == [i for i, x in enumerate(LINES) if holds(tree, x)]


def test_random_trees(lines):
    rng = random.Random(3)
    words = ["error", "a", "b", "Invalid", "URI", "HTTPS", "alpha*gamma", "10.0.0", "user", "Bye", "delta value", "失"]

    def tree(depth):
        k = rng.random()
        if depth == 0 or k < 0.3:
            return ast.Phrase(tuple(rng.choice(words).split()))
        if k < 0.5:
            return ast.Not(tree(depth - 1))
        return (ast.And if k < 0.75 else ast.Or)(tuple(tree(depth - 1) for _ in range(rng.randint(2, 3))))

    for _ in range(25):
        t = tree(3)
        assert found(lines, t) == [i for i, x in enumerate(LINES) if holds(t, x)]


def test_words_mean_and_alone_and_a_phrase_before_a_pipe():
    assert ast.parse("a b") == ast.And((ast.Phrase(("a",)), ast.Phrase(("b",))))
    assert ast.parse("a b", piped=True) == ast.Phrase(("a", "b"))
    assert ast.parse("a b AND c") == ast.And((ast.Phrase(("a", "b")), ast.Phrase(("c",))))


def test_precedence():
    assert ast.parse("a or b and not c") == ast.Or((ast.Phrase(("a",)), ast.And((ast.Phrase(("b",)), ast.Not(ast.Phrase(("c",)))))))
    assert ast.parse("a OR B aNd c", piped=True) == ast.Or((ast.Phrase(("a",)), ast.And((ast.Phrase(("B",)), ast.Phrase(("c",))))))


@pytest.mark.parametrize("bad", ["( a", "a )", "a and", "or b", "not", "( )", "-time x y a"])
def test_bad_queries(bad):
    with pytest.raises(ast.QueryError):
        ast.parse(bad)


def test_fields():
    known = {"host", "size"}
    assert ast.parse("Host:web1", known) == ast.FieldMatch("host", "web1")
    assert ast.parse("host:web1 |strict |ci", known) == ast.FieldMatch("host", "web1", True, True)
    assert ast.parse("size:>=10", known) == ast.FieldCompare("size", ">=", 10)
    assert ast.parse("size:==10", known) == ast.FieldCompare("size", "==", 10)
    assert ast.parse("size:!=10", known) == ast.FieldCompare("size", "!=", 10)
    assert ast.parse("size:-5..10", known) == ast.FieldCompare("size", "..", -5, 10)
    assert ast.parse("12:30", known) == ast.And(tuple(ast.Phrase((x,)) for x in ("12", ":", "30")))
    assert ast.parse("error and host:a or size:<3", known) == ast.Or((ast.And((ast.Phrase(("error",)), ast.FieldMatch("host", "a"))), ast.FieldCompare("size", "<", 3)))


def test_time_range():
    assert ast.parse("-time 5 9 a") == ast.And((ast.TimeRange(5, 9), ast.Phrase(("a",))))
    assert ast.parse('a -time "2024-01-05 00:00:00" "2024/01/06 00:00:00"') == ast.And((ast.TimeRange(1704412800000, 1704499200000), ast.Phrase(("a",))))
    assert ast.parse("-time 5 9") == ast.TimeRange(5, 9)


def test_tokens_and_pipes():
    assert [t.text for t in tokenize('a=b, "c d":e (f)')] == ["a", "=", "b", ",", "c d", ":", "e", "(", "f", ")"]
    assert split_pipe('a "x|y" |strict | stats count') == ('a "x|y" |strict ', " stats count")
    assert split_pipe("a b") == ("a b", None)


C = command.Command


@pytest.mark.parametrize(
    "text, want",
    [
        ("stats count()", C("stats")),
        ("stats count", C("stats")),
        ("STATS Count by Host", C("stats", group="Host")),
        ("stats count() by host", C("stats", group="host")),
        ("stats sum(bytes)", C("stats", "sum", "bytes")),
        ("stats+sum(bytes)+by+user", C("stats", "sum", "bytes", "user")),
        ("stats min( v ) by g", C("stats", "min", "v", "g")),
        ("stats distinct(user) by host", C("stats", "distinct", "user", "host")),
        ("top(user,20)", C("top", field="user", k=20)),
        ("top(user)", C("top", field="user")),
        ("top(user,x)", C("top", field="user")),
        ("top 10 user", C("top", field="user", k=10)),
        ("top -3 user", C("top", field="user", k=10)),
        ("distinct(ip)", C("stats", "distinct", "ip")),
        ("stats distinct(ip)", C("stats", "distinct", "ip")),
        ("by(host) avg(bytes)", C("stats", "avg", "bytes", "host")),
        ("by(host) count()", C("stats", group="host")),
        ("by(host) distinct(u)", C("stats", "distinct", "u", "host")),
        ("timechart span=1m count() by host", C("timechart", group="host", span_ms=60_000)),
        ("timechart bins=5 count", C("timechart", bins=5)),
        ("timechart by(host) span=500ms", C("timechart", group="host", span_ms=500)),
        ("timechart start=10 end=20 span=7", C("timechart", start=10, end=20, span_ms=7)),
        ("timechart", C("timechart")),
        ("stat count", None),
        ("stats median(x)", None),
        ("top", None),
        ("", None),
    ],
)
def test_commands(text, want):
    assert command.parse_command(text) == want


def test_plan():
    assert engine.plan("a | stats count") == ("a ", C("stats"))
    assert engine.plan("stats count by x") == ("", C("stats", group="x"))
    assert engine.plan("a | nonsense") == ("a   nonsense", None)


def test_units():
    assert [command.size_bytes(x) for x in ("64m", "1g", "2T", "10k", "7", "x")] == [64 << 20, 1 << 30, 2 << 40, 10 << 10, 7, 0]
    assert [command.duration_ms(x) for x in ("5", "5ms", "5s", "5m", "5h", "5d", "x")] == [5, 5, 5000, 300_000, 18_000_000, 432_000_000, 0]
