import pytest
from pyspark.errors import AnalysisException, ParseException

from tessera import Engine
from tessera.errors import DialectError


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.lift([(1, "a"), (2, "b"), (3, None)], "a INT, b STRING").as_table("t")
    return e


CASES = [
    ("SELECT 2 ^ 3 AS v", [(8.0,)]),
    ("SELECT -2 ^ 2 AS v", [(4.0,)]),
    ("SELECT 2 ^ 3 ^ 2 AS v", [(64.0,)]),
    ("SELECT (1 + 1) ^ abs(-2) * 3 AS v", [(12.0,)]),
    ("SELECT t.a ^ 2 AS v FROM t", [(1.0,), (4.0,), (9.0,)]),
    ("SELECT 'x' || b || a + 1 AS v FROM t", [("xa2",), ("xb3",), ("x4",)]),
    ("SELECT concat(b, '!') AS v FROM t", [("a!",), ("b!",), ("!",)]),
    ("SELECT CASE WHEN b || '' = '' THEN 'none' ELSE b || '.' END AS v FROM t", [("a.",), ("b.",), ("none",)]),
    ("SELECT CASE a WHEN 1, 3 THEN 'odd' WHEN > 1 THEN CASE b WHEN 'b' THEN 'two' END END AS v FROM t", [("odd",), ("two",), ("odd",)]),
    ("SELECT IF(b = 'a', 1, 2) AS v FROM t", [(1,), (2,), (None,)]),
    ("SELECT NULLIF(a, 2) AS v FROM t", [(1,), (None,), (3,)]),
    ("SELECT b AS v FROM t ORDER BY b", [("a",), ("b",), (None,)]),
    ("SELECT b AS v FROM t ORDER BY b DESC LIMIT 2", [(None,), ("b",)]),
    ("SELECT b AS v FROM t ORDER BY b DESC NULLS LAST, a", [("b",), ("a",), (None,)]),
    ("SELECT a AS v FROM t UNION SELECT a AS v FROM t ORDER BY v LIMIT 3", [(1,), (1,), (2,)]),
    ("SELECT 1 AS one FROM t ORDER BY count(a)", [(1,)]),
    ("SELECT a FROM t ORDER BY sum(a) OVER (ORDER BY a DESC) DESC", [(1,), (2,), (3,)]),
    ("SELECT b FROM t GROUP BY b ORDER BY max(a) DESC", [(None,), ("b",), ("a",)]),
    ("SELECT count(*) AS n FROM t HAVING count(*) > 5", []),
    ("SELECT average(a) AS m, product(a) AS p, first(b) AS f, last(b) AS l FROM t", [(2.0, 6, "a", "b")]),
    ("SELECT array_agg(b) AS v FROM t", [(["a", "b", None],)]),
    ("SELECT sum(a) OVER w1 AS v FROM t WINDOW w0 AS (ORDER BY a), w1 AS (w0 ROWS UNBOUNDED PRECEDING) ORDER BY v", [(1,), (3,), (6,)]),
    ("SELECT max(a) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS v FROM t WINDOW w AS (ORDER BY a)", [(2,), (3,), (3,)]),
    ("WITH c(x) AS (SELECT a, b FROM t) SELECT x, b FROM c WHERE x = 1", [(1, "a")]),
    ("WITH c AS (SELECT 1 AS x), d(y) AS (SELECT x, 2 AS z FROM c) SELECT y, z FROM d", [(1, 2)]),
    ("WITH c AS (SELECT 1 AS x) SELECT z.x AS p, c.x AS q FROM (WITH c AS (SELECT 2 AS x) SELECT x FROM c) z, c", [(2, 1)]),
    ("SELECT q.a FROM (SELECT a FROM t WHERE a > 1 ORDER BY a DESC) AS q WHERE q.a < 3", [(2,)]),
    ("SELECT U&'d!0061ta' UESCAPE '!' AS v", [("data",)]),
    ("SELECT U&'\\0041''x' AS v", [("A'x",)]),
    ("SELECT 'a' 'b' AS v, 'back\\slash' AS w", [("ab", "back\\slash")]),
    ('SELECT "a" AS "odd name" FROM t WHERE a = 1', [(1,)]),
    ("SELECT 1.5 AS v /* note ^ */ -- and || more", [(1.5,)]),
    ("SELECT CAST('1' AS REAL) AS v, CAST(named_struct('p', 'q', 1, 2) AS ROW(p BIGINT, q INT)) AS s", [(1.0, (1, 2))]),
    ("SELECT map('k', 'l', 1, 2) AS m;", [({"k": 1, "l": 2},)]),
]


@pytest.mark.parametrize(("sql", "want"), CASES)
def test_sql(engine, sql, want):
    got = [tuple(tuple(v) if isinstance(v, tuple) else v for v in r) for r in engine.sql(sql).to_seq()]
    assert got == want


def test_fractions_are_doubles(engine):
    assert engine.sql("SELECT 1.5 AS v, .5 AS w, 1.0E0 AS x").schema.simpleString() == "struct<v:double,w:double,x:double>"


@pytest.mark.parametrize(
    ("sql", "error"),
    [
        ("SELECT missing FROM t", AnalysisException),
        ("SELECT a FROM t GROUP BY count(a)", AnalysisException),
        ("SELECT max(count(a)) FROM t", AnalysisException),
        ("SELECT a FROM t HAVING a > 1", AnalysisException),
        ("SELECT sum(a) OVER nowhere AS v FROM t", (AnalysisException, ParseException)),
        ("WITH c(x, y, z) AS (SELECT a FROM t) SELECT * FROM c", DialectError),
        ("SELECT sum(a) OVER (w ROWS 1 PRECEDING) FROM t WINDOW w AS (ORDER BY a ROWS 1 PRECEDING)", DialectError),
        ("SELECT CASE a WHEN 1 THEN 2", DialectError),
        ("SELECT (1", DialectError),
        ("SELEC 1", ParseException),
    ],
)
def test_errors(engine, sql, error):
    with pytest.raises(error):
        engine.sql(sql)
