"""What depends on types, composes, or serves over windows, alike in the API and in SQL."""

import pytest

import tessera.functions as f
from tessera import Engine, Window
from tessera.errors import SchemaMismatch


@pytest.fixture(scope="module")
def e(spark):
    engine = Engine(spark)
    engine.lift([(1, 7, 2, "ab", True), (1, -7, 2, "abc", False), (2, 9, 4, None, None), (2, 1, -1, "yes", True)], "k int, a int, b bigint, s string, t boolean").as_table("sem")
    return engine


def rows(frame):
    return sorted((tuple(r) for r in frame.to_seq()), key=str)


def test_typed_expressions_compose(e):
    t = e.table("sem")
    assert rows(t.agg(f.sum(f.divide("a", "b")).alias("x"))) == [(3 - 3 + 2 - 1,)]
    assert rows(t.select(f.coalesce(f.length("s"), 0) + 1)) == [(1,), (3,), (4,), (4,)]
    assert rows(t.select(1 + f.length("s"), f.col("a") - f.length("s"), -f.length("s"), f.length("s") % 2, 10 / f.length("s"))) == sorted([(3, 5, -2, 0, 5.0), (4, -10, -3, 1, 10 / 3), (None,) * 5, (4, -2, -3, 1, 10 / 3)], key=str)
    assert rows(t.group_by("k").having((f.product("a") > 1) & (f.count() > 0)).agg("k", f.product("a").alias("p"))) == [(2, 9)]
    assert rows(t.group_by("k").having((f.count() > 0) & (f.product("a") > 1)).agg("k")) == [(2,)]
    assert rows(t.filter(~(f.length("s") == 2) | f.length("s").isNull()).select("a")) == [(-7,), (1,), (9,)]
    assert rows(t.filter(f.to_bool("s") | f.truth("b")).agg(f.count())) == [(4,)]
    assert rows(t.select(f.case(f.length("s"), [(2, "two"), ([3, 4], "more")], "none"))) == [("more",), ("more",), ("none",), ("two",)]


def test_integral_division_in_both(e):
    t = e.table("sem")
    want = [(-1,), (-3,), (2,), (3,)]
    assert rows(t.select(f.divide("a", "b").alias("x"))) == rows(e.sql("SELECT a / b AS x FROM sem")) == want
    assert e.sql("SELECT 7 / 2 AS x, -7 / 2 AS y, 7 / 2.0 AS z, 7 * 2 / 4 / 2 AS u, 1 + 9 / 2 * 2 AS v").to_seq()[0][:] == (3, -3, 3.5, 1, 9)
    assert rows(e.sql("SELECT k, sum(a) / count(*) AS m FROM sem GROUP BY k HAVING max(a) / 2 > 3 ORDER BY k")) == [(2, 5)]
    assert rows(e.sql("SELECT sum(a) OVER (PARTITION BY k) / 3 AS x FROM sem")) == [(0,), (0,), (3,), (3,)]
    assert e.sql("WITH c AS (SELECT a / 2 AS h FROM sem) SELECT max(h / 2) AS x FROM (SELECT h FROM c) d").to_seq()[0][0] == 2
    assert dict(e.sql("SELECT CAST(7 AS TINYINT) / CAST(2 AS SMALLINT) AS x").df.dtypes) == {"x": "smallint"}


def test_booleans_lengths_and_conditions_in_sql(e):
    assert e.sql("SELECT CAST('on' AS BOOLEAN) AS a, CAST('N' AS BOOLEAN) AS b, CAST('x' AS BOOLEAN) AS c, CAST(2 AS BOOLEAN) AS d, CASE WHEN 1 THEN 'y' ELSE 'n' END AS e").to_seq()[0][:] == (True, False, None, True, "y")
    assert e.sql("SELECT length(array(1, 2)) AS a, length('abc') AS b, length(map('k', 1)) AS c").to_seq()[0][:] == (2, 3, 1)
    assert rows(e.sql("SELECT s FROM sem WHERE CAST(s AS BOOLEAN) OR length(s) = 2")) == [("ab",), ("yes",)]


def test_product_and_array_agg_over_windows(e):
    t = e.table("sem")
    w = Window.partition_by("k")
    want = [(-49,), (-49,), (9,), (9,)]
    assert rows(t.select(f.product("a").over(w))) == rows(e.sql("SELECT product(a) OVER (PARTITION BY k) AS x FROM sem")) == want
    assert rows(e.sql("SELECT product(a) OVER w AS x FROM sem WINDOW w AS (PARTITION BY k)")) == want
    running = "array_agg(a) OVER (PARTITION BY k ORDER BY a)"
    assert rows(t.select(f.array_agg("a").over(w.order_by("a")))) == rows(e.sql(f"SELECT {running} AS x FROM sem")) == [([-7, 7],), ([-7],), ([1, 9],), ([1],)]


def test_product_gathers_next_to_nothing(e, spark):
    t = e.lift([(1, -1)] * 3 + [(1, 1)] * 50 + [(1, 6), (1, None), (2, 0), (2, 5), (3, None)], "k int, v bigint").as_table("prod")
    want = [(1, -6), (2, 0), (3, None)]
    assert rows(t.group_by("k").agg("k", f.product("v"))) == rows(e.sql("SELECT k, product(v) AS p FROM prod GROUP BY k")) == want
    with pytest.raises(Exception, match="(?i)overflow"):
        e.lift([(2,)] * 70, "v bigint").agg(f.product("v")).to_seq()


def test_a_product_is_multiplied_in_the_type_it_is_cast_to(e, spark):
    t = e.lift([(1, v) for v in (70000, -1, 70000, 1)] + [(2, 0), (2, 70000), (2, 70000), (3, None)], "k int, v int").as_table("wide")
    for kind, want in (("double", [(1, -4.9e9), (2, 0.0), (3, None)]), ("bigint", [(1, -4900000000), (2, 0), (3, None)])):
        got = e.sql(f"SELECT k, CAST(product(v) AS {kind}) AS p FROM wide GROUP BY k")
        assert rows(got) == rows(t.group_by("k").agg("k", f.product("v").cast(kind).alias("p"))) == want
        assert dict(got.df.dtypes)["p"] == kind
        w = Window.partition_by("k")
        many = sorted([want[0][1:]] * 4 + [want[1][1:]] * 3 + [(None,)], key=str)
        assert rows(e.sql(f"SELECT CAST((product(v) OVER (PARTITION BY k)) AS {kind}) AS p FROM wide")) == rows(t.select(f.product("v").over(w).cast(kind))) == many
    assert e.lift([(7,)] * 100, "v bigint").agg(f.product("v").cast("double")).to_seq()[0][0] == pytest.approx(7.0**100)
    assert e.sql("SELECT CAST((SELECT max(v) FROM wide) AS BIGINT) AS x").to_seq()[0][0] == 70000
    for text in ("product(v)", "CAST(product(v) AS INT)", "product(v) + 1"):  # elsewhere it keeps the type of its input
        with pytest.raises(Exception, match="(?i)overflow"):
            e.sql(f"SELECT {text} AS p FROM wide WHERE k = 1").to_seq()


def test_average_and_product_on_a_whole_table(spark):
    import duckdb

    import __spark_entry__ as entry

    place = "/root/testdata/sf0.1"
    got = entry.queries()["sql_average_product"](spark, place).toPandas().sort_values("l_orderkey")
    want = duckdb.sql(f"SELECT l_orderkey, round(avg(l_quantity), 6) AS m, product(l_linenumber) AS p FROM '{place}/lineitem.parquet' GROUP BY l_orderkey ORDER BY 1").df()
    assert (got["l_orderkey"].to_numpy() == want["l_orderkey"].to_numpy()).all() and (got["p"].to_numpy() == want["p"].to_numpy()).all()
    assert got["m"].to_numpy() == pytest.approx(want["m"].to_numpy(), abs=1e-6) and want["p"].max() > 2**31


def test_a_user_defined_aggregate(e):
    t = e.table("sem")
    total = f.aggregate("b", f.lit(0).cast("bigint"), lambda s, v: s + v, lambda x, y: x + y)
    most = f.aggregate("a", f.lit(None).cast("int"), lambda s, v: f.greatest(s, v))
    mean = f.aggregate("a", f.struct(f.lit(0.0), f.lit(0)), lambda s, v: f.struct(s["c0"] + v, s["c1"] + 1), result=lambda s: s["c0"] / s["c1"])
    assert rows(t.group_by("k").agg("k", total, most, mean)) == [(1, 4, 7, 0.0), (2, 3, 9, 5.0)]
    assert rows(t.select(total.over(Window.partition_by("k")))) == [(3,), (3,), (4,), (4,)]
    joined = f.aggregate("a", f.lit(""), lambda s, v: f.concat(s, v.cast("string"), f.lit(" ")), order="a")
    assert t.agg(joined).to_seq()[0][0] == "-7 1 7 9 "


def test_registered_functions_reach_sql(e):
    e.functions.register("twice", lambda x: x * 2)
    e.functions.register("spread", lambda x: f.max(x) - f.min(x))
    assert rows(e.sql("SELECT twice(a + 1) AS x FROM sem")) == [(-12,), (16,), (20,), (4,)]
    assert rows(e.sql("SELECT k, spread(a) AS x FROM sem GROUP BY k")) == [(1, 14), (2, 8)]
    e.functions.remove("twice")
    with pytest.raises(Exception, match="(?i)unresolved_routine"):
        e.sql("SELECT twice(a) AS x FROM sem")


def test_set_operations_want_equal_names_in_sql(e):
    with pytest.raises(SchemaMismatch):
        e.sql("SELECT 1 AS a UNION SELECT 2 AS b")
    assert rows(e.sql("SELECT 1 AS a UNION SELECT 1 AS A EXCEPT SELECT 1 AS a")) == [(1,)]


def test_rlike_takes_the_whole_string(e):
    t = e.lift([("ab",), ("ab\n",), ("xab",)], "s string")
    assert rows(t.filter(f.rlike("s", "ab")).select("s")) == [("ab",)]


def test_let_and_java(e):
    e.let(small=e.table("sem").filter(f.col("a") < 5))
    assert rows(e.sql("SELECT count(*) AS n FROM small")) == [(2,)]
    assert e.range(1).select(f.java("java.lang.Math", "max", f.lit(3), f.lit(4))).to_seq()[0][0] == "4"
