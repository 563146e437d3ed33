from dataclasses import dataclass

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import tessera.functions as f
from tessera import Engine, Window
from tessera.errors import FunctionNotFound, SchemaMismatch
from tessera.types import parse_type


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


@pytest.fixture(scope="module")
def nulls(engine):
    rows = [(1, True, 4, "a", 1.5), (1, None, None, None, None), (2, False, -3, "b", 0.0), (None, True, 7, "a", 2.0), (3, None, None, None, None), (3, None, None, None, None)]
    return engine.lift(rows, "k INT, b BOOLEAN, i INT, s STRING, d DOUBLE")


def rows(frame):
    return [tuple(r) for r in frame.to_seq()]


def pairs(engine):
    return engine.lift([(1, "a"), (2, "b")], "i INT, s STRING")


def test_projection_and_filter(engine):
    p = pairs(engine)
    assert rows(p.filter(f.col("i") != 2).select("s", "i")) == [("a", 1)]
    assert p.rename("x", "y").columns == ["x", "y"] and p.rename_first("x").columns == ["x", "s"]
    with pytest.raises(SchemaMismatch):
        p.rename("x")
    with pytest.raises(ValueError):
        p.select()
    with pytest.raises(AnalysisException):
        p.select("missing")


def test_ranges_values_and_tables(engine):
    assert rows(engine.range(3)) == [(0,), (1,), (2,)] and rows(engine.range(1, 6, 2)) == [(1,), (3,), (5,)] and not rows(engine.range(0))
    assert rows(engine.values(F.lit(1).alias("a"), F.lit("x").alias("b"))) == [(1, "x")]
    pairs(engine).as_table("pairs")
    assert engine.table("pairs").df.count() == 2
    engine.drop_table("pairs")
    with pytest.raises(AnalysisException):
        engine.table("pairs")


@dataclass
class Person:
    name: str
    age: int
    tags: list[int]
    boss: str | None = None


def test_lift_records(engine):
    made = engine.lift([Person("Ann", 3, [1]), Person("Bo", 4, [], "Ann")])
    assert made.schema.simpleString() == "struct<name:string,age:bigint,tags:array<bigint>,boss:string>"
    assert [c.nullable for c in made.schema] == [True, False, True, True]
    assert rows(made.select("name", "boss")) == [("Ann", None), ("Bo", "Ann")]
    assert engine.lift([], "a INT").df.count() == 0


def test_joins(engine):
    left, right = engine.range(2).select(f.col("id")), engine.range(2).select((f.col("id") + 1).cast("string").alias("s"))
    assert sorted(rows(left.cross_join(right))) == [(0, "1"), (0, "2"), (1, "1"), (1, "2")]
    assert sorted(rows(left.join(right).on(f.col("id") > 0))) == [(1, "1"), (1, "2")]
    a, b = engine.range(3).subquery("a"), engine.range(3).subquery("b")
    assert sorted(rows(a.join(b).on(f.col("a.id") == f.col("b.id")).filter(f.col("b.id") > 0))) == [(1, 1), (2, 2)]
    r1, r2 = engine.lift([(1, "a"), (None, "n")], "a INT, b STRING"), engine.lift([(1, "x"), (3, "c"), (None, "m")], "c INT, d STRING")
    on = f.col("a") == f.col("c")
    assert rows(r1.join(r2).on(on)) == [(1, "a", 1, "x")]
    assert sorted(rows(r1.left_join(r2).on(on)), key=str) == [(1, "a", 1, "x"), (None, "n", None, None)]
    assert len(rows(r1.right_join(r2).on(on))) == 3 and len(rows(r1.outer_join(r2).on(on))) == 4


def test_order(engine):
    t = engine.lift([(1, "a"), (3, "c"), (None, "b"), (4, None)], "a INT, b STRING")
    first = lambda frame, k: [r[k] for r in rows(frame)]
    assert first(t.order_by("a"), 0) == [1, 3, 4, None] and first(t.order_by(f.asc("a").nulls_first()), 0) == [None, 1, 3, 4]
    assert first(t.order_by(f.desc("b")), 1) == [None, "c", "b", "a"] and first(t.order_by(f.desc("b").nulls_last()), 1) == ["c", "b", "a", None]
    assert rows(t.order_by("a").limit(0)) == [] and first(t.top(1, "a"), 0) == [1]
    counted = f.count().over(Window.partition_by("a").spec)
    assert len(t.order_by(f.desc(counted), "b").columns) == 2


def test_multisets(engine):
    a = engine.lift([(1, "x"), (1, "x"), (None, None), (2, "y")], "a INT, b STRING")
    b = engine.lift([(1, "x"), (None, None), (None, None)], "a INT, b STRING")
    key = lambda frame: sorted(rows(frame), key=str)
    assert len(rows(a.union(b))) == 7
    assert key(a.intersect(b)) == [(1, "x"), (None, None)] and key(a.difference(b)) == [(1, "x"), (2, "y")]
    with pytest.raises(SchemaMismatch):
        a.union(b.rename("a", "c"))


def test_grouping(engine, nulls):
    made = nulls.group_by("k").having(f.count() > 1).order_by(f.desc("k")).agg("k", f.count("i").alias("n"))
    assert rows(made) == [(3, 0), (1, 1)]
    listed = nulls.group_by("k").agg(f.count().alias("n"))
    assert listed.columns == ["n"]
    assert rows(listed.filter(f.max("i") > 0).order_by(f.desc(f.max("i")))) == [(1,), (2,)]
    assert rows(listed.filter(f.col("n") > 1).order_by("n")) == [(2,), (2,)]
    assert rows(engine.lift([], "v INT").agg(f.count().alias("n"), f.sum("v").alias("s"))) == [(0, None)]
    with pytest.raises(AnalysisException):
        nulls.group_by("k").agg("i")
    with pytest.raises(AnalysisException):
        nulls.group_by(f.count("i")).agg("k")


def test_aggregate_functions(engine, nulls):
    one = lambda *e: rows(nulls.agg(*[x.alias(f"c{i}") for i, x in enumerate(e)]))[0]
    assert one(f.count(), f.count("i"), f.sum("i"), f.max("i"), f.min("i")) == (6, 3, 8, 7, -3)
    assert one(f.avg("i"), f.bool_and("b"), f.bool_or("b"), f.product("i"), f.product("d")) == (8 / 3, False, True, -84, 0.0)
    assert one(f.count_distinct("s"), f.array_agg("i", order=F.coalesce("i", F.lit(0)))) == (2, [-3, None, None, None, 4, 7])
    x = engine.range(4).select(F.when(f.col("id") % 2 == 1, f.col("id")).alias("x"), "id")
    both = x.agg(f.first("x", order="id").alias("a"), f.first("x", False, order="id").alias("b"), f.last("x", order="id").alias("c"))
    assert rows(both) == [(1, None, 3)]
    empty = engine.lift([], "i INT, d DOUBLE")
    assert rows(empty.agg(f.product("i").alias("a"), f.product("d").alias("b"), f.array_agg("i").alias("c"))) == [(None, None, [])]


def test_null_semantics(engine, nulls):
    def values(e):
        return [r[0] for r in rows(nulls.select(e.alias("v")))]

    assert values(f.strict_if(f.col("b"), 1, 2)) == [1, None, 2, 1, None, None]
    assert values(f.concat("s", F.lit("-"), "i")) == ["a-4", "-", "b--3", "a-7", "-", "-"]
    assert values(f.in_strict("i", [4, 7])) == [True, False, False, True, False, False]
    assert values(f.in_strict("i", [4, None])) == [True, True, False, False, True, True]
    assert values(f.is_nan("d")) == [False] * 6
    assert values(f.null_if("i", 4)) == [None, None, -3, 7, None, None]
    assert values(f.case("k", [([1, 2], "low"), (lambda k: k > 2, "high")], "none")) == ["low", "low", "low", "none", "high", "high"]


def test_scalars(engine):
    t = engine.lift([(7, -2, "Yes"), (-7, 2, "off"), (5, 3, "1"), (None, 1, None)], "a INT, b INT, s STRING")
    assert rows(t.select(f.divide("a", "b").alias("q"), f.remainder("a", "b").alias("r"))) == [(-3, 1), (-3, -1), (1, 2), (None, None)]
    assert t.select(f.divide("a", "b").alias("q")).schema.simpleString() == "struct<q:int>"
    assert [r[0] for r in rows(t.select(f.to_bool("s").alias("v")))] == [True, False, None, None]
    assert [r[0] for r in rows(t.select(f.cast("s", "BOOLEAN").alias("v")))] == [True, False, None, None]
    assert [r[0] for r in rows(t.select(f.rlike("s", "[Yy].s").alias("v")))] == [True, False, False, None]
    assert rows(t.limit(1).select(f.power("b", 3).alias("p"), f.negate("a").alias("n"), (f.divide("a", F.lit(2)) + 1).alias("s"))) == [(-8.0, -7, 4)]
    made = engine.values(f.make_map(F.lit("a"), F.lit(1)).alias("m"), f.struct(F.lit(1), F.lit("x")).alias("s"), f.named_struct(p=F.lit(2)).alias("n"), f.array(F.lit(1), F.lit(2)).alias("l"))
    assert made.schema.simpleString() == "struct<m:map<string,int>,s:struct<c0:int,c1:string>,n:struct<p:int>,l:array<int>>"
    assert rows(made.select(f.length("m").alias("a"), f.length("l").alias("b"))) == [(1, 2)]


def test_registry():
    r = f.FunctionRegistry()
    assert len(r.names()) == 21
    r.register("Twice", lambda x: f.col(x) * 2)
    assert r.lookup("tWICE")
    r.remove("twice")
    with pytest.raises(FunctionNotFound):
        r.lookup("twice")
    with pytest.raises(ValueError):
        r.call("max", "*")
    with pytest.raises(ValueError):
        r.call("concat", "a", distinct=True)


def test_windows():
    w = Window.partition_by("a").order_by("b")
    with pytest.raises(ValueError):
        w.rows_between(-1, 0).refine(frame=("rows", -1, 0))
    with pytest.raises(ValueError):
        w.refine(order=("c",))
    with pytest.raises(ValueError):
        w.rows_between(-1).range_between(-1)


def test_show(engine, capsys):
    engine.lift([(1, "a" * 30), (2, None)], "i INT, s STRING").show(1)
    out = capsys.readouterr().out
    assert "│1│" + "a" * 17 + "...│" in out and out.rstrip().endswith("Only showing top 1 row")
    engine.range(1).show_schema()
    assert "id: long" in capsys.readouterr().out


@pytest.mark.parametrize(
    ("ddl", "spark_type"),
    [
        ("int", "int"),
        ("REAL", "double"),
        ("ARRAY<MAP<STRING, BIGINT>>", "array<map<string,bigint>>"),
        ("ROW(a INT, b ROW(c FLOAT))", "struct<a:int,b:struct<c:float>>"),
        ("STRUCT<x: tinyint, y: date>", "struct<x:tinyint,y:date>"),
    ],
)
def test_types(ddl, spark_type):
    assert parse_type(ddl).simpleString() == spark_type


@pytest.mark.parametrize("ddl", ["", "nope", "ARRAY<INT", "MAP<INT>", "INT INT", "ROW(a)"])
def test_not_types(ddl):
    with pytest.raises(ValueError):
        parse_type(ddl)
