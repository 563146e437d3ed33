"""Every query against its SQL in DuckDB, and the shape of some plans."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import tessera.functions as f
from tessera import Engine
from tessera.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def ordered(rows, names):
    at = [names.index(n) for n in sorted(names)]
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name not in ORACLE_SQL:
        assert rows
        return
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert ordered(rows, df.columns) == ordered(want.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_null_order_and_ids_over_whole_tables(spark, duck):
    """What the row caps and id conditions of sort_null_order, sql_null_order, cte_cols, derived_table and filter_null leave out."""
    e = Engine(spark).open(DIR, "orders", "customer")
    rows = lambda frame: [tuple(r) for r in frame.df.collect()]
    want = duck.execute("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s DESC NULLS FIRST, o_orderkey").fetchall()
    assert len(want) > 50 and any(s is not None for _, s in want)
    shown = e.table("orders").select("o_orderkey", f.null_if("o_orderstatus", F.lit("F")).alias("s"))
    assert rows(shown.order_by(f.desc("s"), "o_orderkey")) == want
    assert rows(e.sql("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s DESC, o_orderkey")) == want
    everyone = duck.execute("SELECT c_custkey, c_name FROM customer").fetchall()
    assert sorted(rows(e.sql("WITH c(key) AS (SELECT c_custkey, c_name FROM customer) SELECT key, c_name FROM c"))) == sorted(everyone)
    dear = duck.execute("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000").fetchall()
    inner = e.table("orders").filter(f.col("o_totalprice") > 1000).select("o_orderkey", "o_totalprice")
    assert sorted(rows(inner.subquery("o").select("o.o_orderkey", "o.o_totalprice"))) == sorted(dear)
    both = e.table("customer").left_join(e.table("orders")).on(f.col("c_custkey") == f.col("o_custkey"))
    pairs = duck.execute("SELECT c_custkey, o_orderkey IS NULL FROM customer LEFT JOIN orders ON c_custkey = o_custkey").fetchall()
    assert sorted(rows(both.select("c_custkey", f.col("o_orderkey").isNull().alias("lonely")))) == sorted(pairs)


def test_every_oracle_is_sql():
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - set(QUERIES)))
def test_oracle_of_a_training_data_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert ordered([tuple(r) for r in df.collect()], df.columns) == ordered(want.fetchall(), names)


def plan(spark, name):
    return QUERIES[name](spark, DIR)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"lift_values"}))  # whose rows come from Python
def test_no_python_and_no_product_where_keys_are_equal(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "Pandas" not in text
    if name.startswith("join_") and name not in ("join_cross",):
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "filter_cmp")
    assert "PushedFilters: [IsNotNull" in text and "GreaterThanOrEqual(o_totalprice,1500" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in text


def test_top_k_is_one_pass(spark):
    assert "TakeOrderedAndProject" in plan(spark, "top_k")
