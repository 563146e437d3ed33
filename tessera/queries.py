"""The engine's queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tessera.functions as f
from tessera.operators.windows import UNBOUNDED_PRECEDING, Window
from tessera.session import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function from an Engine and a table opener to a Frame, with its SQL."""

    def keep(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            engine = Engine(spark)
            return build(engine, lambda name: engine.parquet(sf_dir, name)).df

        QUERIES[build.__name__] = run
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return keep


def text(name: str, sql: str, tables: str, oracle: str | None = None, **functions: Callable) -> None:
    """Registers a query of the SQL dialect; oracle where DuckDB needs another spelling; functions are registered first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark).open(sf_dir, *tables.split())
        for known, build in functions.items():
            engine.functions.register(known, build)
        return engine.sql(sql).df

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or sql


col = f.col

# Projection


@query("SELECT n_name, n_regionkey FROM nation")
def scan_project(e, t):
    return t("nation").select("n_name", "n_regionkey")


@query("SELECT r_regionkey AS k, r_name AS label FROM region")
def rename_cols(e, t):
    return t("region").rename("k", "label")


@query("SELECT * FROM nation")
def select_star(e, t):
    return t("nation").select("*")


@query("SELECT n.n_nationkey, n.n_name, n.n_regionkey, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def select_qualified_star(e, t):
    joined = t("nation").subquery("n").join(t("region").subquery("r")).on(col("n.n_regionkey") == col("r.r_regionkey"))
    return joined.select("n.*", col("r.r_name").alias("region"))


@query("SELECT o.k, o.total FROM (SELECT o_orderkey AS k, o_totalprice AS total FROM orders WHERE o_totalprice > 1000) o WHERE o.total < 200000")
def derived_table(e, t):
    inner = t("orders").filter(col("o_totalprice") > 1000).select(col("o_orderkey").alias("k"), col("o_totalprice").alias("total"))
    return inner.subquery("o").filter(col("o.total") < 200000).select("o.k", "o.total")


# Filters


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 1500 AND o_orderstatus <> 'F'")
def filter_cmp(e, t):
    return t("orders").filter((col("o_totalprice") >= 1500) & (col("o_orderstatus") != "F")).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING') AND c_nationkey > 3")
def filter_and_or_not(e, t):
    return t("customer").filter(f.not_((col("c_acctbal") < 0) | (col("c_mktsegment") == "BUILDING")) & (col("c_nationkey") > 3)).select("c_custkey")


@query("SELECT c_custkey, o_orderkey IS NULL AS lonely FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL OR o_orderstatus IS NOT NULL")
def filter_null(e, t):
    both = t("customer").left_join(t("orders")).on(col("c_custkey") == col("o_custkey"))
    return both.filter(col("o_orderkey").isNull() | col("o_orderstatus").isNotNull()).select("c_custkey", col("o_orderkey").isNull().alias("lonely"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in(e, t):
    return t("orders").filter(f.in_strict("o_orderpriority", ["1-URGENT", "2-HIGH"])).select("o_orderkey")


# Arithmetic


@query("SELECT range AS id, range * 2 + 1 AS odd FROM range(0, 1000, 3)")
def range_arith(e, t):
    return e.range(0, 1000, 3).select("id", (col("id") * 2 + 1).alias("odd"))


@query("SELECT p_partkey, p_size + 2 AS plus, p_size - 2 AS minus, p_size * 3 AS times, p_retailprice / 2 AS half, +p_size AS same FROM part")
def arith_ops(e, t):
    return t("part").select("p_partkey", (col("p_size") + 2).alias("plus"), (col("p_size") - 2).alias("minus"), (col("p_size") * 3).alias("times"), f.divide("p_retailprice", 2).alias("half"), f.positive("p_size").alias("same"))


@query("SELECT p_partkey, CAST((p_size - 25) // 4 AS INTEGER) AS quotient FROM part")
def int_div(e, t):
    return t("part").select("p_partkey", f.divide(col("p_size") - 25, F.lit(4)).alias("quotient"))


@query("SELECT p_partkey, (p_size - 25) % 7 AS rest FROM part")
def mod(e, t):
    return t("part").select("p_partkey", f.remainder(col("p_size") - 25, 7).alias("rest"))


@query("SELECT p_partkey, pow(p_size, 2) AS square FROM part")
def power(e, t):
    return t("part").select("p_partkey", f.power("p_size", 2).alias("square"))


@query("SELECT p_partkey, -p_size AS below FROM part")
def negate(e, t):
    return t("part").select("p_partkey", f.negate("p_size").alias("below"))


@query("SELECT p_partkey, greatest(p_size, 20, NULL) AS most, least(p_size, 20) AS fewest, p_retailprice <> p_retailprice AS odd FROM part")
def greatest_least(e, t):
    return t("part").select("p_partkey", f.greatest("p_size", F.lit(20), F.lit(None)).alias("most"), f.least("p_size", F.lit(20)).alias("fewest"), f.is_nan("p_retailprice").alias("odd"))


# Conditions


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class FROM part")
def case_searched(e, t):
    return t("part").select("p_partkey", f.when(col("p_size") < 10, "small").when(col("p_size") < 30, "medium").otherwise("large").alias("class"))


@query("SELECT p_partkey, CASE WHEN p_size IN (1, 2) THEN 'a' WHEN p_size > 40 THEN 'b' ELSE 'c' END AS class FROM part")
def case_simple_multi(e, t):
    return t("part").select("p_partkey", f.case("p_size", [([1, 2], "a"), (lambda k: k > 40, "b")], "c").alias("class"))


@query("SELECT p_partkey, CASE WHEN nullif(p_size, 5) IS NULL THEN NULL WHEN nullif(p_size, 5) > 20 THEN 1 ELSE 0 END AS flag FROM part")
def if_expr(e, t):
    return t("part").select("p_partkey", f.strict_if(f.null_if("p_size", 5) > 20, 1, 0).alias("flag"))


@query("SELECT p_partkey, coalesce(nullif(p_size, 5), 0) AS size FROM part")
def coalesce_expr(e, t):
    return t("part").select("p_partkey", f.coalesce(f.null_if("p_size", 5), 0).alias("size"))


@query("SELECT p_partkey, nullif(p_brand, 'Brand#11') AS brand FROM part")
def nullif_expr(e, t):
    return t("part").select("p_partkey", f.null_if("p_brand", F.lit("Brand#11")).alias("brand"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS big, CAST(p_size AS DOUBLE) AS d, CAST(p_partkey AS VARCHAR) AS s, CAST(CAST(p_size AS VARCHAR) AS INTEGER) AS back FROM part")
def cast_matrix(e, t):
    return t("part").select("p_partkey", f.cast("p_size", "BIGINT").alias("big"), f.cast("p_size", "REAL").alias("d"), f.cast("p_partkey", "STRING").alias("s"), f.cast(f.cast("p_size", "STRING"), "INT").alias("back"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN true WHEN c_nationkey % 3 = 1 THEN false END AS b FROM customer")
def cast_str_bool(e, t):
    word = F.when(col("c_nationkey") % 3 == 0, "ON").when(col("c_nationkey") % 3 == 1, "n").otherwise("maybe")
    return t("customer").select("c_custkey", f.to_bool(word).alias("b"))


# Strings and collections


@query("SELECT p_partkey, concat(p_brand, nullif(p_type, p_type), '/', CAST(p_size AS VARCHAR)) AS label FROM part")
def concat_skip_null(e, t):
    return t("part").select("p_partkey", f.concat("p_brand", f.null_if("p_type", col("p_type")), F.lit("/"), "p_size").alias("label"))


@query("SELECT p_partkey, regexp_full_match(p_brand, 'Brand#[1-3].*') AS hit FROM part")
def rlike_full(e, t):
    return t("part").select("p_partkey", f.rlike("p_brand", "Brand#[1-3].*").alias("hit"))


@query("SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n, 2 AS m FROM part")
def length_str(e, t):
    return t("part").select("p_partkey", f.length("p_name").alias("n"), f.length(f.array("p_name", "p_brand")).alias("m"))


@query("SELECT n_nationkey, 2 AS n, n_name AS head FROM nation")
def make_array(e, t):
    made = f.array("n_name", F.upper("n_name"))
    return t("nation").select("n_nationkey", f.length(made).alias("n"), made[0].alias("head"))


@query("SELECT n_nationkey, 2 AS n, n_regionkey AS region, n_nationkey AS nation FROM nation")
def make_map(e, t):
    made = f.map_halves(F.lit("r"), F.lit("n"), "n_regionkey", "n_nationkey")
    other = f.make_map(F.lit("n"), "n_nationkey")
    return t("nation").select("n_nationkey", f.length(made).alias("n"), made["r"].alias("region"), other["n"].alias("nation"))


@query("SELECT n_nationkey, n_name AS c0, n_regionkey AS region FROM nation")
def make_struct(e, t):
    return t("nation").select("n_nationkey", f.struct("n_name")["c0"].alias("c0"), f.named_struct_halves("a", "b", "n_name", "n_regionkey")["b"].alias("region"))


# Aggregates


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, max(l_quantity) AS most FROM lineitem")
def agg_global(e, t):
    return t("lineitem").agg(f.count().alias("n"), f.sum("l_linenumber").alias("lines"), f.max("l_quantity").alias("most"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group(e, t):
    return t("lineitem").group_by("l_returnflag", "l_linestatus").agg("l_returnflag", "l_linestatus", f.count().alias("n"), F.round(f.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 1000")
def agg_having(e, t):
    return t("orders").group_by("o_custkey").having(f.count() > 12, f.max("o_totalprice") > 1000).agg("o_custkey", f.count().alias("n"))


@query("SELECT l_suppkey FROM lineitem GROUP BY l_suppkey ORDER BY count(*) DESC, l_suppkey LIMIT 10")
def agg_order_hidden(e, t):
    return t("lineitem").group_by("l_suppkey").order_by(f.desc(f.count()), f.asc("l_suppkey")).agg("l_suppkey").limit(10)


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 100 ORDER BY max(l_orderkey) DESC, l_suppkey LIMIT 7")
def agg_then_filter_sort(e, t):
    made = t("lineitem").group_by("l_suppkey").agg("l_suppkey", f.count().alias("n"))
    return made.filter(f.sum("l_quantity") > 100).order_by(f.desc(f.max("l_orderkey")), f.asc("l_suppkey")).limit(7)


@query("SELECT p_size % 10 AS digit, count(*) AS n FROM part GROUP BY p_size % 10")
def agg_expr_key(e, t):
    return t("part").group_by(col("p_size") % 10).agg((col("p_size") % 10).alias("digit"), f.count().alias("n"))


@query("SELECT l_shipdate AS d, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY l_shipdate")
def agg_minmax(e, t):
    return t("lineitem").group_by("l_shipdate").agg(col("l_shipdate").alias("d"), f.min("l_quantity").alias("low"), f.max("l_quantity").alias("high"))


@query("SELECT l_returnflag, round(avg(l_discount), 9) AS m FROM lineitem GROUP BY l_returnflag")
def agg_avg(e, t):
    return t("lineitem").group_by("l_returnflag").agg("l_returnflag", F.round(e.functions.call("average", "l_discount"), 9).alias("m"))


@query("SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_orderkey")
def agg_sum(e, t):
    return t("lineitem").group_by("l_orderkey").agg("l_orderkey", f.sum("l_linenumber").alias("s"))


@query("SELECT l_orderkey, CAST(product(l_linenumber) AS BIGINT) AS p FROM lineitem GROUP BY l_orderkey")
def agg_product(e, t):
    return t("lineitem").group_by("l_orderkey").agg("l_orderkey", f.product(col("l_linenumber").cast("long")).alias("p"))


@query("SELECT l_suppkey, bool_and(l_quantity > 1) AS every, bool_or(l_quantity > 49) AS some FROM lineitem GROUP BY l_suppkey")
def agg_bool(e, t):
    return t("lineitem").group_by("l_suppkey").agg("l_suppkey", f.bool_and(col("l_quantity") > 1).alias("every"), f.bool_or(col("l_quantity") > 49).alias("some"))


@query("""SELECT o_custkey, first(nullif(o_orderstatus, 'F') ORDER BY o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS head,
       last(nullif(o_orderstatus, 'F') ORDER BY o_orderkey) AS tail FROM orders GROUP BY o_custkey""")
def agg_first_last(e, t):
    status = f.null_if("o_orderstatus", F.lit("F"))
    return t("orders").group_by("o_custkey").agg("o_custkey", f.first(status, order="o_orderkey").alias("head"), f.last(status, ignore_nulls=False, order="o_orderkey").alias("tail"))


@query("SELECT o_custkey, string_agg(coalesce(nullif(o_orderstatus, 'F'), '-'), '' ORDER BY o_orderkey) AS path FROM orders GROUP BY o_custkey")
def agg_array(e, t):
    listed = f.array_agg(f.null_if("o_orderstatus", F.lit("F")), order="o_orderkey")
    return t("orders").group_by("o_custkey").agg("o_custkey", F.array_join(F.transform(listed, lambda x: F.coalesce(x, F.lit("-"))), "").alias("path"))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_rows(e, t):
    return t("customer").select("c_mktsegment", "c_nationkey").distinct()


@query("SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY c_mktsegment")
def count_distinct(e, t):
    return t("customer").group_by("c_mktsegment").agg("c_mktsegment", e.functions.call("count", "c_nationkey", distinct=True).alias("n"))


# Joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(e, t):
    return t("orders").join(t("customer")).on(col("o_custkey") == col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(e, t):
    return t("nation").cross_join(t("region")).select("n_name", "r_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(e, t):
    return t("customer").left_join(t("orders")).on(col("c_custkey") == col("o_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 2000")
def join_right(e, t):
    return t("orders").right_join(t("customer")).on((col("c_custkey") == col("o_custkey")) & (col("o_totalprice") > 2000)).select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey + 50")
def join_full(e, t):
    return t("supplier").outer_join(t("customer")).on(col("s_suppkey") == col("c_custkey") + 50).select("s_suppkey", "c_custkey")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def join_theta(e, t):
    a, b = t("nation").subquery("a"), t("nation").subquery("b")
    return a.join(b).on((col("a.n_nationkey") < col("b.n_nationkey")) & (col("a.n_regionkey") == col("b.n_regionkey"))).select(col("a.n_name").alias("a"), col("b.n_name").alias("b"))


@query("SELECT a.c_custkey AS k, b.c_acctbal AS balance FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey WHERE b.c_acctbal > 0")
def join_self(e, t):
    c = t("customer")
    return c.subquery("a").join(c.subquery("b")).on(col("a.c_custkey") == col("b.c_custkey")).filter(col("b.c_acctbal") > 0).select(col("a.c_custkey").alias("k"), col("b.c_acctbal").alias("balance"))


@query("""SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def join_multi(e, t):
    joined = t("lineitem").join(t("orders")).on(col("l_orderkey") == col("o_orderkey")).join(t("customer")).on(col("o_custkey") == col("c_custkey"))
    joined = joined.join(t("nation")).on(col("c_nationkey") == col("n_nationkey")).join(t("region")).on(col("n_regionkey") == col("r_regionkey"))
    return joined.group_by("r_name").agg("r_name", f.count().alias("n"), F.round(f.sum(col("l_extendedprice") * (1 - col("l_discount"))), 2).alias("revenue"))


# Order and limits


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY nullif(o_orderstatus, 'F') DESC NULLS FIRST, o_orderkey")
def sort_null_order(e, t):
    return t("orders").select("o_orderkey", f.null_if("o_orderstatus", F.lit("F")).alias("s")).order_by(f.desc("s"), "o_orderkey")


@query("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def sort_hidden(e, t):
    return t("customer").order_by(f.desc("c_acctbal"), "c_custkey").select("c_name").limit(20)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def limit_sorted(e, t):
    return t("orders").order_by("o_totalprice", "o_orderkey").limit(40).limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def top_k(e, t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").top(10, f.desc("l_extendedprice"), "l_orderkey", "l_linenumber")


# Multiset operations


def _keys(t):
    return t("customer").select(col("c_nationkey").alias("k")), t("supplier").select(col("s_nationkey").alias("k"))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(e, t):
    a, b = _keys(t)
    return a.union(b)


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(e, t):
    a, b = _keys(t)
    return a.intersect(b)


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(e, t):
    a, b = _keys(t)
    return a.difference(b)


@query("SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation UNION ALL SELECT c_custkey FROM customer")
def setop_widen(e, t):
    return t("nation").select(col("n_nationkey").alias("k")).union(t("customer").select(col("c_custkey").alias("k")))


# Windows


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders")
def win_rows(e, t):
    w = Window.partition_by("o_custkey").order_by("o_orderkey").rows_between(-2, 0)
    return t("orders").select("o_orderkey", F.round(f.sum("o_totalprice").over(w.spec), 2).alias("moving"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near FROM orders")
def win_range(e, t):
    w = Window.partition_by("o_custkey").order_by("o_orderkey").range_between(-500, 500)
    return t("orders").select("o_orderkey", f.count().over(w.spec).alias("near"))


@query("SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most FROM orders")
def win_partition_only(e, t):
    return t("orders").select("o_orderkey", f.max("o_totalprice").over(Window.partition_by("o_custkey").spec).alias("most"))


@query("SELECT event_id, count(*) OVER w AS seen, min(event_id) OVER w AS head FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def win_named(e, t):
    w = Window.partition_by("user_id").order_by("event_id")
    return t("events").select("event_id", f.count().over(w.spec).alias("seen"), f.min("event_id").over(w.spec).alias("head"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events")
def win_refine(e, t):
    w = Window.partition_by("user_id").order_by("event_id").refine(frame=("rows", UNBOUNDED_PRECEDING, 0))
    return t("events").select("event_id", f.count().over(w.spec).alias("seen"))


@query("SELECT o_custkey, o_orderstatus, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_custkey) AS BIGINT) AS total FROM orders GROUP BY o_custkey, o_orderstatus")
def win_over_group(e, t):
    made = t("orders").group_by("o_custkey", "o_orderstatus").agg("o_custkey", "o_orderstatus", f.count().alias("n"))
    return made.select("*", f.sum("n").over(Window.partition_by("o_custkey").spec).alias("total"))


@query("SELECT o_orderkey FROM orders ORDER BY count(*) OVER (PARTITION BY o_custkey) DESC, o_orderkey LIMIT 30")
def win_in_order_by(e, t):
    return t("orders").order_by(f.desc(f.count().over(Window.partition_by("o_custkey").spec)), "o_orderkey").select("o_orderkey").limit(30)


# SQL text

FLAGSHIP = """
SELECT l_returnflag, l_linestatus, count(*) AS cnt, sum(l_quantity) AS sum_qty, round(avg(l_discount), 9) AS avg_disc
FROM lineitem WHERE l_quantity >= 10 GROUP BY l_returnflag, l_linestatus HAVING count(*) > 0 ORDER BY l_returnflag, l_linestatus
"""
text("sql_flagship", FLAGSHIP, "lineitem")
text("cte_simple", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 2000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey", "orders")
text("cte_multi", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT k FROM a WHERE n > 10) SELECT c_name FROM b JOIN customer ON k = c_custkey", "orders customer")
text("cte_cols", "WITH c(key) AS (SELECT c_custkey, c_name FROM customer) SELECT key, c_name FROM c", "customer")
text("cte_nested", "WITH c AS (SELECT 1 AS x) SELECT z.x AS inner_x, c.x AS outer_x FROM (WITH c AS (SELECT 2 AS x) SELECT x FROM c) z, c", "region")
text("sql_power", "SELECT p_partkey, p_size ^ 2 + 1 AS v, 2 ^ 3 ^ 2 AS w FROM part", "part")
text("sql_concat", "SELECT p_partkey, p_brand || nullif(p_type, p_type) || '-' || p_name AS label FROM part", "part", "SELECT p_partkey, concat(p_brand, nullif(p_type, p_type), '-', p_name) AS label FROM part")
text("sql_case_lists", "SELECT p_partkey, CASE p_size WHEN 1, 2 THEN 'a' WHEN > 40 THEN 'b' ELSE 'c' END AS class FROM part", "part", ORACLE_SQL["case_simple_multi"])
text("sql_window_refine", "SELECT event_id, count(*) OVER w1 AS seen FROM events WINDOW w0 AS (PARTITION BY user_id ORDER BY event_id), w1 AS (w0 ROWS UNBOUNDED PRECEDING)", "events", ORACLE_SQL["win_refine"])
text("sql_order_by_aggregate", "SELECT l_suppkey FROM lineitem GROUP BY l_suppkey ORDER BY count(*) DESC, l_suppkey LIMIT 10", "lineitem")
text("sql_global_in_order", "SELECT 1 AS one FROM orders ORDER BY count(o_orderkey)", "orders")
text("sql_order_by_window", "SELECT o_orderkey FROM orders ORDER BY count(*) OVER (PARTITION BY o_custkey) DESC, o_orderkey LIMIT 30", "orders")
text("sql_null_order", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s DESC, o_orderkey", "orders", ORACLE_SQL["sort_null_order"])
text("sql_union_bag", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier", "customer supplier", ORACLE_SQL["union_all"])
text("sql_set_precedence", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey AS k FROM supplier", "nation customer supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT n_nationkey AS k FROM nation INTERSECT ALL SELECT s_nationkey AS k FROM supplier")
text("sql_average_product", "SELECT l_orderkey, round(average(l_quantity), 6) AS m, CAST(product(l_linenumber) AS DOUBLE) AS p FROM lineitem GROUP BY l_orderkey", "lineitem", "SELECT l_orderkey, round(avg(l_quantity), 6) AS m, product(l_linenumber) AS p FROM lineitem GROUP BY l_orderkey")
text("sql_if", "SELECT p_partkey, IF(nullif(p_size, 5) > 20, 1, 0) AS flag FROM part", "part", ORACLE_SQL["if_expr"])
text("sql_literals", "SELECT r_regionkey, 'it''s' AS s, U&'d!0061ta' UESCAPE '!' AS u, 1.5 AS d /* kept */ FROM region -- end", "region", "SELECT r_regionkey, 'it''s' AS s, 'data' AS u, CAST(1.5 AS DOUBLE) AS d FROM region")
text("sql_window_over_group", "SELECT o_custkey, max(avg(o_totalprice)) OVER (PARTITION BY o_custkey) AS m FROM orders GROUP BY o_custkey, o_orderstatus", "orders", "SELECT o_custkey, max(avg(o_totalprice)) OVER (PARTITION BY o_custkey) AS m FROM orders GROUP BY o_custkey, o_orderstatus")


# What depends on types, composes, or serves over windows


@query("SELECT l_orderkey, l_linenumber, CAST(product(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS BIGINT) AS p FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def win_product(e, t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber").distinct()
    running = Window.partition_by("l_orderkey").order_by("l_linenumber").rows_between(UNBOUNDED_PRECEDING, 0)
    return lines.select("l_orderkey", "l_linenumber", f.product(col("l_linenumber").cast("bigint")).over(running).alias("p"))


@query("SELECT o_orderkey, CAST(len(array_agg(o_orderkey) OVER (PARTITION BY o_custkey)) AS BIGINT) AS n, list_sum(array_agg(o_orderkey) OVER (PARTITION BY o_custkey)) AS total FROM orders")
def win_array_agg(e, t):
    keys = f.array_agg("o_orderkey").over(Window.partition_by("o_custkey"))
    total = F.aggregate(keys, F.lit(0).cast("bigint"), lambda a, v: a + v)
    return t("orders").select("o_orderkey", F.size(keys).cast("bigint").alias("n"), total.alias("total"))


@query("SELECT p_brand, sum(p_partkey // p_size) AS q, sum(coalesce(length(p_name), 0) + 1) AS c FROM part GROUP BY p_brand")
def sum_of_quotients(e, t):
    return t("part").group_by("p_brand").agg("p_brand", f.sum(f.divide("p_partkey", "p_size")).alias("q"), f.sum(f.coalesce(f.length("p_name"), 0) + 1).alias("c"))


@query("SELECT o_custkey, sum(o_orderkey) AS s, max(o_orderkey) AS m, avg(o_totalprice) IS NOT NULL AS some FROM orders GROUP BY o_custkey")
def user_aggregates(e, t):
    zero = F.lit(0).cast("bigint")
    total = f.aggregate("o_orderkey", zero, lambda s, v: s + v, lambda a, b: a + b)
    most = f.aggregate("o_orderkey", F.lit(None).cast("bigint"), lambda s, v: F.greatest(s, v), lambda a, b: F.greatest(a, b))
    seen = f.aggregate("o_totalprice", F.lit(False), lambda s, v: s | v.isNotNull(), lambda a, b: a | b)
    return t("orders").group_by("o_custkey").agg("o_custkey", total.alias("s"), most.alias("m"), seen.alias("some"))


@query("SELECT r_name, regexp_full_match(r_name, '[A-Z ]+') AS whole, regexp_full_match(r_name || chr(10), '[A-Z ]+') AS broken FROM region")
def rlike_line_end(e, t):
    return t("region").select("r_name", f.rlike("r_name", "[A-Z ]+").alias("whole"), f.rlike(f.concat("r_name", F.lit("\n")), "[A-Z ]+").alias("broken"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL")
def null_safe_equal(e, t):
    both = t("customer").left_join(t("orders")).on(col("c_custkey") == col("o_custkey"))
    return both.filter(f.null_if("o_orderstatus", F.lit("F")).eqNullSafe(F.lit(None))).select("c_custkey", "o_orderkey")


text("sql_int_div", "SELECT p_partkey, p_partkey / p_size AS q, -p_size / 4 AS r, p_retailprice / 2 AS h FROM part WHERE p_partkey / 3 > 5", "part", "SELECT p_partkey, p_partkey // p_size AS q, CAST(trunc(-p_size / 4) AS INT) AS r, p_retailprice / 2 AS h FROM part WHERE p_partkey // 3 > 5")
text("sql_bool_strings", "SELECT r_regionkey, CAST(CASE WHEN r_regionkey < 2 THEN 'on' WHEN r_regionkey < 4 THEN 'N' END AS BOOLEAN) AS b FROM region", "region", "SELECT r_regionkey, CASE WHEN r_regionkey < 2 THEN TRUE WHEN r_regionkey < 4 THEN FALSE END AS b FROM region")
text("sql_length_array", "SELECT p_partkey, length(array(p_size, p_partkey)) AS a, length(p_name) AS s FROM part", "part", "SELECT p_partkey, 2 AS a, length(p_name) AS s FROM part")
text("sql_registered", "SELECT o_custkey, price_range(o_totalprice) AS r FROM orders GROUP BY o_custkey", "orders", "SELECT o_custkey, max(o_totalprice) - min(o_totalprice) AS r FROM orders GROUP BY o_custkey", price_range=lambda x: f.max(x) - f.min(x))
text("sql_over_named", "SELECT event_id, max(event_id) OVER (w0) AS m, sum(event_id) OVER w0 / 2 AS h FROM events WINDOW w0 AS (PARTITION BY user_id)", "events", "SELECT event_id, max(event_id) OVER (PARTITION BY user_id) AS m, CAST(sum(event_id) OVER (PARTITION BY user_id) // 2 AS BIGINT) AS h FROM events")
text("sql_is_not_true", "SELECT o_orderkey FROM orders WHERE (nullif(o_orderstatus, 'F') = 'O') IS NOT TRUE", "orders")
text("sql_win_product", "SELECT DISTINCT l_orderkey, product(l_linenumber) OVER (PARTITION BY l_orderkey) AS p FROM (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem) d", "lineitem", "SELECT l_orderkey, CAST(product(l_linenumber) AS BIGINT) AS p FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey")


def _rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).parquet(sf_dir, "nation").select("n_nationkey", f.rand(7).alias("r")).df


QUERIES["rand_seeded"] = _rand  # no SQL: generators differ


def _lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    return engine.lift([(1, "a"), (2, None)], "i INT, s STRING").union(engine.values(F.lit(3).cast("int").alias("i"), F.lit("c").alias("s"))).df


QUERIES["lift_values"] = _lifted
ORACLE_SQL["lift_values"] = "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) t(i, s)"
