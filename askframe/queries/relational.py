"""The query surface: projections, filters, joins, aggregates, order, set operations and scalars over the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


# --- projections and filters ---------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def sel_project(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def sel_distinct(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").distinct()


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_tax <> 0.0 AND l_linenumber <= 3")
def filter_cmp(spark, sf):
    return table(spark, sf, "lineitem").where((F.col("l_quantity") >= 45) & (F.col("l_discount") < 0.03) & (F.col("l_tax") != 0.0) & (F.col("l_linenumber") <= 3)).select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND NOT (o_totalprice < 1000)")
def filter_and_or_not(spark, sf):
    return table(spark, sf, "orders").where(((F.col("o_orderstatus") == "F") | (F.col("o_orderpriority") == "1-URGENT")) & ~(F.col("o_totalprice") < 1000)).select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def filter_in(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(spark, sf):
    return table(spark, sf, "part").where(F.col("p_size").between(10, 20)).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'")
def filter_like_ci(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").ilike("%RED%")).select("p_partkey", "p_name")


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NULL AS is_f, nullif(o_orderstatus, 'F') IS NOT NULL AS not_f FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS NOT NULL")
def filter_null(spark, sf):
    s = F.nullif(F.col("o_orderstatus"), F.lit("F"))
    return table(spark, sf, "orders").where(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).isNotNull()).select("o_orderkey", s.isNull().alias("is_f"), s.isNotNull().alias("not_f"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class FROM part")
def case_when(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large").alias("class"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def subq_scalar(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.crossJoin(orders.agg(F.avg("o_totalprice").alias("mean"))).where("o_totalprice > mean").select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def subq_correlated(spark, sf):
    orders = table(spark, sf, "orders")
    best = orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("o_totalprice"))
    return orders.join(best, ["o_custkey", "o_totalprice"]).select("o_orderkey", "o_custkey")


@query("SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n")
def derived_table(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("customers"))


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS n FROM per JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment")
def cte(spark, sf):
    per = table(spark, sf, "orders").where("o_totalprice > 200000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return per.join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.sum("n").alias("n"))


@query("WITH RECURSIVE steps AS (SELECT 1 AS n, 1 AS f UNION ALL SELECT n + 1, f * (n + 1) FROM steps WHERE n < 10) SELECT n, f FROM steps")
def cte_recursive(spark, sf):
    return spark.sql("WITH RECURSIVE steps(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM steps WHERE n < 10) SELECT n, f FROM steps")


# --- joins -----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_three_way(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


_LEFT = "SELECT c_custkey, o_orderkey FROM {} WHERE {}"


def _customers_with_orders(spark, sf, how):
    orders = table(spark, sf, "orders").where("o_totalprice > 250000").select("o_orderkey", "o_custkey")
    customers = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey")
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), how).select("c_custkey", "o_orderkey")


_SIDES = "(SELECT c_custkey FROM customer WHERE c_acctbal > 0) c {} JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 250000) o ON c_custkey = o_custkey"


@query("SELECT c_custkey, o_orderkey FROM " + _SIDES.format("LEFT"))
def join_left(spark, sf):
    return _customers_with_orders(spark, sf, "left")


@query("SELECT c_custkey, o_orderkey FROM " + _SIDES.format("RIGHT"))
def join_right(spark, sf):
    return _customers_with_orders(spark, sf, "right")


@query("SELECT c_custkey, o_orderkey FROM " + _SIDES.format("FULL"))
def join_full(spark, sf):
    return _customers_with_orders(spark, sf, "full")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf):
    return table(spark, sf, "region").crossJoin(table(spark, sf, "nation")).select("r_name", "n_name")


@query("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def join_theta(spark, sf):
    n = table(spark, sf, "nation")
    return n.alias("a").join(n.alias("b"), F.col("a.n_nationkey") < F.col("b.n_nationkey")).select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"))


@query("SELECT a.s_suppkey AS first_key, b.s_suppkey AS second_key FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def join_self(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return s.alias("a").join(s.alias("b"), (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))).select(F.col("a.s_suppkey").alias("first_key"), F.col("b.s_suppkey").alias("second_key"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_semi(spark, sf):
    rich = table(spark, sf, "orders").where("o_totalprice > 300000")
    return table(spark, sf, "customer").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50)")
def join_exists(spark, sf):
    return table(spark, sf, "supplier").join(table(spark, sf, "lineitem").where("l_quantity = 50"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS rows_all, count(nullif(o_orderstatus, 'F')) AS not_f FROM orders")
def agg_count(spark, sf):
    return table(spark, sf, "orders").agg(F.count("*").alias("rows_all"), F.count(F.nullif(F.col("o_orderstatus"), F.lit("F"))).alias("not_f"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority")
def agg_count_distinct(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_cents, round(avg(l_quantity), 4) AS avg_qty, min(l_shipdate) AS first_ship, max(l_extendedprice) AS max_price, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_sum_avg_min_max(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.sum(_cents("l_extendedprice")).alias("sum_cents"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.min("l_shipdate").alias("first_ship"), F.max("l_extendedprice").alias("max_price"), F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15")
def agg_group_having(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 15")


@query("SELECT count(*) AS n FROM orders HAVING count(*) > 10")
def agg_global_having(spark, sf):
    return table(spark, sf, "orders").agg(F.count("*").alias("n")).where("n > 10")


# --- order and limits ------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY status ASC NULLS FIRST, o_orderkey DESC LIMIT 50")
def order_nulls(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status")).orderBy(F.col("status").asc_nulls_first(), F.col("o_orderkey").desc()).limit(50)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 10")
def limit_offset(spark, sf):
    return table(spark, sf, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").offset(10).limit(20).select("p_partkey", "p_retailprice")


@query("SELECT (SELECT max(o_totalprice) FROM orders) AS by_max, (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 1) AS by_limit")
def top1_vs_max(spark, sf):
    orders = table(spark, sf, "orders").select("o_totalprice")
    return orders.agg(F.max("o_totalprice").alias("by_max")).crossJoin(orders.orderBy(F.desc("o_totalprice")).limit(1).select(F.col("o_totalprice").alias("by_limit")))


@query("SELECT p_brand, p_partkey, CAST(rk AS INTEGER) AS rk FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rk FROM part) WHERE rk <= 3")
def topk_per_column(spark, sf):
    from ..operators.topk import top_k_per_group

    return top_k_per_group(table(spark, sf, "part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 3, "rk").select("p_brand", "p_partkey", "rk")


# --- set operations --------------------------------------------------------------------------------------------------


def _keys(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").where("s_nationkey < 20").select(F.col("s_nationkey").alias("k"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier WHERE s_nationkey < 20")
def set_union(spark, sf):
    a, b = _keys(spark, sf)
    return a.union(b).distinct()


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier WHERE s_nationkey < 20")
def set_union_all(spark, sf):
    a, b = _keys(spark, sf)
    return a.union(b)


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey < 20")
def set_intersect(spark, sf):
    a, b = _keys(spark, sf)
    return a.intersect(b)


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 20")
def set_except(spark, sf):
    a, b = _keys(spark, sf)
    return a.subtract(b)


# --- scalars ---------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, CAST(length(p_name) AS INTEGER) AS len, substr(p_name, 2, 3) AS sub, trim('  ' || p_type || ' ') AS trimmed FROM part")
def scalar_strings(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"), F.length("p_name").alias("len"), F.substring("p_name", 2, 3).alias("sub"), F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("trimmed"))


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), '?') AS status, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level, ifnull(nullif(o_orderpriority, '5-LOW'), 'none') AS priority FROM orders")
def scalar_cast_coalesce(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("F")), F.lit("?")).alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("level"), F.ifnull(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), F.lit("none")).alias("priority"))


@query("SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS whole, p_size / nullif(p_size % 5, 0) AS ratio FROM part")
def scalar_int_division(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr("p_size div 7").cast("long").alias("whole"), F.try_divide(F.col("p_size").cast("double"), (F.col("p_size") % 5).cast("double")).alias("ratio"))
