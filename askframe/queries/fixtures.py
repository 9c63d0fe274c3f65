"""Small inline inputs of queries: questions, statements, predictions, graphs and maps, for tables that the data lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DB = "star"
QUESTIONS = (
    (1, DB, "How many orders for each customer?"),
    (2, DB, "List the region of every nation"),
    (3, DB, "Which customers are in the BUILDING or MACHINERY segment?"),
    (4, DB, "Orders with priority 1-URGENT placed after 1995-03-15"),
    (5, DB, "What is the largest o_totalprice of orders?"),
    (6, DB, "supplier and part of each lineitem with more than 30 l_quantity"),
    (7, DB, "How many parts are of type 'red ring'?"),
    (8, DB, "customers from the nation of suppliers"),
    (9, DB, "c_acctbal and c_name of customer"),
    (10, DB, "đơn_hàng của khách_hàng nào lớn nhất trong 2 năm"),
    (11, DB, "Show HOUSEHOLD customers by region in march 1996"),
    (12, DB, "How are you?"),
)
STATEMENTS = (
    (1, "select c_name from customer"),
    (2, "SELECT count(*) FROM orders WHERE o_orderstatus = 'F';"),
    (3, "select o_orderpriority , count(*) from orders group by o_orderpriority"),
    (4, "select c.c_name from customer c join orders o on c.c_custkey = o.o_custkey where o.o_totalprice > 1000.5"),
    (5, "select n_name , count(*) from customer join nation on c_nationkey = n_nationkey group by n_name having count(*) > 5 order by n_name limit 3"),
    (6, "select p_name from part where p_size = (select max(p_size) from part)"),
    (7, "select a from t1 join t2 on x = y join t3 on y = z join t4 on z = w"),
    (8, "select r_name from region join nation on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey"),
    (9, "select   avg(l_quantity)   from lineitem where l_returnflag like 'R' and l_tax between 0 and 0.05"),
    (10, "select s_name from supplier union select c_name from customer"),
    (11, "select distinct p_brand from part where p_type = 'x  y' or p_brand != \"Brand#1\" order by p_brand desc"),
    (12, "select case when p_size > 10 then 1 else 0 end as big from part"),
)
PREDICTIONS = (
    (1, DB, "regions", "select r_name from region", "SELECT r_name FROM region"),
    (2, DB, "segments", "select distinct c_mktsegment from customer order by c_mktsegment", "select c_mktsegment from customer group by c_mktsegment"),
    (3, DB, "orders", "select count(*) from orders where o_orderstatus = 'F'", "select count(*) from orders where o_orderstatus = 'O'"),
    (4, DB, "nothing", "select c_name from customer where c_custkey < 0", "select r_name , r_regionkey from region where r_regionkey < 0"),
    (5, DB, "failing", "select nope from customer", "select c_name from customer"),
    (6, DB, "types", "select 1.0", "select 1"),
    (7, DB, "nulls", "select null", "select 'none'"),
    (8, DB, "join", "select n_name from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'", "select n_name from nation where n_regionkey in (select r_regionkey from region where r_name = 'ASIA')"),
    (9, DB, "groups", "select n_regionkey , count(*) from nation group by n_regionkey", "select n_regionkey , count(*) from nation group by n_regionkey"),
)
#: A square (two shortest paths between opposite corners) with a tail, and a pair apart.
GRAPH = ((0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (5, 6))
#: Made-up maps and statements for translation.
MAP = (("arch", "table", "kiến_trúc_sư", "architect"), ("arch", "table", "nhà_máy", "mill"), ("arch", "column", "tên", "name"), ("arch", "column", "id kiến_trúc_sư", "architect_id"), ("arch", "column", "giới_tính", "gender"), ("arch", "column", "id", "id"))
VI_STATEMENTS = (
    (1, "arch", "select count ( * ) from kiến_trúc_sư where giới_tính = \"tên\""),
    (2, "arch", "select tên , id from kiến_trúc_sư order by tên"),
    (3, "arch", "select t1.tên from kiến_trúc_sư as t1 join nhà_máy as t2 on t1.id = t2.id kiến_trúc_sư"),
    (4, "none", "select tên from x"),
)
GENERATED = (
    (1, "```sql\nselect count(*) from customer\n```"),
    (2, "select c_name,c_custkey from customer where c_mktsegment = BUILDING order by c_name"),
    (3, "select a from t where a in (select b from c) and t.id in (select id from c) and t.id in (select id from c) and t.id in (select id from c)"),
    (4, "select * from t where x = 'it, is'   and y != male"),
)


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "question_id int, db_id string, question string")


def statements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATEMENTS, "sql_id int, sql string")


def predictions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PREDICTIONS, "index int, db_id string, question string, predicted string, gold string")


def values_sql(rows, names: str) -> str:
    """The rows as a SQL table expression."""

    def one(v):
        return str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({names}))"


QUESTIONS_SQL = values_sql(QUESTIONS, "question_id, db_id, question")
STATEMENTS_SQL = values_sql(STATEMENTS, "sql_id, sql")
