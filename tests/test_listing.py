"""Listings over trees of joins against the same statements run by Spark."""

from collections import Counter

import pytest

from askframe.plans.execute import Executor
from askframe.plans.listing import listing


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Names that repeat under several keys, keys and names that are null, rows that repeat, and keys without a partner."""
    at = str(tmp_path_factory.mktemp("shop"))
    tables = {
        "nation": ([(1, "A", 0), (2, "A", 0), (3, "B", 1), (4, None, 0), (5, None, 0), (6, "C", None), (None, "D", 0), (3, "B", 1)], "nk long, n_name string, rk long"),
        "region": ([(0, "x"), (1, "x"), (2, "y"), (1, "x"), (None, "z")], "r long, r_name string"),
        "customer": ([(k % 8 or None, f"c{k % 5}" if k % 7 else None) for k in range(60)], "ck long, c_name string"),
        "supplier": ([(k % 7, f"s{k % 4}") for k in range(40)], "sk int, s_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return Executor(spark, folders={"shop": at})


TREE = "FROM nation JOIN customer ON nation.nk = customer.ck JOIN supplier ON nation.nk = supplier.sk JOIN region ON nation.rk = region.r"


@pytest.mark.parametrize("shown", ["nation.n_name, customer.c_name, supplier.s_name, region.r_name", "customer.c_name, nation.n_name, customer.c_name", "nation.nk, supplier.s_name, nation.rk, customer.ck"])
def test_rows_are_those_of_the_statement(shop, shown):
    sql = f"SELECT DISTINCT {shown} {TREE}"
    own = shop.session("shop")[0]
    assert listing(own, sql) is not None
    want, got = own.sql(sql), shop.frame(sql, "shop")
    assert got.columns == want.columns and got.dtypes == want.dtypes
    rows = Counter(map(tuple, got.collect()))
    assert rows == Counter(map(tuple, want.collect())) and len(rows) > 5


def test_inner_tables_in_a_chain(shop):
    sql = "SELECT DISTINCT region.r_name, nation.n_name, customer.c_name FROM customer JOIN nation ON customer.ck = nation.nk JOIN region ON nation.rk = region.r JOIN supplier ON nation.nk = supplier.sk"
    assert Counter(map(tuple, shop.frame(sql, "shop").collect())) == Counter(map(tuple, shop.session("shop")[0].sql(sql).collect()))


def test_combinations_are_not_exchanged(shop):
    """All that is combined without a DISTINCT after it comes from the exchange of one outer table's rows."""
    plan = shop.frame(f"SELECT DISTINCT nation.n_name, customer.c_name, supplier.s_name {TREE}", "shop")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union") and not plan.split("\n")[1].lstrip(":+- ").startswith("Aggregate")


def test_other_statements_stay(shop):
    own = shop.session("shop")[0]
    for sql in (f"SELECT nation.n_name, customer.c_name {TREE}", f"SELECT DISTINCT customer.c_name, supplier.s_name {TREE}", f"SELECT DISTINCT nation.n_name {TREE} WHERE nation.nk = 1", "SELECT DISTINCT nation.n_name FROM nation JOIN customer ON nation.nk = customer.ck"):
        assert listing(own, sql) is None
