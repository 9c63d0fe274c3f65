"""Statistics of question sets and their alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import positions


def counts_top(rows: DataFrame, by: str, k: int = 10) -> DataFrame:
    """The k commonest values and their counts; ties by value."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)


def compare_sets(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(side, value): values of a column that only one side has, or both."""
    a, b = left.select(F.col(column).alias("value")).distinct(), right.select(F.col(column).alias("value")).distinct()
    only = [a.subtract(b).withColumn("side", F.lit("left")), b.subtract(a).withColumn("side", F.lit("right")), a.intersect(b).withColumn("side", F.lit("both"))]
    return only[0].unionByName(only[1]).unionByName(only[2]).select("side", "value")


def compare_splits(left: DataFrame, right: DataFrame, by: str = "db_id") -> DataFrame:
    """(value, n_left, n_right, ratio) for each value on either side."""
    a, b = left.groupBy(F.col(by).alias("value")).agg(F.count("*").alias("n_left")), right.groupBy(F.col(by).alias("value")).agg(F.count("*").alias("n_right"))
    both = a.join(b, "value", "full").select("value", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return both.withColumn("ratio", F.try_divide(F.col("n_left").cast("double"), F.col("n_right").cast("double")))


def align(left: DataFrame, right: DataFrame, order: str, check: str) -> DataFrame:
    """Rows of two sets of the same length by place: (pos, left_<order>, right_<order>, same), same telling whether ``check``
    agrees; ties in the order go by ``check``.  ValueError if the lengths differ."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} and {m} rows cannot be aligned")

    def placed(df: DataFrame, side: str) -> DataFrame:
        rows = df.select(F.col(order).alias(f"{side}_{order}"), F.col(check).alias(f"{side}_{check}"))
        return positions(rows.orderBy(*rows.columns))

    both = placed(left, "left").join(placed(right, "right"), "pos")
    return both.withColumn("same", F.col(f"left_{check}").eqNullSafe(F.col(f"right_{check}"))).drop(f"left_{check}", f"right_{check}")


def profile_questions(questions: DataFrame) -> DataFrame:
    """(questions, databases, mean_words, mean_sql_words) of a question set."""
    words = F.size(F.split(F.trim("question"), r"\s+"))
    return questions.agg(F.count("*").alias("questions"), F.countDistinct("db_id").alias("databases"), F.avg(words).alias("mean_words"), F.avg(F.size(F.split(F.trim("query"), r"\s+"))).alias("mean_sql_words"))
