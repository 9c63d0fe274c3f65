"""Translating identifiers of a statement from one language's schema to another's."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import tokens
from ..session import ship


def build_map(source: DataFrame, target: DataFrame) -> DataFrame:
    """(db_id, kind, source, target): names of two catalogs' raw rows joined by place.  A name with blanks is also there in
    its joined form.  Where a name occurs twice in a database, the last place wins."""

    def names(raw):
        t = raw.select("db_id", F.lit("table").alias("kind"), F.posexplode("table_names_original").alias("pos", "name"))
        c = raw.select("db_id", F.lit("column").alias("kind"), F.posexplode("column_names_original").alias("pos", "pair")).select("db_id", "kind", "pos", F.col("pair")[1].alias("name")).where("name <> '*'")
        return t.unionByName(c)

    both = names(source).withColumnRenamed("name", "source").join(names(target).withColumnRenamed("name", "target"), ["db_id", "kind", "pos"])
    joined = both.where(F.col("source").contains(" ")).withColumn("source", F.translate("source", " ", "_"))
    return both.unionByName(joined).groupBy("db_id", "kind", "source").agg(F.max_by("target", "pos").alias("target"))


def translate(sql: str, names: dict[str, str]) -> str:
    """Identifiers outside of strings, the longest first; what is put in is not looked at again."""
    if not names:
        return sql
    order = sorted(names, key=lambda n: (-len(n), n))
    one = re.compile(r"(?<![\w])(?:" + "|".join(map(re.escape, order)) + r")(?![\w])", re.IGNORECASE)
    low = {k.lower(): v for k, v in names.items()}
    out, code = [], ""
    for t in [*tokens(sql), ""]:
        if t and t[0] not in "'\"`":
            code += t
        else:
            out += [one.sub(lambda m: low[m.group(0).lower()], code), t]
            code = ""
    return "".join(out)


def translate_statements(statements: DataFrame, names: DataFrame, sql: str = "sql") -> DataFrame:
    """statements (db_id, sql, ...) with ``translated``: the database's map travels with its statements, by a join."""
    ship(statements.sparkSession)
    def run(s: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([translate(a, dict(b) if b is not None else {}) for a, b in zip(s, m, strict=True)])

    udf = F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)
    one = names.dropDuplicates(["db_id", "source"])
    maps = one.groupBy("db_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "target")))).alias("names"))
    return statements.join(maps, "db_id", "left").withColumn("translated", udf(F.col(sql), F.col("names"))).drop("names")
