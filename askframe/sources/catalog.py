"""The schema catalog: three DataFrames for tables, columns and foreign keys, from JSON or from Parquet schemas.

tables(db_id, table_idx, table_name); columns(db_id, col_idx, table_idx, col_name, col_type, is_pk), where col_idx counts all
columns of a database from 1, number 0 being the virtual ``*``; fks(db_id, src_col_idx, dst_col_idx).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import table

TABLES = "db_id string, table_idx int, table_name string"
COLUMNS = "db_id string, col_idx int, table_idx int, col_name string, col_type string, is_pk boolean"
FKS = "db_id string, src_col_idx int, dst_col_idx int"

#: The foreign keys and keys of the star schema.
STAR_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id", "documents": "doc_id", "labels": None}
STAR_FKS = (
    ("lineitem.l_orderkey", "orders.o_orderkey"), ("lineitem.l_partkey", "part.p_partkey"), ("lineitem.l_suppkey", "supplier.s_suppkey"),
    ("orders.o_custkey", "customer.c_custkey"), ("customer.c_nationkey", "nation.n_nationkey"), ("supplier.s_nationkey", "nation.n_nationkey"),
    ("nation.n_regionkey", "region.r_regionkey"), ("labels.doc_id", "documents.doc_id"),
)


@dataclass
class Catalog:
    tables: DataFrame
    columns: DataFrame
    fks: DataFrame

    def of(self, db_id: str) -> Catalog:
        """One database; an unknown one raises KeyError."""
        if self.tables.where(F.col("db_id") == db_id).isEmpty():
            raise KeyError(db_id)
        return Catalog(*(d.where(F.col("db_id") == db_id) for d in (self.tables, self.columns, self.fks)))

    def databases(self) -> list[str]:
        return [r[0] for r in self.tables.select("db_id").distinct().orderBy("db_id").collect()]

    def named(self) -> DataFrame:
        """Columns with their table's name."""
        return self.columns.join(self.tables, ["db_id", "table_idx"])


def read_json(spark: SparkSession, path: str) -> Catalog:
    """A JSON array of databases, each with table names, [table, name] pairs, types, key ids and key pairs."""
    fields = [("db_id", "string"), ("table_names_original", "array<string>"), ("column_names_original", "array<array<string>>"), ("column_types", "array<string>"), ("primary_keys", "array<int>"), ("foreign_keys", "array<array<int>>")]
    raw = spark.read.schema(", ".join(f"{n} {t}" for n, t in fields)).option("multiLine", True).json(path)
    return from_entries(raw)


def from_entries(raw: DataFrame) -> Catalog:
    """The catalog of rows as in the JSON: ids are places in the lists, a missing type is TEXT, ``*`` is left out but counted."""
    tables = raw.select("db_id", F.posexplode("table_names_original").alias("table_idx", "table_name"))
    types, keys = F.coalesce("column_types", F.array().cast("array<string>")), F.coalesce("primary_keys", F.array().cast("array<int>"))
    cols = raw.select("db_id", types.alias("types"), keys.alias("keys"), F.posexplode("column_names_original").alias("col_idx", "pair"))
    cols = cols.select("db_id", "col_idx", F.col("pair")[0].cast("int").alias("table_idx"), F.col("pair")[1].alias("col_name"), F.upper(F.coalesce(F.get("types", F.col("col_idx")), F.lit("TEXT"))).alias("col_type"), F.array_contains("keys", F.col("col_idx")).alias("is_pk")).where("table_idx >= 0")
    fks = raw.select("db_id", F.explode(F.coalesce("foreign_keys", F.array().cast("array<array<int>>"))).alias("p")).select("db_id", F.col("p")[0].alias("src_col_idx"), F.col("p")[1].alias("dst_col_idx"))
    return Catalog(tables, cols, fks)


def _type_name(t: T.DataType) -> str:
    names = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.StringType: "TEXT", T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP", T.BooleanType: "BOOLEAN"}
    return "DECIMAL" if isinstance(t, T.DecimalType) else names.get(type(t), "OTHERS")


def from_tables(spark: SparkSession, folder: str, db_id: str = "star", keys: dict[str, str | None] | None = None, fks: tuple[tuple[str, str], ...] = STAR_FKS) -> Catalog:
    """A catalog from the schemas of a folder's Parquet tables (footers only) and declared keys."""
    keys = STAR_KEYS if keys is None else keys
    tables, columns, place = [], [], {}
    for i, (name, key) in enumerate(keys.items()):
        tables.append((db_id, i, name))
        for f in table(spark, folder, name).schema:
            place[f"{name}.{f.name}"] = len(columns) + 1
            columns.append((db_id, len(columns) + 1, i, f.name, _type_name(f.dataType), f.name == key))
    edges = [(db_id, place[a], place[b]) for a, b in fks if a in place and b in place]
    return Catalog(spark.createDataFrame(tables, TABLES), spark.createDataFrame(columns, COLUMNS), spark.createDataFrame(edges, FKS))


def text_columns(columns: DataFrame) -> DataFrame:
    return columns.where((F.col("col_type") == "") | F.col("col_type").rlike("CHAR|TEXT|CLOB"))


def _quoted(name: Column) -> Column:
    return F.when(name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), name).otherwise(F.concat(F.lit('"'), name, F.lit('"')))


def render_ddl(catalog: Catalog, tables: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """(db_id, ddl): a CREATE TABLE for each table, in order; with ``tables`` (db_id, table_idx) or ``columns`` (db_id, col_idx)
    only those.  A foreign key is shown where its column and both its tables are."""
    shown = catalog.tables if tables is None else catalog.tables.join(tables.select("db_id", "table_idx").distinct(), ["db_id", "table_idx"], "left_semi")
    cols = catalog.columns if columns is None else catalog.columns.join(columns.select("db_id", "col_idx").distinct(), ["db_id", "col_idx"], "left_semi")
    cols = cols.join(shown, ["db_id", "table_idx"])
    line = F.concat(F.lit("  "), "col_name", F.lit(" "), "col_type", F.when(F.col("is_pk"), F.lit(" PRIMARY KEY")).otherwise(F.lit("")))
    lines = cols.select("db_id", "table_idx", F.struct(F.lit(0).alias("part"), F.col("col_idx").alias("at"), line.alias("text")).alias("line"))
    ends = cols.select("db_id", "col_idx", "table_idx", "col_name", "table_name")
    src = ends.select("db_id", F.col("col_idx").alias("src_col_idx"), "table_idx", F.col("col_name").alias("src"))
    dst = ends.select("db_id", F.col("col_idx").alias("dst_col_idx"), F.col("col_name").alias("dst"), F.col("table_name").alias("dst_table"))
    keys = catalog.fks.join(src, ["db_id", "src_col_idx"]).join(dst, ["db_id", "dst_col_idx"])
    foreign = F.concat(F.lit("  FOREIGN KEY ("), "src", F.lit(") REFERENCES "), "dst_table", F.lit("("), "dst", F.lit(")"))
    lines = lines.unionByName(keys.select("db_id", "table_idx", F.struct(F.lit(1).alias("part"), F.col("src_col_idx").alias("at"), foreign.alias("text")).alias("line")))
    bodies = lines.groupBy("db_id", "table_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["text"]), ",\n").alias("body"))
    made = shown.join(bodies, ["db_id", "table_idx"], "left").select("db_id", F.struct("table_idx", F.concat(F.lit("CREATE TABLE "), "table_name", F.lit(" (\n"), F.coalesce("body", F.lit("")), F.lit("\n);")).alias("text")).alias("t"))
    return made.groupBy("db_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["text"]), "\n\n").alias("ddl"))


def profile(catalog: Catalog) -> DataFrame:
    """(db_id, tables, columns, fks) for each database."""
    t = catalog.tables.groupBy("db_id").agg(F.count("*").alias("tables"))
    c = catalog.columns.groupBy("db_id").agg(F.count("*").alias("columns"))
    f = catalog.fks.groupBy("db_id").agg(F.count("*").alias("fks"))
    return t.join(c, "db_id", "left").join(f, "db_id", "left").select("db_id", "tables", F.coalesce("columns", F.lit(0)).alias("columns"), F.coalesce("fks", F.lit(0)).alias("fks"))
