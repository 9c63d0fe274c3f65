"""Files in and out: questions, gold statements, results, logs, identifier maps, embedding caches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import content_hash

PREDICTION = "index long, db_id string, question string, predicted string, gold string, exact_match boolean, exec_match boolean, skeleton_match boolean, component_scores map<string,boolean>, complexity string, error_msg string"


def read_questions(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(index, db_id, question, query) of a JSON array, in the file's order; with ``first`` only so many."""
    rows = spark.read.schema("db_id string, question string, query string").option("multiLine", True).json(path)
    rows = rows.withColumn("index", F.monotonically_increasing_id()).select("index", "db_id", "question", "query")
    return rows if first is None else rows.orderBy("index").limit(first)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(sql, db_id) of lines ``sql<TAB>db_id``: split at the last tab; blank lines go."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim(F.regexp_extract("value", r"^(.*?)(?:\t([^\t]*))?$", 1)).alias("sql"), F.trim(F.regexp_extract("value", r"\t([^\t]*)$", 1)).alias("db_id"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The predictions of written results."""
    return spark.read.schema(PREDICTION).json(f"{path}/predictions")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of written results."""
    return spark.read.json(f"{path}/metrics")


def write_results(scores: DataFrame, metrics: DataFrame, path: str) -> None:
    """``path``/predictions as JSON lines, written by as many tasks as there are, and ``path``/metrics, one line."""
    scores.write.mode("overwrite").json(f"{path}/predictions")
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")


def write_checkpoint(predictions: DataFrame, path: str, batch: int) -> None:
    """The predictions of a batch, each batch in a folder of its own, so that a repeated one replaces itself."""
    predictions.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def append_log(records: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    records.write.mode("append").json(path)


def merge_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """UNION ALL of JSON arrays by column name; files that are missing are left out."""
    from .tables import _exists

    found = [spark.read.option("multiLine", True).json(p) for p in paths if _exists(spark, p)]
    if not found:
        raise FileNotFoundError(", ".join(paths))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def write_map(identifiers: DataFrame, path: str) -> None:
    """An identifier map (db_id, kind, source, target) as JSON lines."""
    identifiers.coalesce(1).write.mode("overwrite").json(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("db_id string, kind string, source string, target string").json(path)


class EmbeddingCache:
    """Embeddings as Parquet under the hash of their texts and of the model that made them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def key(self, texts: list[str], model: str) -> str:
        row = self.spark.createDataFrame([(texts,)], "t array<string>").select(content_hash("t", model).alias("h")).first()
        return row["h"]

    def get(self, name: str, texts: list[str], model: str) -> DataFrame | None:
        from .tables import _exists

        path = f"{self.folder}/{name}/{self.key(texts, model)}"
        return self.spark.read.parquet(path) if _exists(self.spark, f"{path}/_SUCCESS") else None

    def put(self, name: str, texts: list[str], model: str, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}/{self.key(texts, model)}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def invalidate(self, name: str) -> None:
        remove(self.spark, f"{self.folder}/{name}")
