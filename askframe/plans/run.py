"""Runs over question sets: predict, keep what is done, score, and write results; then score again in another language."""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine
from ..operators.retrieval import build_examples
from ..session import settle
from ..sources import files
from ..sources.catalog import read_json
from ..sources.tables import _exists
from . import config as configs
from . import evaluate
from .generate import ChatGenerator, SqlGenerator

PREDICTED = "index long, db_id string, question string, predicted string, gold string"


@dataclass
class Report:
    scores: DataFrame
    seconds: float
    samples: int
    failures: int

    def text(self) -> str:
        each = self.seconds / max(1, self.samples)
        return f"{evaluate.summary(self.scores)}\n{self.samples} questions in {self.seconds:.1f} s ({each:.2f} s each), {self.failures} without an answer"


def predict(engine: Engine, questions: DataFrame, folder: str, every: int = 10) -> tuple[DataFrame, int]:
    """Statements for questions (index, db_id, question, query), kept in batches of ``every``; batches that are there already
    are not asked again.  The number of questions that raised an error comes with them; their statement is empty."""
    spark, failures = engine.spark, 0
    asked = questions.select("index", "db_id", "question", "query").orderBy("index").collect()  # what one run asks is a driver's loop
    for number, start in enumerate(range(0, len(asked), every)):
        if _exists(spark, f"{folder}/batch={number}/_SUCCESS"):
            continue
        rows = []
        for r in asked[start : start + every]:
            try:
                sql = engine.ask(r["question"], r["db_id"]).sql
            except KeyError:
                sql, failures = "", failures + 1
            rows.append((r["index"], r["db_id"], r["question"], sql, r["query"]))
        files.write_checkpoint(spark.createDataFrame(rows, PREDICTED), folder, number)
    return files.read_checkpoint(spark, folder).drop("batch"), failures


def evaluate_questions(engine: Engine, questions: DataFrame, output: str, every: int = 10, legacy: bool = False) -> Report:
    """Predict, score and write ``output``/results; the kept batches go once the results are written."""
    began = time.time()
    samples, failures = predict(engine, questions, f"{output}/predictions", every)
    scores = evaluate.score(engine.spark, samples, engine.executor, legacy).cache()
    files.write_results(scores, evaluate.metrics(scores), f"{output}/results")
    count = scores.count()
    files.remove(engine.spark, f"{output}/predictions")
    return Report(scores, time.time() - began, count, failures)


def evaluate_translated(spark: SparkSession, output: str, names: DataFrame) -> DataFrame:
    """Score the written results again with translated identifiers, and write them to ``output``/results_translated."""
    samples = files.read_results(spark, f"{output}/results").select("index", "db_id", "question", "predicted", "gold")
    scored = evaluate.rescore_translated(samples, names)
    scored.write.mode("overwrite").json(f"{output}/results_translated")
    return scored


def generator(c: configs.Config) -> SqlGenerator | None:
    """The chat server that the settings name; without one the engine's templates answer."""
    if not c.llm_url:
        return None
    return ChatGenerator(c.llm_url, c.llm_model, c.llm_key, most_tokens=c.llm_max_tokens, temperature=c.llm_temperature, timeout=c.llm_timeout_seconds, attempts=c.llm_attempts)


def examples(spark: SparkSession, c: configs.Config) -> DataFrame | None:
    """The solved questions of the training set, ready for retrieval."""
    if not c.train_path:
        return None
    solved = files.read_questions(spark, c.train_path).withColumnRenamed("index", "id")
    return settle(build_examples(solved))


def main(arguments: list[str] | None = None) -> None:
    """Command line: --config FILE, --test-limit N, --legacy."""
    from ..session import build_session

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--config")
    p.add_argument("--test-limit", type=int)
    p.add_argument("--legacy", action="store_true")
    a = p.parse_args(arguments)
    c = configs.load(a.config, test_limit=a.test_limit)
    spark = build_session()
    catalog = read_json(spark, c.tables_path)
    engine = Engine(spark, catalog, {d: f"{c.database_dir}/{d}" for d in catalog.databases()}, generator(c), examples(spark, c), c)
    print(evaluate_questions(engine, files.read_questions(spark, c.dev_path, c.test_limit or None), c.output_dir, legacy=a.legacy).text())


if __name__ == "__main__":
    main()
