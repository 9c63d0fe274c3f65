"""Scoring predictions against gold statements: by text, skeleton, clause and result.

samples: (index, db_id, question, predicted, gold).  Text metrics are columns; results are compared as bags by Spark.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import CLAUSES, LEVELS, cell_text, clauses, complexity, normalize, skeleton
from ..operators.topk import positions
from .execute import Executor


def text_scores(samples: DataFrame) -> DataFrame:
    """samples with complexity (of the gold statement), exact_match, skeleton_match, component_scores and component_present."""
    rows = samples.withColumns({"_p": normalize("predicted"), "_g": normalize("gold")})
    rows = rows.withColumns({"_pc": clauses("_p"), "_gc": clauses("_g")})
    scores = F.map_from_arrays(F.array(*[F.lit(c) for c in CLAUSES]), F.array(*[F.col("_pc")[c] == F.col("_gc")[c] for c in CLAUSES]))
    present = F.map_from_arrays(F.array(*[F.lit(c) for c in CLAUSES]), F.array(*[F.col("_gc")[c] != "" for c in CLAUSES]))
    rows = rows.withColumns({"complexity": complexity("gold"), "exact_match": F.col("_p") == F.col("_g"), "skeleton_match": skeleton("predicted") == skeleton("gold"), "component_scores": scores, "component_present": present})
    return rows.drop("_p", "_g", "_pc", "_gc")


def _cells(df: DataFrame) -> DataFrame:
    kinds = [t for _, t in df.dtypes]
    df = df.toDF(*[f"c{i}" for i in range(len(kinds))])
    return df.select(F.array(*[cell_text(f"c{i}", k) for i, k in enumerate(kinds)]).alias("row"))


def same_rows(left: DataFrame, right: DataFrame, ordered: bool = False) -> bool:
    """Whether two results hold the same rows as often, cells compared as trimmed lower-case text.

    Bags are compared by counting: a row counts up on the left and down on the right, and nothing may be left over.  In
    order, the rows of both are numbered and joined by place.  Without columns in common they are equal only if both are
    empty.
    """
    if len(left.columns) != len(right.columns):
        return left.isEmpty() and right.isEmpty()
    a, b = _cells(left), _cells(right)
    if ordered:
        both = positions(a).join(positions(b).withColumnRenamed("row", "other"), "pos", "full")
        return both.where(~F.col("row").eqNullSafe(F.col("other"))).isEmpty()
    both = a.withColumn("n", F.lit(1)).unionByName(b.withColumn("n", F.lit(-1)))
    return both.groupBy("row").agg(F.sum("n").alias("n")).where("n <> 0").isEmpty()


def is_ordered(sql: str) -> bool:
    """Whether the outermost query has an ORDER BY."""
    depth, flat = 0, []
    for ch in re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"", "''", sql):
        depth += (ch == "(") - (ch == ")")
        if depth == 0:
            flat.append(ch)
    return bool(re.search(r"(?i)\border\s+by\b", "".join(flat)))


def execution_match(executor: Executor, predicted: str, gold: str, db_id: str, ordered: bool | None = None, legacy: bool = False) -> tuple[bool, str]:
    """Whether both statements run and give the same rows, and the prediction's error if it has one.

    ``ordered`` None takes the order to count where the gold statement orders; ``legacy`` compares unordered and capped rows.
    """
    order = False if legacy else is_ordered(gold) if ordered is None else ordered

    def compare() -> bool:
        left, right = executor.frame(predicted, db_id), executor.frame(gold, db_id)
        if legacy:
            left, right = left.limit(executor.most_rows), right.limit(executor.most_rows)
        return same_rows(left, right, order)

    same, error = executor.timed(compare, predicted)
    if error is None:
        return bool(same), ""
    p = executor.execute(predicted, db_id)  # one of the two failed: which?
    return False, "" if p.success else p.short_error()


def score(spark: SparkSession, samples: DataFrame, executor: Executor | None = None, legacy: bool = False, at_once: int = 4) -> DataFrame:
    """All scores.  Each pair of statements is one distributed comparison; ``at_once`` of them run at a time."""
    rows = text_scores(samples)
    if executor is None:
        return rows.withColumns({"exec_match": F.lit(False), "error_msg": F.lit("")})
    pairs = samples.select("index", "db_id", "predicted", "gold").collect()
    for db_id in dict.fromkeys(r["db_id"] for r in pairs):
        executor.session(db_id)  # before threads ask for it
    with ThreadPoolExecutor(at_once) as pool:
        ran = list(pool.map(lambda r: (r["index"], *execution_match(executor, r["predicted"], r["gold"], r["db_id"], legacy=legacy)), pairs))
    return rows.join(spark.createDataFrame(ran, "index int, exec_match boolean, error_msg string"), "index")


def overall(scores: DataFrame) -> DataFrame:
    """(total, exact_match_acc, exec_acc, skeleton_acc)."""
    return scores.agg(F.count("*").alias("total"), *[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(n) for c, n in (("exact_match", "exact_match_acc"), ("exec_match", "exec_acc"), ("skeleton_match", "skeleton_acc"))])


def by_clause(scores: DataFrame) -> DataFrame:
    """(clause, accuracy, accuracy_present): over all samples, and over those whose gold statement has the clause."""
    rows = scores.select("component_present", F.explode("component_scores").alias("clause", "ok")).withColumn("present", F.element_at("component_present", F.col("clause")))
    return rows.groupBy("clause").agg(F.avg(F.col("ok").cast("double")).alias("accuracy"), F.avg(F.when(F.col("present"), F.col("ok").cast("double"))).alias("accuracy_present"))


def by_complexity(scores: DataFrame) -> DataFrame:
    """(complexity, n, em, ex)."""
    return scores.groupBy("complexity").agg(F.count("*").alias("n"), F.avg(F.col("exact_match").cast("double")).alias("em"), F.avg(F.col("exec_match").cast("double")).alias("ex"))


def metrics(scores: DataFrame) -> DataFrame:
    """One row with everything: overall figures, a map by clause and a map by complexity."""
    c = by_clause(scores).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("clause", "accuracy")))).alias("component_acc"))
    x = by_complexity(scores).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("complexity", F.struct("em", "ex").alias("v"))))).alias("by_complexity"))
    return overall(scores).crossJoin(c).crossJoin(x)


def summary(scores: DataFrame) -> str:
    """The figures as text."""
    o = overall(scores).first()
    lines = [f"samples {o['total']}: exact {o['exact_match_acc']:.1%}, execution {o['exec_acc']:.1%}, skeleton {o['skeleton_acc']:.1%}"]
    levels = {r["complexity"]: r for r in by_complexity(scores).collect()}
    lines += [f"{x}: exact {levels[x]['em']:.1%}, execution {levels[x]['ex']:.1%} of {levels[x]['n']}" for x in LEVELS if x in levels]
    lines += [f"{r['clause']}: {r['accuracy']:.1%}" for r in by_clause(scores).orderBy("clause").collect()]
    return "\n".join(lines)


def rescore_translated(samples: DataFrame, names: DataFrame) -> DataFrame:
    """samples with both statements translated, and the originals kept beside them."""
    from .translate import translate_statements

    p = translate_statements(samples, names, "predicted").withColumnRenamed("translated", "predicted_en")
    both = translate_statements(p, names, "gold").withColumnRenamed("translated", "gold_en")
    scored = text_scores(both.select("index", "db_id", "question", F.col("predicted_en").alias("predicted"), F.col("gold_en").alias("gold")))
    return samples.join(scored.withColumnsRenamed({"predicted": "predicted_en", "gold": "gold_en"}).drop("db_id", "question"), "index")
