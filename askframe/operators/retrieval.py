"""Retrieval of similar solved examples by vector similarity, without repeats, optionally diverse."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import skeleton
from ..functions.text import mask_literals
from .topk import top_k_per_group
from .vectors import Embedder, hashed_embedding


def _similar(vector: str, query: list[float]) -> Column:
    """Cosine of a column with one vector, whose length is known beforehand."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = F.aggregate(F.zip_with(F.col(vector), q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    n = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = n * float(np.sqrt(sum(float(x) * float(x) for x in query)))
    return F.when(length == 0, F.lit(0.0)).otherwise(d / length)


def top_k(examples: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "id", score: str = "score") -> DataFrame:
    """The k nearest rows; ties by key.  A limit on an order, of which each task keeps k rows."""
    return examples.withColumn(score, F.round(_similar(vector, query), 6)).orderBy(F.desc(score), key).limit(k)


def hybrid_top_k(examples: DataFrame, query: list[float], k: int, alpha: float = 0.7, beta: float = 0.3, vector: str = "embedding", other: str = "skeleton_embedding", other_query: list[float] | None = None, key: str = "id") -> DataFrame:
    """The k best by alpha * similarity of questions + beta * similarity of skeletons."""
    both = alpha * _similar(vector, query) + beta * _similar(other, other_query or query)
    return examples.withColumn("score", F.round(both, 6)).orderBy(F.desc("score"), key).limit(k)


def distinct_top_k(ranked: DataFrame, same: str, k: int, key: str = "id") -> DataFrame:
    """Of ranked rows the best of each ``same``, then the first k."""
    return top_k_per_group(ranked, [same], [F.desc("score"), F.col(key)], 1, "_rank").drop("_rank").orderBy(F.desc("score"), key).limit(k)


def mmr(pool: DataFrame, query: list[float], k: int, weight: float = 0.7, vector: str = "embedding", key: str = "id", factor: int = 5) -> list[int]:
    """Maximal marginal relevance: keys of k rows, each the best by weight * relevance - (1 - weight) * likeness to those chosen.
    The factor * k nearest rows are ranked by Spark; the greedy choice among them is the driver's.  A pool of fewer rows gives all."""
    rows = top_k(pool, query, factor * k, vector, key).select(key, vector, "score").collect()
    if not rows:
        return []
    v = np.array([r[vector] for r in rows], float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    relevance, like, chosen = np.array([r["score"] for r in rows]), np.full(len(rows), -np.inf), []
    for _ in range(min(k, len(rows))):
        value = weight * relevance - (1 - weight) * (np.maximum(like, 0) if chosen else 0)
        value[chosen] = -np.inf
        chosen.append(int(np.argmax(value)))
        like = np.maximum(like, v @ v[chosen[-1]])
    return [rows[i][key] for i in chosen]


def build_examples(questions: DataFrame, embed: Embedder = hashed_embedding) -> DataFrame:
    """Solved questions (db_id, question, query) with literals masked, skeleton and embeddings, ready for a cache."""
    rows = questions.withColumn("question_masked", mask_literals("question")).withColumn("skeleton", skeleton("query"))
    return rows.withColumn("embedding", embed(F.col("question_masked"))).withColumn("skeleton_embedding", embed(F.col("skeleton")))


def embed_query(spark: SparkSession, question: str, embed: Embedder = hashed_embedding) -> list[float]:
    """A question masked and embedded as the examples are."""
    return list(spark.createDataFrame([(question,)], "q string").select(embed(mask_literals("q")).alias("e")).first()["e"])


def retrieve(examples: DataFrame, query: list[float], k: int = 10, alpha: float = 1.0, beta: float = 0.0, diverse: bool = False, key: str = "id") -> DataFrame:
    """The k best examples, one for each skeleton: of the 2k nearest, or by marginal relevance."""
    if diverse:
        order = mmr(examples, query, k, key=key)
        rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(key)) if order else F.lit(0)
        return examples.where(F.col(key).isin(order)).withColumn("rank", rank.cast("int")).orderBy("rank")
    near = hybrid_top_k(examples, query, 2 * k, alpha, beta, key=key) if beta else top_k(examples, query, 2 * k, key=key)
    return distinct_top_k(near, "skeleton", k, key)


def few_shot_block(examples: DataFrame, key: str = "id") -> str:
    """The examples as text, the best first."""
    rows = examples.orderBy(F.desc("score"), key).select("question", "query").collect()
    return "".join(f"-- Question: {r['question']}\n{r['query']}\n\n" for r in rows)
