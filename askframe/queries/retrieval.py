"""Vector retrieval over the embeddings table; a vector's label stands for the skeleton of its example."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sqltext import content_hash
from ..operators import retrieval, topk
from ..sources.tables import table
from . import fixtures

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
K = 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _vector(spark, sf) -> list[float]:
    """The query vector: that of vec_id 0 (one row by key)."""
    return list(table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()["embedding"])


_SIM = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[])"
_NEAR = f"SELECT vec_id, label, round({_SIM}, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT {2 * K}"


@query(f"SELECT vec_id, label, round({_SIM}, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT {K}")
def vec_topk(spark, sf):
    return retrieval.top_k(table(spark, sf, "embeddings"), _vector(spark, sf), K, key="vec_id").select("vec_id", "label", "score")


@query(f"SELECT vec_id, round(0.7 * {_SIM} + 0.3 * list_cosine_similarity(list_reverse(embedding)::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT {K}")
def vec_hybrid_topk(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("other", F.reverse("embedding"))
    return retrieval.hybrid_top_k(rows, _vector(spark, sf), K, 0.7, 0.3, other="other", key="vec_id").select("vec_id", "score")


@query(f"SELECT vec_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM ({_NEAR})) WHERE r = 1 ORDER BY score DESC, vec_id LIMIT {K}")
def vec_dedup_topk(spark, sf):
    near = retrieval.top_k(table(spark, sf, "embeddings"), _vector(spark, sf), 2 * K, key="vec_id")
    return retrieval.distinct_top_k(near, "label", K, "vec_id").select("vec_id", "label", "score")


def _mmr_sql(k: int, weight: float = 0.7, factor: int = 5) -> str:
    """The greedy choice, unrolled: a step takes the row of the pool that is best by relevance less likeness to those taken."""
    steps = [f"pool AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, round({_SIM}, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT {factor * k})"]
    for n in range(1, k + 1):
        like = f"greatest(0, (SELECT max(list_cosine_similarity(p.e, c.e)) FROM s{n - 1} c))" if n > 1 else "0"
        step = f"SELECT vec_id, label, e, {n} AS rank FROM pool p" + (f" WHERE vec_id NOT IN (SELECT vec_id FROM s{n - 1})" if n > 1 else "") + f" ORDER BY {weight} * score - {1 - weight:g} * {like} DESC, score DESC, vec_id LIMIT 1"
        steps.append(f"s{n} AS (({step})" + (f" UNION ALL SELECT * FROM s{n - 1}" if n > 1 else "") + ")")
    return f"WITH {', '.join(steps)} SELECT vec_id, label, rank FROM s{k}"


@query(_mmr_sql(K))
def vec_mmr(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("skeleton", F.col("label").cast("string"))
    return retrieval.retrieve(rows, _vector(spark, sf), K, diverse=True, key="vec_id").select("vec_id", "label", "rank")


@query()
def few_shot_examples(spark, sf):
    """Solved questions from the inline predictions, retrieved for a question."""
    solved = fixtures.predictions(spark).select(F.col("index").alias("id"), "db_id", "question", F.col("gold").alias("query"))
    return retrieval.retrieve(retrieval.build_examples(solved), retrieval.embed_query(spark, "orders by segments"), 3).select("id", "question", "query", F.round("score", 6).alias("score"))


@query("SELECT doc_id, n_chars, CAST(sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents QUALIFY used <= 100000")
def budget_prefix(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return topk.budget_prefix(docs, [F.col("doc_id")], F.col("n_chars"), 100_000)


_BLOCKS = "SELECT label, vec_id // 1000 AS block, sha256('m1' || chr(31) || string_agg(CAST(vec_id AS VARCHAR), chr(31) ORDER BY vec_id)) AS hash FROM embeddings GROUP BY label, block"


@query(f"SELECT label, sha256('m1' || chr(31) || string_agg(hash, chr(31) ORDER BY block)) AS hash FROM ({_BLOCKS}) GROUP BY label")
def embedding_hash(spark, sf):
    """A hash of each label's members, by hashes of blocks of 1,000 ids, so that no task gathers all members."""
    rows = table(spark, sf, "embeddings").select("label", "vec_id", F.floor(F.col("vec_id") / 1000).alias("block"))
    blocks = rows.groupBy("label", "block").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    blocks = blocks.select("label", "block", content_hash(F.transform("ids", lambda x: x.cast("string")), "m1").alias("hash"))
    whole = blocks.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "hash"))), lambda x: x["hash"]).alias("hashes"))
    return whole.select("label", content_hash("hashes", "m1").alias("hash"))
