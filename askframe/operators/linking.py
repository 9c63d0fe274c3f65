"""Linking questions to tables, columns, cell values, numbers and dates: joins over n-grams, for any number of questions.

Questions are a DataFrame (question_id, db_id, question).  Links are rows (question_id, db_id, kind, table_idx, col_idx,
match_type, score, span); kind is column, table, cell or num_date.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Segmenter, has_date, has_number, ngrams, normalise, question_tokens, tokens
from ..session import settle, ship
from ..sources.catalog import Catalog
from .topk import top_k_per_group
from .vectors import Embedder, cosine, hashed_embedding

MOST_WORDS = 5
FEW_NAMES = 20_000
EXACT, PARTIAL, CELL, NUM_DATE = 1.0, 0.8, 1.0, 0.8
SEMANTIC = 0.55
NUMERIC = ("NUMBER", "INT", "INTEGER", "FLOAT", "REAL", "DOUBLE", "DECIMAL")
DATES = ("DATE", "DATETIME", "TIME", "TIMESTAMP", "YEAR")


def question_grams(questions: DataFrame, most: int = MOST_WORDS, segment: Segmenter | None = None) -> DataFrame:
    """(question_id, db_id, n, pos, gram)."""
    return questions.select("question_id", "db_id", F.inline(ngrams(question_tokens("question", segment=segment), most)))


def _names(catalog: Catalog) -> DataFrame:
    """Tables and columns alike: (db_id, kind, table_idx, col_idx, name)."""
    t = catalog.tables.select("db_id", F.lit("table").alias("kind"), "table_idx", F.lit(None).cast("int").alias("col_idx"), F.col("table_name").alias("name"))
    c = catalog.columns.select("db_id", F.lit("column").alias("kind"), "table_idx", "col_idx", F.col("col_name").alias("name"))
    return t.unionByName(c)


def name_links(questions: DataFrame, catalog: Catalog, most: int = MOST_WORDS, segment: Segmenter | None = None) -> DataFrame:
    """Links by name: an n-gram of the question equals a name's words (exact) or some run of them (partial).

    Names are exploded into their own n-grams, so that containment at word boundaries is an equi-join too.  The best link
    of each name stays: exact before partial, then the longest and first span.
    """
    names = _names(catalog).withColumn("words", question_tokens("name", segment=segment))
    whole = F.array_join("words", " ")
    parts = names.select("db_id", "kind", "table_idx", "col_idx", whole.alias("whole"), F.explode(F.array_distinct(F.transform(ngrams("words", most), lambda g: g["gram"]))).alias("gram"))
    hits = question_grams(questions, most, segment).join(parts, ["db_id", "gram"])
    hits = hits.select("question_id", "db_id", "kind", "table_idx", "col_idx", F.when(F.col("gram") == F.col("whole"), "exact").otherwise("partial").alias("match_type"), F.when(F.col("gram") == F.col("whole"), EXACT).otherwise(PARTIAL).alias("score"), F.col("gram").alias("span"), "n", "pos")
    best = top_k_per_group(hits, ["question_id", "db_id", "kind", "table_idx", "col_idx"], [F.col("score").desc(), F.col("n").desc(), F.col("pos"), F.col("span")], 1, "_rank")
    return best.drop("_rank", "n", "pos")


def semantic_links(questions: DataFrame, catalog: Catalog, threshold: float = SEMANTIC, embed: Embedder = hashed_embedding) -> DataFrame:
    """Links by meaning: cosine of embeddings of question and name of at least ``threshold``.

    ``embed`` makes a vector column of a text column: a model over Arrow batches (``vectors.model_embedder``), a look-up, or the
    default, which hashes character n-grams and stands in for a model.  Names are broadcast where a count shows them to be few.
    """
    q = questions.select("question_id", "db_id", embed(F.col("question")).alias("q"))
    n = settle(_names(catalog).withColumn("v", embed(F.translate("name", "_", " "))))
    n = F.broadcast(n) if n.count() <= FEW_NAMES else n
    scored = q.join(n, "db_id").withColumn("score", cosine("q", "v")).where(F.col("score") >= threshold)
    return scored.select("question_id", "db_id", "kind", "table_idx", "col_idx", F.lit("semantic").alias("match_type"), "score", F.lit(None).cast("string").alias("span"))


def merge_links(named: DataFrame, semantic: DataFrame) -> DataFrame:
    """The best of both for each name; a semantic link must be strictly better than a named one."""
    both = named.withColumn("_own", F.lit(0)).unionByName(semantic.withColumn("_own", F.lit(1)))
    return top_k_per_group(both, ["question_id", "db_id", "kind", "table_idx", "col_idx"], [F.col("score").desc(), F.col("_own")], 1, "_rank").drop("_rank", "_own")


def num_date_links(questions: DataFrame, catalog: Catalog) -> DataFrame:
    """Numeric columns for questions with a number, date columns for those with a date."""
    q = questions.select("question_id", "db_id", has_number("question").alias("number"), has_date("question").alias("date")).where("number or date")
    c = catalog.columns.select("db_id", "table_idx", "col_idx", F.upper("col_type").isin(*NUMERIC).alias("numeric"), F.upper("col_type").rlike("|".join(DATES)).alias("dated")).where("numeric or dated")
    hit = q.join(c, "db_id").where("(number and numeric) or (date and dated)")
    return hit.select("question_id", "db_id", F.lit("num_date").alias("kind"), "table_idx", "col_idx", F.lit("num_date").alias("match_type"), F.lit(NUM_DATE).alias("score"), F.lit(None).cast("string").alias("span"))


# --- cell values ---------------------------------------------------------------------------------------------------


def fuzzy_ratio(left, right):
    """Similarity of two texts, 0 to 1, over batches."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR)(left, right)


def exact_values(questions: DataFrame, values: DataFrame, most: int = 6) -> DataFrame:
    """Values that stand in the question as whole words: an equi-join of the question's n-grams with normalised values."""
    grams = questions.select("question_id", "db_id", F.explode(F.array_distinct(F.transform(ngrams(F.filter(F.split(normalise("question"), r"\s+"), lambda t: t != ""), most), lambda g: g["gram"]))).alias("key"))
    v = values.withColumn("key", normalise("value")).where("key <> ''")
    return grams.join(v, ["db_id", "key"]).select("question_id", "db_id", "table_name", "col_name", "value", F.lit(1.0).alias("score"))


def partial_values(questions: DataFrame, values: DataFrame) -> DataFrame:
    """Values one of whose words is a token of the question, or that are a word of a longer token, without being exact."""
    q = questions.select("question_id", "db_id", F.explode(F.array_distinct(F.filter(tokens("question"), lambda t: F.length(t) > 2))).alias("word"))
    v = values.withColumn("key", normalise("value")).where("key <> ''").withColumn("word", F.explode(F.array_distinct(F.split("key", r"\s+"))))
    hit = q.join(v, ["db_id", "word"]).select("question_id", "db_id", "table_name", "col_name", "value").distinct()
    exact = exact_values(questions, values).select("question_id", "db_id", "table_name", "col_name", "value")
    return hit.join(exact, hit.columns, "left_anti").withColumn("score", F.lit(PARTIAL))


def legacy_values(questions: DataFrame, values: DataFrame) -> DataFrame:
    """The substring rule: a value anywhere in the question's text scores 1, one that holds or is held by a token of more than
    two letters 0.8.  It makes any short value a hit, and compares each question with every value of its database; kept to
    reproduce old scores."""
    q = questions.select("question_id", "db_id", normalise("question").alias("text"), F.filter(tokens("question"), lambda t: F.length(t) > 2).alias("words"))
    v = values.withColumn("key", normalise("value")).where("key <> ''")
    near = F.exists("words", lambda t: t.contains(F.col("key")) | F.col("key").contains(t))
    scored = q.join(v, "db_id").withColumn("score", F.when(F.col("text").contains(F.col("key")), F.lit(1.0)).when(near, F.lit(PARTIAL)))
    return scored.where("score is not null").select("question_id", "db_id", "table_name", "col_name", "value", "score")


#: Letters of English and Vietnamese text from rare to common, roughly; others count as rarer still.  The order decides how
#: many candidates there are, not which are found.
_COMMON = "zwqjxfvkpybgmdclusrhntoiae "


def _letters(c: Column) -> Column:
    """A text's letters, each with the number of its occurrence, the rare ones first: equal multisets give equal arrays."""
    chars = F.array_sort(F.split(c, ""))
    runs = F.transform(chars, lambda x, i: F.struct((F.instr(F.lit(_COMMON), x)).alias("common"), x.alias("x"), (i - F.array_position(chars, x) + 1).alias("k")))
    return F.transform(F.array_sort(runs), lambda r: F.concat(r["x"], r["k"].cast("string")))


def _shortest(n: Column, threshold: float) -> Column:
    """The least length of a text that can resemble one of length n."""
    return F.ceil(n * threshold / (2 - threshold) - 1e-9).cast("int")


def _prefix(n: Column, threshold: float) -> Column:
    """How many of n rare-first letters must hold one that any resembling text shares among its own first ones."""
    return (n - F.ceil(threshold * (n + _shortest(n, threshold)) / 2 - 1e-9) + 1).cast("int")


def fuzzy_values(questions: DataFrame, values: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Values that resemble a token, by the ratio of matching letters.

    A ratio of at least ``threshold`` needs that many letters in common, so two such texts share one of the first, rarest
    letters of each, and their lengths are close: candidates meet on both by an equi-join that loses none.  Letters are then
    counted in full, and only what can still reach the threshold is compared."""
    ship(questions.sparkSession)
    q = questions.select("question_id", "db_id", F.explode(F.array_distinct(tokens("question"))).alias("token"))
    v = values.withColumn("key", normalise("value")).where("length(key) > 1")
    q, v = q.withColumn("token_letters", _letters(F.col("token"))), v.withColumn("key_letters", _letters(F.col("key")))
    few, many = F.length("token"), F.length("key")
    longest = F.floor(few * (2 - threshold) / threshold + 1e-9).cast("int")
    left = q.withColumn("size", F.explode(F.sequence(_shortest(few, threshold), longest))).withColumn("letter", F.explode(F.slice("token_letters", 1, _prefix(few, threshold))))
    right = v.withColumn("size", many).withColumn("letter", F.explode(F.slice("key_letters", 1, _prefix(many, threshold))))
    shared = F.size(F.array_intersect("token_letters", "key_letters"))
    near = left.join(right, ["db_id", "size", "letter"]).where(2.0 * shared >= threshold * (few + many) - 1e-9)
    near = near.select("question_id", "db_id", "table_name", "col_name", "value", "token", "key").distinct()
    scored = near.withColumn("score", F.round(fuzzy_ratio(F.col("token"), F.col("key")), 3)).where(F.col("score") >= threshold)
    return scored.groupBy("question_id", "db_id", "table_name", "col_name", "value").agg(F.max("score").alias("score"))


def match_values(questions: DataFrame, values: DataFrame, threshold: float = 0.8, top_k: int = 3, dictionary: DataFrame | None = None, legacy: bool = False) -> DataFrame:
    """The best values of each column for each question, by exact, partial and fuzzy match; with ``dictionary`` (source,
    target) also for the question's translated candidates.  Of a value's scores the largest counts."""
    asked = questions
    if dictionary is not None:
        from ..functions.text import value_candidates

        c = questions.select("question_id", "db_id", F.explode(value_candidates("question")).alias("c"))
        d = dictionary.select(F.lower("source").alias("k"), "target")
        asked = questions.select("question_id", "db_id", "question").unionByName(c.join(d, F.lower("c") == F.col("k")).select("question_id", "db_id", F.col("target").alias("question")))
    named = legacy_values(asked, values) if legacy else exact_values(asked, values).unionByName(partial_values(asked, values))
    hits = named.unionByName(fuzzy_values(asked, values, threshold))
    merged = hits.groupBy("question_id", "db_id", "table_name", "col_name", "value").agg(F.max("score").alias("score"))
    return top_k_per_group(merged, ["question_id", "db_id", "table_name", "col_name"], [F.col("score").desc(), F.col("value")], top_k, "rank")


def cell_links(hits: DataFrame, catalog: Catalog) -> DataFrame:
    """The best value of each column as a link."""
    named = catalog.named().select("db_id", "table_name", "col_name", "table_idx", "col_idx")
    return hits.where("rank = 1").join(named, ["db_id", "table_name", "col_name"]).select("question_id", "db_id", F.lit("cell").alias("kind"), "table_idx", "col_idx", F.lit("cell").alias("match_type"), "score", F.col("value").alias("span"))


def value_hints(hits: DataFrame, links: DataFrame, catalog: Catalog) -> DataFrame:
    """(question_id, db_id, hints): map from table.column to the best value, for linked columns."""
    linked = links.where("col_idx is not null").join(catalog.named().select("db_id", "col_idx", "table_name", "col_name"), ["db_id", "col_idx"]).select("question_id", "db_id", "table_name", "col_name").distinct()
    best = hits.where("rank = 1").join(linked, ["question_id", "db_id", "table_name", "col_name"])
    return best.groupBy("question_id", "db_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(".", "table_name", "col_name").alias("k"), F.col("value").alias("v"))))).alias("hints"))


def link(questions: DataFrame, catalog: Catalog, values: DataFrame | None = None, semantic: bool = True, threshold: float = 0.8, embed: Embedder = hashed_embedding, segment: Segmenter | None = None) -> DataFrame:
    """All links of all questions."""
    out = name_links(questions, catalog, segment=segment)
    if semantic:
        out = merge_links(out, semantic_links(questions, catalog, embed=embed))
    out = out.unionByName(num_date_links(questions, catalog))
    return settle(out if values is None else out.unionByName(cell_links(match_values(questions, values, threshold), catalog)))


def link_documents(questions: DataFrame, links: DataFrame, catalog: Catalog) -> DataFrame:
    """One row for each question: its links as JSON, the best first."""
    named = links.join(catalog.tables, ["db_id", "table_idx"]).join(catalog.columns.select("db_id", "col_idx", "col_name"), ["db_id", "col_idx"], "left")
    item = F.struct((-F.round("score", 4)).alias("by"), "kind", "table_idx", "col_idx", F.col("table_name").alias("table"), F.col("col_name").alias("col"), F.col("match_type").alias("type"), F.round("score", 4).alias("score"), "span")
    lists = named.groupBy("question_id", "db_id").agg(F.array_sort(F.collect_list(item)).alias("l"))

    def of(kind):
        return F.transform(F.filter(F.coalesce("l", F.array()), lambda x: x["kind"] == kind), lambda x: x.dropFields("by", "kind"))

    whole = questions.join(lists, ["question_id", "db_id"], "left")
    return whole.select("question_id", F.to_json(F.struct("db_id", "question", *[of(k).alias(n) for k, n in (("column", "columns"), ("table", "tables"), ("cell", "cells"), ("num_date", "num_date"))])).alias("document"))


def relevant_ids(links: DataFrame) -> DataFrame:
    """(question_id, db_id, table_ids, col_ids) that occur in links."""
    return links.groupBy("question_id", "db_id").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "table", F.col("table_idx")))).alias("table_ids"), F.array_sort(F.collect_set("col_idx")).alias("col_ids"))


def best_per_column(links: DataFrame) -> DataFrame:
    """Links in the order of their scores, ranked within each question."""
    return links.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "kind", "table_idx", "col_idx")))
