"""Quality rules with thresholds that adapt to each language and source.

Everything is DataFrame and SQL functions: no Python runs on the rows.  Each document's counts are taken once; KLL quantile
sketches of its ratios are aggregated per language and source and merged into one per language, and fences from their
quantiles replace fixed cutoffs: ``q75 + reach * (q75 - q25)``, but never under the sketch's ``q98`` nor under a floor below
which a ratio is no sign of anything.  A group's fence and its language's are blended by the group's size: of n rows against
``least``, the group's own counts n / (n + least), at every size.  The fences are joined back, and a document is kept if it passes the fixed base rules and every fence.

Defined results: a null or empty text has no words and fails the base rules; null languages and sources are groups of their
own, apart from empty strings; ties at a fence pass; repeated rows and a null doc_id are judged like any row; an empty table gives an empty table;
of extra columns none matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Ratios and their floors: values up to the floor pass whatever the quantiles say.
FLOORS = {"symbol_ratio": 0.10, "dup_line_ratio": 0.30, "repeat_ratio": 0.30, "word_length": 12.0}
REACH = 6.0
LEAST_ROWS = 200
_WORD = "[^\\x20\\x09-\\x0D]+"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows = docs.select(docs["doc_id"], docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    rows = rows.select(
        "doc_id", "lang", "source", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # 3-word windows by their hash; where all differ, which sorting longs shows, nothing repeats.
    windows = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("windows", windows).drop("words")
    rows = rows.withColumn("some", F.size(F.array_distinct("windows")) < F.size("windows"))
    sorted_windows = F.when(F.col("some"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = rows.withColumn("sorted", sorted_windows).drop("windows", "some")
    # Places of windows that occur more than once, in order; each covers three words, less what the next one covers.
    twins = F.filter("sorted", lambda x, k: (x["h"] == F.get("sorted", k - 1)["h"]) | (x["h"] == F.get("sorted", k + 1)["h"]))
    rows = rows.withColumn("at", F.array_sort(F.transform(twins, lambda x: x["i"]))).drop("sorted")
    covered = F.aggregate(F.zip_with("at", F.slice(F.concat("at", F.array(F.lit(2_000_000_000))), 2, F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(0)))), F.lit(0), lambda s, x: s + x)
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("at")


def _ratios(rows: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return rows.withColumns({
        "symbol_ratio": F.col("n_symbols") / n,
        "dup_line_ratio": F.col("n_dup_lines") / n * 8,
        "repeat_ratio": F.col("n_repeat_words") / n,
        "word_length": F.col("word_chars") / n,
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def _fence(sketch: Column, floor: float, reach: float) -> Column:
    q = F.kll_sketch_get_quantile_double(sketch, F.array(F.lit(0.25), F.lit(0.75), F.lit(0.98)))
    return F.greatest(F.lit(floor), q[1] + reach * (q[1] - q[0]), q[2])


def fences(rows: DataFrame, reach: float = REACH, least: int = LEAST_ROWS) -> DataFrame:
    """lang, source and a fence for each ratio; one row for each group that occurs."""
    some = rows.where("n_words > 0")
    own = some.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(c).alias(c) for c in FLOORS])
    own = checkpoint(own)
    wide = own.groupBy("lang").agg(*[F.kll_merge_agg_double(c).alias(f"all_{c}") for c in FLOORS])
    own, wide = own.alias("o"), wide.alias("w")
    both = own.join(wide, F.col("o.lang").eqNullSafe(F.col("w.lang")))
    part = F.col("n") / (F.col("n") + least)
    blend = lambda c, floor: part * _fence(F.col(c), floor, reach) + (1 - part) * _fence(F.col(f"all_{c}"), floor, reach)
    return both.select("o.lang", "o.source", *[blend(c, floor).alias(f"fence_{c}") for c, floor in FLOORS.items()])


def judge(docs: DataFrame, reach: float = REACH, least: int = LEAST_ROWS) -> DataFrame:
    """Per document: doc_id, counts, base_failed, kept, and the ratios that crossed their fences as ``crossed``."""
    rows = checkpoint(_ratios(measures(docs)))
    fence = fences(rows, reach, least).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = rows.join(fence, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    crossed = F.array_compact(F.array(*[F.when(F.col(c) > F.col(f"fence_{c}"), F.lit(c)) for c in FLOORS]))
    out = joined.withColumn("crossed", F.array_join(crossed, ","))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("crossed") == "")).alias("kept"), "crossed")
