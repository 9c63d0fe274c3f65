"""Licence scans by ordered signature rules, in DataFrame functions alone.

Rules are regular expressions over a text's words (``licenserules``): hand-written sentences of licence bodies, notices and
identifiers, and names in a few wordings.  Each is gated by its own keyword, a run of words that all its matches hold; there
is no other gate.  Detections are intervals of words, taken in the order of their starts, of equal starts the longer first,
then the higher priority, then by label.  One that shares a word with the last one kept takes its place if its priority is
higher, and is suppressed if not; so one that another of at least its priority contains is always suppressed.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.  Base detections are places where a
phrase's words stand in a row; they are never suppressed.  Defined results: a null or empty text has no words and no
labels (empty strings, null positions, score 0); repeated rows and a null doc_id are scanned like any row; an empty table
gives an empty table; of extra columns none matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licenserules import anchor, rules

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    rows = docs.select(docs["doc_id"], F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    # A class of what words hold is faster than one of what they don't.
    # Of all letters beyond ASCII only the Kelvin sign has an ASCII letter for its lower case; with it out of the way, words
    # of ASCII letters come out just as by lower-casing A-Z.
    low = F.lower(F.replace("text", F.lit("\u212a"), F.lit("\u0138")))
    words = F.regexp_extract_all(low, F.lit("[0-9a-z\\x{80}-\\x{10FFFF}]+"), F.lit(0))
    rows = rows.withColumn("words", words).drop("text").withColumn("n_words", F.size("words").cast("long"))

    # Base phrases: starts of each, by the words that follow.
    rows = rows.withColumn("norm", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    def starts(want: list[str]) -> Column:
        def here(w, i):
            hit = w == want[0]
            for k, x in enumerate(want[1:], 1):
                hit &= F.get("words", i + k) == x
            return F.when(hit, i)

        return F.filter(F.transform("words", here), lambda i: i.isNotNull())

    for phrase, label in BASE.items():
        indexed = starts(phrase.split(" "))
        rows = rows.withColumn(f"at_{label}", F.when(F.col("norm").contains(f" {phrase} "), indexed).otherwise(F.array().cast("array<int>")))
    at = [f"at_{x}" for x in BASE.values()]
    n_base = sum((F.size(a) for a in at[1:]), F.size(at[0]))
    rows = rows.withColumn("at", F.concat(*at)).withColumn("n_base", n_base.cast("long"))
    base = F.array_compact(F.array(*[F.when(F.size(f"at_{x}") > 0, F.lit(x)) for x in BASE.values()]))
    rows = rows.withColumn("base", base).drop(*at)

    # Rules: those whose keyword is there (first by its rarest word, looked up for all rules in one pass over the words, then
    # as a whole), then their intervals by marks put around each match.
    by_keyword: dict[str, list] = {}
    for label, keyword, priority, pattern in rules():
        by_keyword.setdefault(keyword, []).append(F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(pattern).alias("pattern")))
    anchors = {keyword: anchor(keyword) for keyword in by_keyword}
    rows = rows.withColumn("met", F.array_intersect("words", F.array(*[F.lit(a) for a in sorted(set(anchors.values()))])))
    table = F.array(*[F.struct(F.lit(anchors[keyword]).alias("anchor"), F.lit(f" {keyword} ").alias("keyword"), F.array(*own).alias("rules")) for keyword, own in by_keyword.items()])
    present = F.flatten(F.transform(F.filter(table, lambda k: F.array_contains("met", k["anchor"]) & F.col("norm").contains(k["keyword"])), lambda k: k["rules"]))
    rows = rows.withColumn("rules", F.when(F.size("met") > 0, present)).drop("met")

    def intervals(r: Column) -> Column:
        marked = F.split(F.regexp_replace("norm", r["pattern"], F.lit("\x01$0\x02")), " ")
        starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith("\x01"), i)), lambda i: i.isNotNull())
        ends = F.filter(F.transform(marked, lambda w, i: F.when(w.endswith("\x02"), i)), lambda i: i.isNotNull())
        found = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (-b).alias("end"), (-r["priority"]).alias("priority"), r["label"].alias("label")))
        return F.when(F.regexp_like("norm", r["pattern"]), found).otherwise(F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>"))

    rows = rows.withColumn("found", F.array_sort(F.flatten(F.transform("rules", intervals)))).drop("rules", "norm", "words")
    none = F.array().cast("array<string>")
    nothing = F.struct(F.lit(-1).alias("reach"), F.lit(0).alias("priority"), F.lit(None).cast("string").alias("label"), none.alias("labels"), F.lit(0).alias("n"))

    def taken(s: Column, x: Column) -> Column:
        over = x["start"] <= s["reach"]  # shares a word with the one that is kept so far
        labels = F.when(over | s["label"].isNull(), s["labels"]).otherwise(F.array_union(s["labels"], F.array(s["label"])))
        own = F.struct((-x["end"]).alias("reach"), x["priority"].alias("priority"), x["label"].alias("label"), labels.alias("labels"), (s["n"] + F.when(over, 0).otherwise(1)).alias("n"))
        return F.when(over & (x["priority"] >= s["priority"]), s).otherwise(own)  # priorities are negative here

    settled = lambda s: F.struct(F.when(s["label"].isNull(), s["labels"]).otherwise(F.array_union(s["labels"], F.array(s["label"]))).alias("labels"), s["n"].alias("n"))
    rows = rows.withColumn("kept", F.aggregate("found", nothing, taken, settled))
    n = F.coalesce(F.col("kept")["n"], F.lit(0))
    return rows.select(
        "doc_id", "n_words", "n_base",
        F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce(F.col("kept")["labels"], none))), ",").alias("labels"),
        (F.lit(1.0) - F.pow(F.lit(0.5), F.greatest(n, F.least(F.size("base"), F.lit(1))))).alias("score"),
        n.cast("long").alias("detections"),
    )
