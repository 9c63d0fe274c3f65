"""Prompts: schema, hints, examples and the question, under a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.topk import top_k_per_group
from ..sources.catalog import Catalog

CHARACTERS_A_TOKEN = 4
OPENING = "### Answer with one SQL query and nothing else.\n"
RULES = (
    "Use only the tables and columns of the schema, spelled as there.",
    "Prefer the stored values that are listed; keep their letters as they are.",
    "Select columns in the order of the question.",
    "Write one query; no explanation, no Markdown.",
    "Give joined tables aliases t1, t2, ... in the order they appear.",
    "Quote text values.",
    "Use DISTINCT where the question asks for different things.",
    "Use MAX or MIN for extremes of a value; order and limit only for whole rows.",
    "Group by the key that the question names, and by nothing else.",
    "Join only what the answer needs.",
)
EXAMPLE_VALUES = 5


def hints(links: DataFrame, catalog: Catalog, values: DataFrame | None = None) -> DataFrame:
    """(question_id, structure, cells, examples): lines about tables and columns, about matched values, and sample values."""
    named = links.join(catalog.tables, ["db_id", "table_idx"]).join(catalog.columns.select("db_id", "col_idx", "col_name"), ["db_id", "col_idx"], "left")
    column = F.concat_ws(".", "table_name", "col_name")

    def joined(kind, text):
        item = F.when(F.col("kind") == kind, F.struct((-F.col("score")).alias("by"), text.alias("text")))
        return F.array_join(F.transform(F.array_sort(F.collect_set(item)), lambda x: x["text"]), ", ")

    out = named.groupBy("question_id").agg(joined("table", F.col("table_name")).alias("t"), joined("column", column).alias("c"), joined("cell", F.concat(column, F.lit(" = '"), F.coalesce("span", F.lit("")), F.lit("'"))).alias("v"))

    def line(title, c):
        return F.when(F.col(c) != "", F.concat(F.lit(f"-- {title}: "), c, F.lit("\n"))).otherwise("")

    out = out.select("question_id", F.concat(line("tables", "t"), line("columns", "c")).alias("structure"), line("values", "v").alias("cells"))
    if values is None:
        return out.withColumn("examples", F.lit(""))
    some = top_k_per_group(values, ["db_id", "table_name", "col_name"], [F.col("value")], EXAMPLE_VALUES, "_r").groupBy("db_id", "table_name", "col_name").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("some"))
    shown = named.where("kind in ('column', 'cell')").select("question_id", "db_id", "table_name", "col_name").distinct().join(some, ["db_id", "table_name", "col_name"])
    text = shown.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("-- "), column, F.lit(": "), "some"))), "\n").alias("examples"))
    return out.join(text, "question_id", "left").withColumn("examples", F.coalesce(F.concat("examples", F.lit("\n")), F.lit("")))


def fit_examples(block: str, fixed: int, tokens: int) -> str:
    """As many whole examples from the front as the budget leaves room for; 0 tokens is no limit."""
    room = tokens * CHARACTERS_A_TOKEN - fixed
    if not tokens or len(block) <= room:
        return block
    out = ""
    for example in (e + "\n\n" for e in block.split("\n\n") if e.strip()):
        if len(out) + len(example) > room:
            break
        out += example
    return out


def build(question: str, ddl: str, structure: str = "", cells: str = "", examples: str = "", few_shot: str = "", tokens: int = 3000) -> str:
    """The prompt; it ends with the question, after the values that belong to it, and the first word of the answer."""
    head = OPENING + "".join(f"{k}. {r}\n" for k, r in enumerate(RULES, 1)) + f"\n-- schema\n{ddl}\n{structure}{examples}"
    tail = f"{cells}-- question: {question}\nSELECT "
    return head + fit_examples(few_shot, len(head) + len(tail), tokens) + tail


def build_all(questions: DataFrame, ddl: DataFrame, lines: DataFrame, few_shot: DataFrame | None = None) -> DataFrame:
    """questions with ``prompt``, for any number of them; ``few_shot`` has (question_id, block)."""
    rows = questions.join(ddl, "db_id").join(lines, "question_id", "left")
    rows = rows.join(few_shot, "question_id", "left") if few_shot is not None else rows.withColumn("block", F.lit(""))
    opening = OPENING + "".join(f"{k}. {r}\n" for k, r in enumerate(RULES, 1)) + "\n-- schema\n"

    def text(c):
        return F.coalesce(F.col(c), F.lit(""))

    return rows.withColumn("prompt", F.concat(F.lit(opening), "ddl", F.lit("\n"), text("structure"), text("examples"), text("block"), text("cells"), F.lit("-- question: "), "question", F.lit("\nSELECT "))).select(*questions.columns, "prompt")
