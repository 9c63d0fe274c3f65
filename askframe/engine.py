"""The engine: a question and a database go in; a statement, its rows and what led to it come out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.sqltext import executable
from .functions.text import Segmenter
from .operators.graph import enhance, graph_links
from .operators.linking import cell_links, exact_values, link, name_links
from .operators.masking import mask_questions
from .operators.pruning import prune
from .operators.retrieval import embed_query, few_shot_block, retrieve
from .operators.vectors import Embedder, hashed_embedding
from .plans import prompt as prompts
from .plans.config import Config
from .plans.execute import Executor, Result
from .plans.generate import SqlGenerator
from .plans.repair import Outcome, Repairer
from .plans.template import Schema, statement
from .session import settle
from .sources.catalog import Catalog, render_ddl
from .sources.values import cell_values, column_values, dump

ASKED = "question_id int, db_id string, question string"


@dataclass
class Answer:
    question: str
    sql: str
    result: Result
    masked: str = ""
    prompt: str = ""
    links: list[Row] = field(default_factory=list)
    outcome: Outcome | None = None


class Engine:
    """Answers questions over the databases of a catalog, whose tables lie in ``folders``."""

    def __init__(self, spark: SparkSession, catalog: Catalog, folders: dict[str, str], generator: SqlGenerator | None = None, examples: DataFrame | None = None, config: Config | None = None, embed: Embedder = hashed_embedding, segment: Segmenter | None = None) -> None:
        self.spark, self.catalog, self.folders = spark, catalog, folders
        self.config = config or Config()
        self.generator, self.examples = generator, examples
        self.embed, self.segment = embed, segment
        self.executor = Executor(spark, folders=folders, timeout=self.config.sql_timeout_seconds, most_rows=self.config.sql_max_rows)
        self._values: dict[str, DataFrame] = {}
        self._schemas: dict[str, Schema] = {}

    def values(self, db_id: str) -> DataFrame:
        """Stored values of a database, read once."""
        if db_id not in self._values:
            self._values[db_id] = settle(cell_values(self.spark, self.folders[db_id], self.catalog.of(db_id), self.config.max_cell_values))
        return self._values[db_id]

    def link(self, questions: DataFrame, db_id: str, values: bool = True) -> DataFrame:
        return link(questions, self.catalog.of(db_id), self.values(db_id) if values else None, threshold=self.config.cell_value_fuzzy_threshold, embed=self.embed, segment=self.segment)

    def schema(self, db_id: str) -> Schema:
        """A database's catalog on the driver, collected once."""
        if db_id not in self._schemas:
            self._schemas[db_id] = Schema.of(self.catalog.of(db_id))
        return self._schemas[db_id]

    def _template(self, question: str, db_id: str, links: list[Row]) -> str:
        """A statement from a question's links alone: exact names, and stored values of more than two letters in full."""
        exact = [(r["kind"], r["table_idx"], r["col_idx"], r["span"]) for r in links if r["kind"] in ("table", "column") and r["match_type"] == "exact"]
        cells = [(r["col_idx"], r["span"]) for r in links if r["kind"] == "cell" and r["score"] >= 1.0 and r["span"] and len(r["span"]) > 2]
        return statement(question, self.schema(db_id), exact, cells)

    def statements(self, questions: DataFrame, db_id: str) -> dict[int, str]:
        """The template's statement for each of some questions (question_id, db_id, question): all are linked by one plan."""
        catalog = self.catalog.of(db_id)
        hits = exact_values(questions, self.values(db_id)).withColumn("rank", F.lit(1))
        rows = name_links(questions, catalog, segment=self.segment).unionByName(cell_links(hits, catalog)).collect()
        asked = questions.select("question_id", "question").collect()
        return {q["question_id"]: self._template(q["question"], db_id, [r for r in rows if r["question_id"] == q["question_id"]]) for q in asked}

    def prepare(self, question: str, db_id: str) -> tuple[str, str, DataFrame]:
        """Prompt, masked question and links of a question."""
        asked = self.spark.createDataFrame([(1, db_id, question)], ASKED)
        catalog = self.catalog.of(db_id)
        links = self.link(asked, db_id) if self.config.use_schema_linking else self.spark.createDataFrame([], "question_id int, db_id string, kind string, table_idx int, col_idx int, match_type string, score double, span string")
        masked = mask_questions(asked, links).first()["masked"]
        tables, columns = prune(links, catalog)
        linked = not links.isEmpty()
        ddl = render_ddl(catalog, tables.select("db_id", "table_idx") if linked else None, columns.select("db_id", "col_idx") if linked else None).first()["ddl"]
        lines = prompts.hints(links, catalog, self.values(db_id)).first() if linked else None
        shots = ""
        if self.examples is not None:
            shots = few_shot_block(retrieve(self.examples, embed_query(self.spark, masked, self.embed), self.config.retrieval_top_k, self.config.retrieval_alpha, self.config.retrieval_beta, self.config.use_mmr))
        text = prompts.build(question, ddl, *((lines["structure"], lines["cells"], lines["examples"]) if lines else ("", "", "")), shots, self.config.token_budget)
        return text, masked, links

    def clean(self, sql: str, db_id: str) -> str:
        """Generated text as a statement: the clean-up chain with the database's column names known, string quotes as they are."""
        names = tuple(sorted({c[1] for c in self.schema(db_id).columns.values()}))
        return self.spark.createDataFrame([(sql,)], "sql string").select(executable("sql", names).alias("s")).first()["s"]

    def ask(self, question: str, db_id: str) -> Answer:
        """Link, prune, prompt, generate, clean, run, and repair what fails."""
        text, masked, links = self.prepare(question, db_id)
        generator = self.generator
        sql = self.clean(generator.generate(text), db_id) if generator else self._template(question, db_id, links.collect())
        if generator is None:
            return Answer(question, sql, self.executor.execute(sql, db_id), masked, text, links.collect())
        catalog = self.catalog.of(db_id)
        repairer = Repairer(self.executor, generator, values_of=lambda d, c: column_values(self.spark, self.folders[d], catalog, c, self.config.max_cell_values), dump=lambda d: "".join(f"-- {r['line']}\n" for r in dump(self.values(d), self.config.repair_max_values_per_column, self.config.repair_max_total_chars).collect()), attempts=self.config.repair_max_attempts, empty_fails=self.config.repair_empty_results)
        outcome = repairer.repair(sql, db_id, question, render_ddl(catalog).first()["ddl"])
        return Answer(question, outcome.executed, outcome.result, masked, text, links.collect(), outcome)

    def ask_frame(self, question: str, db_id: str) -> DataFrame:
        """The rows of the template's answer as a DataFrame that has not run yet."""
        asked = self.spark.createDataFrame([(1, db_id, question)], ASKED)
        return self.executor.frame(self.statements(asked, db_id)[1], db_id)

    def tables_needed(self, questions: DataFrame, db_id: str) -> DataFrame:
        """Tables with those that the foreign-key graph adds, for any number of questions."""
        links = self.link(questions, db_id)
        catalog = self.catalog.of(db_id)
        more = enhance(questions, links, catalog)
        return links.unionByName(graph_links(more, links)).where(F.col("kind") == "table")
