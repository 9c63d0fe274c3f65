"""Execution, repair, scores and statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import profiling
from ..plans import evaluate, prompt
from ..plans.execute import Executor
from ..plans.generate import ReplayGenerator
from ..plans.repair import Repairer
from ..session import settle, shared_folder
from ..sources import files
from ..sources.catalog import render_ddl
from ..sources.tables import table
from ..sources.values import column_values
from . import fixtures
from .schema import star, values
from .textual import _VI, english_sql, skeleton_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _executor(spark, sf):
    return Executor(spark, folders={fixtures.DB: sf}, timeout=60.0)


def ask_template(spark, sf):
    """The flagship: a question is linked, joined along foreign keys, put into SQL and handed to Spark."""
    return Engine(spark, star(spark, sf), {fixtures.DB: sf}).ask_frame("How many orders per customer of the BUILDING segment?", fixtures.DB)


QUERIES["ask_template"] = ask_template
ORACLES["ask_template"] = "SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey"

#: Questions and what they ask for, written from the question and not from the engine's statement.
ASKED = {
    "ask_largest": ("What is the largest o_totalprice of orders?", "SELECT max(o_totalprice) AS value FROM orders"),
    "ask_average_by": ("What is the average s_acctbal of each nation?", "SELECT s_nationkey AS n_nationkey, avg(s_acctbal) AS value FROM supplier GROUP BY s_nationkey"),
    "ask_total_per": ("Give the total l_quantity per part", "SELECT l_partkey AS p_partkey, sum(l_quantity) AS value FROM lineitem GROUP BY l_partkey"),
    "ask_smallest_by": ("smallest c_acctbal by c_mktsegment", "SELECT c_mktsegment, min(c_acctbal) AS value FROM customer GROUP BY c_mktsegment"),
    "ask_count": ("How many parts are there?", "SELECT count(*) AS n FROM part"),
    "ask_count_value": ("How many orders have the priority 1-URGENT?", "SELECT count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "ask_count_far": ("How many customers per region?", "SELECT n_regionkey AS r_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey"),
    "ask_count_once": ("How many customers have orders of priority 1-URGENT?", "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "ask_list": ("List the region of every nation", "SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "ask_which": ("Which customers are in the BUILDING segment?", "SELECT DISTINCT c_name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "ask_three_tables": ("nation, customer and supplier of each region", "SELECT DISTINCT n_name, c_name, s_name, r_name FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "ask_total_once": ("total c_acctbal of customers with orders of priority 1-URGENT", "SELECT sum(c_acctbal) AS value FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
}
_STATEMENTS: dict = {}


def _asked(spark, sf) -> dict[str, str]:
    """The statements for all questions, by one plan."""
    at = spark.sparkContext.applicationId, sf
    if at not in _STATEMENTS:
        rows = [(k, fixtures.DB, q) for k, (q, _) in enumerate(ASKED.values())]
        made = Engine(spark, star(spark, sf), {fixtures.DB: sf}).statements(spark.createDataFrame(rows, "question_id int, db_id string, question string"), fixtures.DB)
        _STATEMENTS[at] = {name: made[k] for k, name in enumerate(ASKED)}
    return _STATEMENTS[at]


for _name, (_, _sql) in ASKED.items():
    QUERIES[_name] = lambda spark, sf, name=_name: _executor(spark, sf).frame(_asked(spark, sf)[name], fixtures.DB)
    ORACLES[_name] = _sql


@query()
def prompts(spark, sf):
    q, c, v = fixtures.questions(spark), star(spark, sf), values(spark, sf)
    from ..operators.linking import link

    return prompt.build_all(q, render_ddl(c), prompt.hints(link(q, c, v, semantic=False), c, v)).select("question_id", "prompt")


_MORE = [(100, "drop table customer"), (101, "select nope from customer"), (102, "select c_name from customer where c_custkey < 0"), (103, "select c_name , max ( c_acctbal ) from customer group by c_mktsegment")]
#: Statements that no engine runs, and their class; double-quoted text and loose grouping are said in standard SQL.
_CLASSES = {100: "syntax_error", 101: "runtime_error", 7: "runtime_error"}
_STANDARD = {11: "select distinct p_brand from part where p_type = 'x  y' or p_brand != 'Brand#1'", 103: "select c_mktsegment from customer group by c_mktsegment"}


def _outcome(k: int, sql: str) -> str:
    if k in _CLASSES:
        return f"SELECT {k} AS sql_id, '{_CLASSES[k]}' AS status, 0::BIGINT AS n, false AS truncated"
    return f"SELECT {k}, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'success' END, least(count(*), 1000), count(*) > 1000 FROM ({_STANDARD.get(k, sql).rstrip(';')}) AS t"


@query(" UNION ALL ".join(_outcome(k, s) for k, s in sorted([*fixtures.STATEMENTS, *_MORE], key=lambda x: (x[0] not in _CLASSES, x[0]))))
def execute_status(spark, sf):
    """Outcome of each inline statement: status, rows and whether rows were cut."""
    x = _executor(spark, sf)
    rows = [(i, (r := x.execute(s, fixtures.DB)).status.value, len(r.rows), r.truncated) for i, s in [*fixtures.STATEMENTS, *_MORE]]
    return spark.createDataFrame(rows, "sql_id int, status string, n long, truncated boolean")


_MENDED = ((0, "select c_name from customer where c_custkey = 1", 1), (1, "select count(*) as n from customer where c_mktsegment = 'BUILDING' having count(*) > 0", 0))


@query(" UNION ALL ".join(f"SELECT {k} AS id, count(*) > 0 AS success, '{s.replace(chr(39), chr(39) * 2)}' AS executed, {tries} AS attempts, count(*) AS n FROM ({s}) AS t" for k, s, tries in _MENDED))
def repair_loop(spark, sf):
    """A wrong column that the generator corrects, and a wrong value that the stored ones correct."""
    generator, c = ReplayGenerator({"names": "select c_name from customer where c_custkey = 1"}), star(spark, sf)
    r = Repairer(_executor(spark, sf), generator, values_of=lambda d, col: column_values(spark, sf, c, col))
    out = []
    for k, (q, s) in enumerate((("names", "select nope from customer"), ("values", "select count(*) as n from customer where c_mktsegment = 'buildin' having count(*) > 0"))):
        o = r.repair(s, fixtures.DB, q, "")
        out.append((k, o.success, o.executed, len(o.attempts), len(o.result.rows)))
    return spark.createDataFrame(out, "id int, success boolean, executed string, attempts int, n long")


def _scores(spark, sf):
    return settle(evaluate.score(spark, fixtures.predictions(spark), _executor(spark, sf), legacy=True))


#: Predictions that name what is not there: no engine runs them.
_FAILING = (5,)


def _rows_sql(sql: str) -> str:
    """A statement's rows as lists of their cells' texts."""
    return f"SELECT list_value(*COLUMNS(*)) AS r FROM (SELECT COLUMNS(*)::VARCHAR FROM ({sql}) AS t)"


def _same_sql(predicted: str, gold: str) -> str:
    """Whether two statements give the same bag of rows, cells compared as trimmed lower-case text; empty results are equal."""
    a, b = (f"SELECT list_transform(r, lambda x: lower(trim(coalesce(x, 'None')))) AS r FROM ({_rows_sql(s)})" for s in (predicted, gold))
    return f"(NOT EXISTS ({a} EXCEPT ALL {b}) AND NOT EXISTS ({b} EXCEPT ALL {a}))::INT"


_SAMPLES = "(SELECT s.*, e.ex FROM " + fixtures.values_sql([(p[0], p[3], p[4]) for p in fixtures.PREDICTIONS], "index, predicted, gold") + " s JOIN (" + " UNION ALL ".join(f"SELECT {p[0]} AS index, {'0' if p[0] in _FAILING else _same_sql(p[3], p[4])} AS ex" for p in fixtures.PREDICTIONS) + ") e ON s.index = e.index)"


@query(f"SELECT index, ex = 1 AS exec_match FROM {_SAMPLES}")
def exec_match(spark, sf):
    return _scores(spark, sf).select("index", "exec_match")


_KW = ["select", "from", "distinct", "order", "by", "group", "count", "where", "join", "on", "in", "null"]


def _up(c: str) -> str:
    for k in _KW:
        c = f"regexp_replace({c}, '\\b{k}\\b', '{k.upper()}', 'g')"
    return c


_EM = f"({_up('predicted')} = {_up('gold')})"
_LEVEL = r"CASE WHEN len(regexp_extract_all(gold, '(?i)\bSELECT\b')) >= 2 THEN 'extra' WHEN regexp_matches(gold, '(?i)\bJOIN\b|\b(?:COUNT|SUM|AVG|MIN|MAX)\s*\(|\bGROUP\s+BY\b') THEN 'medium' ELSE 'easy' END"


@query(f"SELECT count(*) AS total, avg({_EM}::INT::DOUBLE) AS exact_match_acc, avg(ex::DOUBLE) AS exec_acc FROM {_SAMPLES}")
def metrics_overall(spark, sf):
    return evaluate.overall(_scores(spark, sf)).select("total", "exact_match_acc", "exec_acc")


_PART = r"upper(trim(regexp_replace(regexp_extract({}, '(?is)\b{}\b(.*?)(?:\b(?:FROM|WHERE|GROUP|HAVING|ORDER|LIMIT|JOIN|UNION)\b|$)', 1), '\s+', ' ', 'g')))"


def _part(column: str, clause: str) -> str:
    return _PART.replace("{}", column, 1).replace("{}", clause, 1)


@query(" UNION ALL ".join(f"SELECT '{c}' AS clause, avg(({_part('predicted', c)} = {_part('gold', c)})::INT::DOUBLE) AS accuracy FROM {_SAMPLES}" for c in evaluate.CLAUSES))
def metrics_by_clause(spark, sf):
    return evaluate.by_clause(evaluate.text_scores(fixtures.predictions(spark))).select("clause", "accuracy")


@query(f"SELECT {_LEVEL} AS complexity, count(*) AS n, avg({_EM}::INT::DOUBLE) AS em, avg(ex::DOUBLE) AS ex FROM {_SAMPLES} GROUP BY {_LEVEL}")
def metrics_by_complexity(spark, sf):
    return evaluate.by_complexity(_scores(spark, sf))


@query(f"SELECT index, {skeleton_sql('predicted')} = {skeleton_sql('gold')} AS skeleton_match FROM {fixtures.values_sql([(p[0], p[3], p[4]) for p in fixtures.PREDICTIONS], 'index, predicted, gold')}")
def metrics_skeleton(spark, sf):
    return evaluate.text_scores(fixtures.predictions(spark)).select("index", "skeleton_match")


@query(f"SELECT sql_id AS index, {english_sql('sql')} AS predicted_en, {english_sql('sql')} AS gold_en, true AS exact_match FROM {_VI}")
def rescore_translated(spark, sf):
    samples = spark.createDataFrame([(i, d, "", s, s) for i, d, s in fixtures.VI_STATEMENTS], "index int, db_id string, question string, predicted string, gold string")
    names = spark.createDataFrame(fixtures.MAP, "db_id string, kind string, source string, target string")
    return evaluate.rescore_translated(samples, names).select("index", "predicted_en", "gold_en", "exact_match")


@query(f"SELECT index::BIGINT AS index, 'star' AS db_id, {_EM} AS exact_match, ex = 1 AS exec_match, {_LEVEL} AS complexity FROM {_SAMPLES}")
def results_sink_roundtrip(spark, sf):
    """Write the results document, read its predictions back."""
    at = f"{shared_folder(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    scores = _scores(spark, sf).select("index", "db_id", "question", "predicted", "gold", "exact_match", "exec_match", "skeleton_match", "component_scores", "complexity", "error_msg")
    files.write_results(scores, evaluate.overall(_scores(spark, sf)), at)
    return files.read_results(spark, at).select("index", "db_id", "exact_match", "exec_match", "complexity")


# --- statistics ------------------------------------------------------------------------------------------------------


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def profile_counts_topn(spark, sf):
    return profiling.counts_top(table(spark, sf, "documents"), "source", 10)


@query("SELECT CASE WHEN a IS NULL THEN 'right' WHEN b IS NULL THEN 'left' ELSE 'both' END AS side, coalesce(a, b) AS value FROM (SELECT DISTINCT doc_id AS a FROM documents) FULL JOIN (SELECT DISTINCT doc_id AS b FROM labels) ON a = b")
def profile_set_diff(spark, sf):
    return profiling.compare_sets(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT coalesce(a.value, b.value) AS value, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right, n_left::DOUBLE / n_right AS ratio FROM (SELECT c_nationkey AS value, count(*) AS n_left FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS value, count(*) AS n_right FROM supplier GROUP BY 1) b ON a.value = b.value")
def profile_splits(spark, sf):
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return profiling.compare_splits(c, s, "k").withColumn("ratio", F.when(F.col("n_left") > 0, F.col("ratio")))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey AS left_k, o_custkey AS right_k, c_custkey = o_custkey AS same FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) JOIN (SELECT k AS o_custkey, row_number() OVER (ORDER BY k) AS r FROM (SELECT c_custkey + 1 AS k FROM customer)) USING (r)")
def align_positional(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("v"))
    return profiling.align(c, c.select((F.col("k") + 1).alias("k"), (F.col("v") + 1).alias("v")), "k", "v")


@query("SELECT 'd' AS part, doc_id AS id, lang FROM documents UNION ALL SELECT 'l', doc_id, NULL FROM labels")
def merge_union_all(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("d").alias("part"), F.col("doc_id").alias("id"), "lang")
    return d.unionByName(table(spark, sf, "labels").select(F.lit("l").alias("part"), F.col("doc_id").alias("id")), allowMissingColumns=True)


_WORDS = "len(regexp_split_to_array(trim({}), '\\s+'))"


@query(f"SELECT count(*) AS questions, count(DISTINCT db_id) AS databases, avg({_WORDS.replace('{}', 'question')}) AS mean_words, avg({_WORDS.replace('{}', 'gold')}) AS mean_sql_words FROM " + fixtures.values_sql([(p[1], p[2], p[4]) for p in fixtures.PREDICTIONS], "db_id, question, gold"))
def profile_questions(spark, sf):
    return profiling.profile_questions(fixtures.predictions(spark).withColumnRenamed("gold", "query"))
