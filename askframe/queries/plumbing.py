"""Sources, sinks, settings, dialect, generators and the parts of the engine that need no large table, each with its SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import dialect, sqltext
from ..operators import linking, pruning, retrieval
from ..plans import config, generate, prompt, repair, translate
from ..plans.execute import Executor, Result, Status
from ..session import settle, shared_folder
from ..sources import files, tables
from ..sources.values import column_values as read_column
from . import fixtures
from .schema import _CATALOG, _EXACT, _FKS, _KEPT, _LINKED, _PARTIAL, _VALUES, star, values

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rows(rows, names: str) -> str:
    return f"SELECT * FROM {fixtures.values_sql(rows, names)}"


def _new(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/inline-{uuid.uuid4().hex}"


# --- sources and sinks ---------------------------------------------------------------------------------------------

_ASKED = [(k, p[1], p[2], p[4]) for k, p in enumerate(fixtures.PREDICTIONS)]


def _questions_file(spark) -> str:
    """The inline questions as one JSON array, as question sets come."""
    at = _new(spark)
    text = json.dumps([{"db_id": d, "question": q, "query": s} for _, d, q, s in _ASKED], ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(at)
    return at


@query("SELECT index::BIGINT AS index, db_id, question, query FROM " + fixtures.values_sql(_ASKED, "index, db_id, question, query"))
def questions_source(spark, sf):
    return files.read_questions(spark, _questions_file(spark))


@query("SELECT index::BIGINT AS index, db_id, question, query FROM " + fixtures.values_sql(_ASKED[:4], "index, db_id, question, query"))
def questions_first(spark, sf):
    return files.read_questions(spark, _questions_file(spark), 4)


@query(_rows([(p[4], p[1]) for p in fixtures.PREDICTIONS], "sql, db_id"))
def gold_source(spark, sf):
    at = _new(spark)
    spark.createDataFrame([(f"{p[4]}\t{p[1]}\n",) for p in fixtures.PREDICTIONS], "value string").coalesce(1).write.text(at)
    return files.read_gold(spark, at)


@query(_rows([("a", "a/a"), ("b", "b"), ("c", "")], "db_id, folder"))
def database_resolve(spark, sf):
    root = _new(spark)
    for folder in ("a/a", "b"):
        spark.range(1).write.parquet(f"{root}/{folder}/t.parquet")
    found = [(d, (tables.resolve(spark, root, d) or "").removeprefix(root).strip("/")) for d in ("a", "b", "c")]
    return spark.createDataFrame(found, "db_id string, folder string")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@query(_rows([(t,) for t in _TABLES], "table_name"))
def tables_registered(spark, sf):
    own = spark.newSession()
    tables.register(own, sf, list(_TABLES))
    return spark.createDataFrame([(n,) for n in tables.table_names(own) if n in _TABLES], "table_name string")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS column_type FROM (DESCRIBE {t})" for t in ("region", "nation", "customer", "supplier", "part")))
def table_columns(spark, sf):
    own = spark.newSession()
    tables.register(own, sf, list(_TABLES))
    rows = [(t, c, kind) for t in ("region", "nation", "customer", "supplier", "part") for c, kind in tables.column_names(own, t)]
    return spark.createDataFrame(rows, "table_name string, column_name string, column_type string")


@query("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL")
def column_values(spark, sf):
    return spark.createDataFrame([(v,) for v in read_column(spark, sf, star(spark, sf), "C_MKTSEGMENT")], "value string")


@query(_VALUES)
def cell_values_kept(spark, sf):
    """Stored values by way of the engine, which reads them once and keeps them."""
    engine = Engine(spark, star(spark, sf), {fixtures.DB: sf})
    engine.values(fixtures.DB)
    return engine.values(fixtures.DB)


@query(_rows([(1, "b"), (2, "c"), (3, "d")], "index, predicted"))
def batches_kept(spark, sf):
    """Batches of predictions, one of them written again."""
    at = _new(spark)
    for number, rows in ((0, [(1, "a")]), (1, [(2, "c"), (3, "d")]), (0, [(1, "b")])):
        files.write_checkpoint(spark.createDataFrame(rows, "index int, predicted string"), at, number)
    return files.read_checkpoint(spark, at).select("index", "predicted")


@query(_rows([(1, "first"), (2, "second"), (3, "third")], "n, entry"))
def log_appended(spark, sf):
    at = _new(spark)
    for rows in ([(1, "first"), (2, "second")], [(3, "third")]):
        files.append_log(spark.createDataFrame(rows, "n int, entry string"), at)
    return spark.read.schema("n int, entry string").json(at)


@query(_rows(fixtures.MAP, "db_id, kind, source, target"))
def map_roundtrip(spark, sf):
    at = _new(spark)
    files.write_map(spark.createDataFrame(fixtures.MAP, "db_id string, kind string, source string, target string"), at)
    return files.read_map(spark, at)


@query(_rows([("retrieval_top_k", "3"), ("sql_max_rows", "1000"), ("token_budget", "3000"), ("use_mmr", "True")], "name, value"))
def config_settings(spark, sf):
    c = config.load(retrieval_top_k=3, use_mmr="yes")
    return spark.createDataFrame([(n, str(getattr(c, n))) for n in ("retrieval_top_k", "sql_max_rows", "token_budget", "use_mmr")], "name string, value string")


# --- statements ----------------------------------------------------------------------------------------------------

_MIXED = (*fixtures.STATEMENTS, (100, "drop table customer"), (101, "select 1; select 2"), (102, "  with a as (select 1) select * from a;"), (103, "insert into t values (1)"), (104, "update t set a = 1"))
_MIXED_SQL = fixtures.values_sql(_MIXED, "sql_id, sql")


@query(f"SELECT sql_id, regexp_matches(sql, '(?i)^\\s*(select|with)\\b') AND NOT regexp_matches(sql, ';\\s*\\S') AS allowed FROM {_MIXED_SQL}")
def sql_guard(spark, sf):
    """Which statements are one query."""

    def allowed(sql: str) -> bool:
        try:
            return bool(dialect.guard(sql))
        except dialect.NotAQuery:
            return False

    return spark.createDataFrame([(k, allowed(s)) for k, s in _MIXED], "sql_id int, allowed boolean")


_ODD = ("kiến_trúc_sư", "nhà_máy", "tên", "id kiến_trúc_sư")


@query("SELECT sql_id, regexp_replace(sql, '(id kiến_trúc_sư|kiến_trúc_sư|nhà_máy|tên)', '`\\1`', 'g') AS quoted FROM " + fixtures.values_sql([(s[0], s[2]) for s in fixtures.VI_STATEMENTS[1:]], "sql_id, sql"))
def sql_identifiers(spark, sf):
    return spark.createDataFrame([(k, dialect.quote_identifiers(s, list(_ODD))) for k, _, s in fixtures.VI_STATEMENTS[1:]], "sql_id int, quoted string")


@query(f"SELECT sql_id, replace(regexp_replace(sql, '(?i)\\blike\\b', 'ILIKE', 'g'), '\"Brand#1\"', '''Brand#1''') AS statement FROM {fixtures.STATEMENTS_SQL} WHERE sql_id IN (1, 3, 4, 6, 9, 11)")
def sql_dialect(spark, sf):
    """Statements as Spark runs them: LIKE ignores case, double-quoted text is a string."""
    return spark.createDataFrame([(k, dialect.to_spark(s, ["c_name", "p_brand"])) for k, s in fixtures.STATEMENTS if k in (1, 3, 4, 6, 9, 11)], "sql_id int, statement string")


_OURS = ("arch", ["kiến_trúc_sư", "nhà máy"], [[-1, "*"], [0, "id"], [0, "tên"], [1, "năm xây"]])
_THEIRS = ("arch", ["architect", "mill"], [[-1, "*"], [0, "id"], [0, "name"], [1, "built_year"]])
_PAIRS = [("table", "kiến_trúc_sư", "architect"), ("table", "nhà máy", "mill"), ("column", "id", "id"), ("column", "tên", "name"), ("column", "năm xây", "built_year")]


@query(f"SELECT 'arch' AS db_id, kind, source, target FROM {fixtures.values_sql(_PAIRS, 'kind, source, target')} UNION SELECT 'arch', kind, replace(source, ' ', '_'), target FROM {fixtures.values_sql(_PAIRS, 'kind, source, target')}")
def identifier_map(spark, sf):
    """Names of two catalogs by place, those with blanks in both forms."""
    kinds = "db_id string, table_names_original array<string>, column_names_original array<array<string>>"
    one, two = (spark.createDataFrame([(d, t, [[str(a), b] for a, b in c])], kinds) for d, t, c in (_OURS, _THEIRS))
    return translate.build_map(one, two)


@query("SELECT sql_id, sha256(CASE WHEN length(sql) > 40 THEN sql[:40] || chr(10) || '-- (cut)' ELSE sql END) AS cut FROM " + fixtures.STATEMENTS_SQL)
def schema_cut(spark, sf):
    return fixtures.statements(spark).select("sql_id", F.sha2(sqltext.truncate_schema("sql", 40), 256).alias("cut"))


_RAW = [(1, "```sql\nselect count(*) from customer;\n```"), (2, "select select c_name from `customer`; -- done"), (3, "c_name from customer"), (4, "  WITH a AS (SELECT 1)\n SELECT * FROM a ")]
_TEXT = "regexp_replace(trim(replace(regexp_replace(CASE WHEN raw LIKE '%```%' THEN regexp_extract(raw, '(?is)```(?:sql)?\\s*(.*?)\\s*```', 1) ELSE raw END, '(?s);.*$', ''), '`', '')), '\\s+', ' ', 'g')"
_ONE = f"regexp_replace({_TEXT}, '(?i)^(select )+', 'select ')"


@query(f"SELECT id, CASE WHEN regexp_matches({_TEXT}, '(?i)^with\\b') THEN {_TEXT} WHEN regexp_matches({_TEXT}, '(?i)^select\\b') THEN {_ONE} ELSE 'SELECT ' || {_TEXT} END AS sql FROM {fixtures.values_sql(_RAW, 'id, raw')}")
def sql_cleaned(spark, sf):
    """Generators' answers as single statements."""
    return spark.createDataFrame([(k, sqltext.clean_generated(t)) for k, t in _RAW], "id int, sql string")


@query("SELECT c_custkey, lower(trim(c_name)) AS name, lower(trim(c_mktsegment)) AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def result_cells(spark, sf):
    """Cells as results are compared."""
    return tables.table(spark, sf, "customer").select("c_custkey", sqltext.cell_text("c_name", "string").alias("name"), sqltext.cell_text("c_mktsegment", "string").alias("segment"), sqltext.cell_text("c_nationkey", "bigint").alias("nation"))


_ERRORS = [(1, "runtime_error", "a  long\nerror " + "x" * 300), (2, "empty", ""), (3, "timeout", ""), (4, "db_not_found", "")]


@query(f"SELECT id, CASE status WHEN 'empty' THEN 'the query returned no rows' WHEN 'timeout' THEN 'the query took too long' WHEN 'db_not_found' THEN 'there is no such database' ELSE regexp_replace(error, '\\s+', ' ', 'g')[:200] END AS text FROM {fixtures.values_sql(_ERRORS, 'id, status, error')}")
def short_errors(spark, sf):
    return spark.createDataFrame([(k, Result(Status(s), "", error=e).short_error()) for k, s, e in _ERRORS], "id int, text string")


_VALID = {100: False, 101: False, 103: False, 104: False, 7: False}


@query(_rows([(k, _VALID.get(k, True)) for k, _ in _MIXED if k != 10], "sql_id, valid"))
def statements_valid(spark, sf):
    """Which statements parse and resolve, without running them."""
    x = Executor(spark, folders={fixtures.DB: sf})
    return spark.createDataFrame([(k, x.validate(s, fixtures.DB)[0]) for k, s in _MIXED if k != 10], "sql_id int, valid boolean")


# --- links and examples --------------------------------------------------------------------------------------------


@query(f"SELECT v.table_name, v.col_name, v.value FROM ({_VALUES}) v WHERE lower(v.value) = 'building'")
def dictionary_matches(spark, sf):
    """A word of the question whose translation is a stored value."""
    words = spark.createDataFrame([("toà nhà", "BUILDING")], "source string, target string")
    asked = spark.createDataFrame([(1, fixtures.DB, "khách toà_nhà")], "question_id int, db_id string, question string")
    return linking.match_values(asked, values(spark, sf), dictionary=words).where("score = 1.0").select("table_name", "col_name", "value")


_NAMED = [(1, 2, None, 0.9), (1, 2, 5, 0.8), (1, 3, 7, 1.0), (2, 1, 3, 0.8)]
_MEANT = [(1, 2, 5, 0.85), (1, 3, 7, 1.0), (2, 1, 3, 0.7), (2, 1, 4, 0.6)]


def _links(spark, rows, how):
    made = [(q, fixtures.DB, "table" if c is None else "column", t, c, how, s, None) for q, t, c, s in rows]
    return spark.createDataFrame(made, "question_id int, db_id string, kind string, table_idx int, col_idx int, match_type string, score double, span string")


def _null(rows):
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL::INTEGER" if x is None else f"{x}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows) + ") AS v(question_id, table_idx, col_idx, score))"


@query(f"SELECT question_id, table_idx, col_idx, match_type, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id, table_idx, col_idx ORDER BY score DESC, own) AS r FROM (SELECT *, 'exact' AS match_type, 0 AS own FROM {_null(_NAMED)} UNION ALL SELECT *, 'semantic', 1 FROM {_null(_MEANT)})) WHERE r = 1")
def links_merged(spark, sf):
    """Of links by name and by meaning the better one."""
    return linking.merge_links(_links(spark, _NAMED, "exact"), _links(spark, _MEANT, "semantic")).select("question_id", "table_idx", "col_idx", "match_type", "score")


@query(f"SELECT question_id, 'star' AS db_id, list_sort(list(DISTINCT table_idx) FILTER (kind = 'table')) AS table_ids, list_sort(list(DISTINCT col_idx) FILTER (col_idx IS NOT NULL)) AS col_ids FROM (SELECT *, CASE WHEN col_idx IS NULL THEN 'table' ELSE 'column' END AS kind FROM ({_LINKED})) GROUP BY question_id HAVING count(*) FILTER (kind = 'table') > 0 AND count(col_idx) > 0")
def relevant_ids(spark, sf):
    links = linking.link(fixtures.questions(spark), star(spark, sf), semantic=False)
    return linking.relevant_ids(links).where("size(table_ids) > 0 and size(col_ids) > 0")


@query(f"WITH kept AS ({_KEPT}), linked AS ({_LINKED}), cols AS (SELECT question_id, col_idx FROM linked WHERE col_idx IS NOT NULL UNION SELECT question_id, col_idx FROM kept k JOIN {_CATALOG} c ON c.table_idx = k.table_idx AND pk = 1 UNION SELECT k.question_id, unnest([f.src_col_idx, f.dst_col_idx]) FROM kept k JOIN {_FKS} f ON f.a = k.table_idx JOIN kept m ON m.question_id = k.question_id AND m.table_idx = f.b) SELECT t.question_id, n_tables, n_columns FROM (SELECT question_id, count(*) AS n_tables FROM kept GROUP BY 1) t JOIN (SELECT question_id, count(*) AS n_columns FROM cols GROUP BY 1) c ON t.question_id = c.question_id")
def pruned_sizes(spark, sf):
    """How many tables and columns pruning leaves for each question."""
    c = star(spark, sf)
    kept, cols = pruning.prune(settle(linking.link(fixtures.questions(spark), c, semantic=False)), c)
    return kept.groupBy("question_id").agg(F.count("*").alias("n_tables")).join(cols.groupBy("question_id").agg(F.count("*").alias("n_columns")), "question_id")


@query("SELECT 'star' AS db_id")
def databases(spark, sf):
    return spark.createDataFrame([(d,) for d in star(spark, sf).databases()], "db_id string")


_SHOTS = [(k, q, s, 1.0 - k / 10) for k, (_, _, q, _, s) in enumerate(fixtures.PREDICTIONS)]
_SHOTS_SQL = fixtures.values_sql(_SHOTS, "id, question, query, score")
_SHOT = "'-- Question: ' || question || chr(10) || query || chr(10) || chr(10)"


def _block(spark) -> str:
    return retrieval.few_shot_block(spark.createDataFrame(_SHOTS, "id int, question string, query string, score double"))


@query(f"SELECT string_agg({_SHOT}, '' ORDER BY score DESC, id) AS block FROM {_SHOTS_SQL}")
def few_shot_text(spark, sf):
    return spark.createDataFrame([(_block(spark),)], "block string")


@query(f"SELECT string_agg(shot, '' ORDER BY id) AS block FROM (SELECT id, {_SHOT} AS shot, sum(length({_SHOT})) OVER (ORDER BY id) AS used FROM {_SHOTS_SQL}) WHERE used <= 4 * 100 - 50")
def examples_fitted(spark, sf):
    """Whole examples that a budget of 100 tokens leaves room for beside 50 characters."""
    return spark.createDataFrame([(prompt.fit_examples(_block(spark), 50, 100),)], "block string")


# --- generators ----------------------------------------------------------------------------------------------------


def _scripted(script):
    """A transport that gives or raises what a list says, and the list of pauses taken."""
    left, pauses = list(script), []

    def send(url, headers, body, timeout):
        now = left.pop(0)
        if isinstance(now, Exception):
            raise now
        return {"choices": [{"message": {"content": now}}], "usage": {"prompt_tokens": 7, "completion_tokens": len(now)}}

    return send, pauses


@query(_rows([(1, "select 1", "", 1), (2, "select 2", "5.0", 1), (3, "select 3", "1.0 2.0", 1), (4, "SELECT 1", "1.0 2.0", 0)], "id, sql, pauses, calls"))
def generator_retries(spark, sf):
    """Answers of a server that works, is busy, fails twice, and never works."""
    out = []
    for k, script in enumerate((["select 1"], [generate.TooMany(5.0), "```sql\nselect 2\n```"], [OSError(), ValueError(), "select 3"], [OSError()] * 3), 1):
        send, pauses = _scripted(script)
        g = generate.ChatGenerator("http://localhost/v1", "m", attempts=3, transport=send, sleep=pauses.append)
        out.append((k, g.generate("q"), " ".join(str(float(p)) for p in pauses), g.usage.calls))
    return spark.createDataFrame(out, "id int, sql string, pauses string, calls int")


@query("SELECT count(*) AS calls, sum(ceil(length('about ' || question) / 4.0))::BIGINT AS prompt_tokens, sum(ceil(length(query) / 4.0))::BIGINT AS answer_tokens FROM " + fixtures.values_sql([(q, s) for _, _, q, s in _ASKED], "question, query"))
def generator_usage(spark, sf):
    """What replaying the inline answers uses, by rule of thumb."""
    g = generate.ReplayGenerator({q: s for _, _, q, s in _ASKED})
    for _, _, q, _ in _ASKED:
        g.generate(f"about {q}")
    return spark.createDataFrame([(g.usage.calls, g.usage.prompt_tokens, g.usage.answer_tokens)], "calls long, prompt_tokens long, answer_tokens long")


@query("SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY'")
def value_chosen(spark, sf):
    """A literal that resembles no stored value, which the generator maps to one; the repaired statement's result."""
    send, _ = _scripted(["MACHINERY"])
    g, c = generate.ChatGenerator("http://localhost/v1", "m", transport=send), star(spark, sf)
    r = repair.Repairer(Executor(spark, folders={fixtures.DB: sf}, timeout=60.0), g, values_of=lambda d, col: read_column(spark, sf, c, col))
    o = r.repair("select count(*) as n from customer where c_mktsegment = 'xyz' having count(*) > 0", fixtures.DB, "customers that buy engines", "")
    return spark.createDataFrame([(o.result.rows[0]["n"],)], "n long")


@query("SELECT count(*) AS n, true AS success FROM region")
def repair_untranslated(spark, sf):
    """A translation that fails leaves the statement as it is."""

    def fails(sql, db_id):
        raise KeyError(db_id)

    r = repair.Repairer(Executor(spark, folders={fixtures.DB: sf}, timeout=60.0), generate.ReplayGenerator({}), translate=fails)
    o = r.repair("select count(*) as n from region", fixtures.DB, "regions", "")
    return spark.createDataFrame([(o.result.rows[0]["n"], o.success)], "n long, success boolean")


@query(_rows([("select r_name from region", "syntax_error", 2)], "executed, first_status, tries"))
def repair_history(spark, sf):
    """A statement that does not parse, the generator's next one, and what is remembered."""
    g = generate.ReplayGenerator({"all regions": "select r_name from region"})
    o = repair.Repairer(Executor(spark, folders={fixtures.DB: sf}, timeout=60.0), g).repair("select r_name from (region", fixtures.DB, "all regions", "")
    return spark.createDataFrame([(o.executed, o.attempts[0].status.value, len(o.attempts) + 1)], "executed string, first_status string, tries int")


# --- what has a plainer stand-in than its default: embeddings of letters, values by whole words ----------------------

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _by_letters(text):
    """Counts of the letters a to z: an embedder that SQL has too."""
    return F.array(*[(F.length(F.lower(text)) - F.length(F.replace(F.lower(text), F.lit(x), F.lit("")))).cast("float") for x in _LETTERS])


def _letters_sql(text: str) -> str:
    return "[" + ", ".join(f"(length(lower({text})) - length(replace(lower({text}), '{x}', '')))::DOUBLE" for x in _LETTERS) + "]"


_NAMES = f"SELECT DISTINCT 'table' AS kind, table_idx, NULL::INTEGER AS col_idx, table_name AS name FROM {_CATALOG} UNION ALL SELECT 'column', table_idx, col_idx, col_name FROM {_CATALOG}"


@query(f"SELECT question_id, kind, table_idx, col_idx, round(score, 6) AS score FROM (SELECT question_id, kind, table_idx, col_idx, list_cosine_similarity(q.v, n.v) AS score FROM (SELECT question_id, {_letters_sql('question')} AS v FROM {fixtures.QUESTIONS_SQL}) q, (SELECT *, {_letters_sql('name')} AS v FROM ({_NAMES})) n) WHERE score >= 0.8")
def link_by_letters(spark, sf):
    """Links by the likeness of embeddings, with the embedder given."""
    links = linking.semantic_links(fixtures.questions(spark), star(spark, sf), 0.8, _by_letters)
    return links.select("question_id", "kind", "table_idx", "col_idx", F.round("score", 6).alias("score"))


_SOLVED = fixtures.values_sql([(p[0], p[2], p[4]) for p in fixtures.PREDICTIONS], "id, question, query")


@query(f"SELECT id, question, query, score FROM (SELECT id, question, query, round(list_cosine_similarity({_letters_sql('question')}, {_letters_sql(chr(39) + 'orders by segments' + chr(39))}), 6) AS score FROM {_SOLVED}) ORDER BY score DESC, id LIMIT 3")
def examples_by_letters(spark, sf):
    """The nearest solved examples, masked and embedded by a given embedder; their skeletons all differ here."""
    solved = fixtures.predictions(spark).select(F.col("index").alias("id"), "db_id", "question", F.col("gold").alias("query"))
    near = retrieval.retrieve(retrieval.build_examples(solved, _by_letters), retrieval.embed_query(spark, "orders by segments", _by_letters), 3)
    return near.select("id", "question", "query", F.round("score", 6).alias("score"))


_HITS = f"SELECT *, row_number() OVER (PARTITION BY question_id, table_name, col_name ORDER BY score DESC, value) AS rank FROM (SELECT question_id, db_id, table_name, col_name, value, max(score) AS score FROM ({_EXACT} UNION ALL SELECT *, 0.8::DOUBLE FROM ({_PARTIAL})) GROUP BY ALL)"


def _by_words(spark, sf):
    """Values matched by whole words alone: no ratio reaches the threshold."""
    return linking.match_values(fixtures.questions(spark), values(spark, sf), threshold=1.01)


@query(f"SELECT question_id, table_name, col_name, value, score, rank::INTEGER AS rank FROM ({_HITS}) WHERE rank <= 3")
def cell_match_words(spark, sf):
    return _by_words(spark, sf).select("question_id", "table_name", "col_name", "value", "score", "rank")


@query(f"SELECT question_id, table_idx, col_idx, score, value AS span FROM ({_HITS}) h JOIN {_CATALOG} c ON h.table_name = c.table_name AND h.col_name = c.col_name WHERE rank = 1")
def link_cells(spark, sf):
    """The best value of each column as a link."""
    return linking.cell_links(_by_words(spark, sf), star(spark, sf)).select("question_id", "table_idx", "col_idx", "score", "span")


@query(f"SELECT question_id, table_name || '.' || col_name AS \"column\", value FROM ({_HITS}) WHERE rank = 1")
def value_hints_words(spark, sf):
    """The best values of linked columns, here of those that values link."""
    c, hits = star(spark, sf), settle(_by_words(spark, sf))
    return linking.value_hints(hits, linking.cell_links(hits, c), c).select("question_id", F.explode("hints").alias("column", "value"))
