"""Text operators over documents, and SQL-text operators over inline statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqltext, text
from ..plans.translate import translate_statements
from ..sources.tables import table
from . import fixtures

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_PUNCT = "\\!\\\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]\\^_`{|}~"
_NORM = "trim(regexp_replace(lower({}), '[" + _PUNCT + "]', '', 'g'))"
_TOKENS = "list_filter(regexp_split_to_array(" + _NORM + ", '\\s+'), lambda t: length(t) > 1)"


_MASKED = r"""trim(regexp_replace(regexp_replace(regexp_replace(sql, '\b\d+(\.\d+)?\b', 'NUM', 'g'), '''[^'']*''|"[^"]*"', 'STR', 'g'), '\s+', ' ', 'g'))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, sha256(" + _NORM.replace("{}", "text") + ") AS norm_sha FROM documents")
def norm_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.normalise("text"), 256).alias("norm_sha"))


@query("SELECT doc_id, len(" + _TOKENS.replace("{}", "text") + ")::INTEGER AS n_tokens FROM documents")
def tokens_len_gt1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.tokens("text")).alias("n_tokens"))


_QT = "list_filter(regexp_split_to_array(trim(regexp_replace(lower(question), '[" + _PUNCT.replace("_", "") + "]', '', 'g')), '\\s+'), lambda t: length(t) > 1 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "], t))"


@query("SELECT question_id, " + _QT + " AS words FROM " + fixtures.QUESTIONS_SQL)
def question_words(spark, sf):
    return fixtures.questions(spark).select("question_id", text.question_tokens("question").alias("words"))


_GRAMS = f"SELECT question_id, n, i AS pos, array_to_string(list_slice(w, i + 1, i + n), ' ') AS gram FROM (SELECT question_id, w, n, unnest(range(0, len(w)::INTEGER - n + 1))::INTEGER AS i FROM (SELECT question_id, w, unnest(range(1, 6))::INTEGER AS n FROM (SELECT question_id, {_QT} AS w FROM {fixtures.QUESTIONS_SQL})))"


@query(_GRAMS)
def ngrams_1_5(spark, sf):
    return fixtures.questions(spark).select("question_id", F.inline(text.ngrams(text.question_tokens("question"), 5)))


@query(f"SELECT doc_id, sha256({_MASKED.replace('sql', 'text')}) AS masked_sha FROM documents")
def mask_literals(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.mask_literals("text"), 256).alias("masked_sha"))


@query("SELECT question_id, regexp_extract_all(question, '[''\"]([^''\"]+)[''\"]', 1) AS spans FROM " + fixtures.QUESTIONS_SQL)
def quoted_spans(spark, sf):
    return fixtures.questions(spark).select("question_id", text.quoted_spans("question").alias("spans"))


_CASED = _QT.replace("lower(question)", "question").replace("], t))", "], lower(t)))")
_RUNS = f"SELECT question_id, 5 - n AS rank, i AS place, trim(replace(array_to_string(list_slice(w, i + 1, i + n), ' '), '_', ' ')) AS c FROM (SELECT *, unnest(range(0, len(w)::INTEGER - n + 1))::INTEGER AS i FROM (SELECT question_id, {_CASED} AS w, unnest(range(1, 5))::INTEGER AS n FROM {fixtures.QUESTIONS_SQL}))"
_QUOTED = f"SELECT question_id, 0 AS rank, generate_subscripts(s, 1) AS place, trim(unnest(s)) AS c FROM (SELECT question_id, regexp_extract_all(question, '[''\"]([^''\"]+)[''\"]', 1) AS s FROM {fixtures.QUESTIONS_SQL})"
_FIRST = f"SELECT *, row_number() OVER (PARTITION BY question_id, lower(c) ORDER BY rank, place) AS copy FROM ({_QUOTED} UNION ALL {_RUNS}) WHERE length(c) >= 2"


@query(f"SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY rank, place) - 1)::INTEGER AS pos, c AS candidate FROM ({_FIRST}) WHERE copy = 1")
def value_candidates(spark, sf):
    return fixtures.questions(spark).select("question_id", F.posexplode(text.value_candidates("question")).alias("pos", "candidate"))


@query("SELECT question_id, nfc_normalize(question) AS nfc FROM " + fixtures.QUESTIONS_SQL)
def unicode_nfc(spark, sf):
    return fixtures.questions(spark).select("question_id", text.nfc("question").alias("nfc"))


_STRING = "''(?:[^'']|'''')*''|\"[^\"]*\""


def _upper(part: str) -> str:
    for k in sqltext.KEYWORDS:
        part = f"regexp_replace({part}, '(?i)\\b{k}\\b', '{k}', 'g')"
    return part


def normal_sql(column: str) -> str:
    """``sqltext.normalize`` in SQL: what is outside of strings changed, then put together again."""
    bare = f"regexp_replace(trim({column}), '[;\\s]+$', '')"
    parts = f"list_transform(regexp_split_to_array({bare}, '{_STRING}'), lambda p: regexp_replace({_upper('p')}, '\\s+', ' ', 'g'))"
    pairs = f"list_zip({parts}, regexp_extract_all({bare}, '{_STRING}'))"
    return f"trim(array_to_string(list_transform({pairs}, lambda x: coalesce(x[1], '') || coalesce(x[2], '')), ''))"


_TOKEN = _STRING + "|[\\p{L}_][\\p{L}\\p{N}_]*(?:\\.(?:\\*|[\\p{L}\\p{N}_]+))*|\\d+(?:\\.\\d+)?|(?s:.)"


def skeleton_sql(column: str) -> str:
    """``sqltext.skeleton`` in SQL, token by token."""
    one = f"CASE WHEN NOT list_contains({list(sqltext.KEYWORDS)!r}, t) AND regexp_matches(t, '^[\\p{{L}}\\p{{N}}_''\"]') THEN '_' ELSE t END"
    return f"array_to_string(list_transform(regexp_extract_all({normal_sql(column)}, '{_TOKEN}'), lambda t: {one}), '')"


@query(f"SELECT sql_id, {normal_sql('sql')} AS normalized FROM {fixtures.STATEMENTS_SQL}")
def sql_normalize(spark, sf):
    return fixtures.statements(spark).select("sql_id", sqltext.normalize("sql").alias("normalized"))


@query(f"SELECT sql_id, {_MASKED} AS skeleton FROM {fixtures.STATEMENTS_SQL}")
def sql_skeleton_v1(spark, sf):
    return fixtures.statements(spark).select("sql_id", sqltext.literal_skeleton("sql").alias("skeleton"))


@query(f"SELECT sql_id, {skeleton_sql('sql')} AS skeleton FROM {fixtures.STATEMENTS_SQL}")
def sql_skeleton_v2(spark, sf):
    return fixtures.statements(spark).select("sql_id", sqltext.skeleton("sql").alias("skeleton"))


_FLAGS = r"regexp_matches(sql, '(?i)\bJOIN\b') AS has_join, len(regexp_extract_all(sql, '(?i)\bSELECT\b')) >= 2 AS has_subquery, regexp_matches(sql, '(?i)\b(?:COUNT|SUM|AVG|MIN|MAX)\s*\(') AS has_aggregation, regexp_matches(sql, '(?i)\bGROUP\s+BY\b') AS has_group_by, regexp_matches(sql, '(?i)\bORDER\s+BY\b') AS has_order_by"


@query(f"SELECT sql_id, {_FLAGS} FROM {fixtures.STATEMENTS_SQL}")
def sql_flags(spark, sf):
    return fixtures.statements(spark).select("sql_id", *[f("sql").alias(f.__name__) for f in (sqltext.has_join, sqltext.has_subquery, sqltext.has_aggregation, sqltext.has_group_by, sqltext.has_order_by)])


@query(f"SELECT sql_id, CASE WHEN has_subquery OR joins >= 3 THEN 'extra' WHEN joins >= 2 OR (has_join AND has_group_by) THEN 'hard' WHEN has_join OR has_aggregation OR has_group_by THEN 'medium' ELSE 'easy' END AS level FROM (SELECT sql_id, {_FLAGS}, len(regexp_extract_all(sql, '(?i)\\bJOIN\\b')) AS joins FROM {fixtures.STATEMENTS_SQL})")
def sql_complexity(spark, sf):
    return fixtures.statements(spark).select("sql_id", sqltext.complexity("sql").alias("level"))


_CLAUSE = r"upper(trim(regexp_replace(regexp_extract(sql, '(?is)\b{}\b(.*?)(?:\b(?:FROM|WHERE|GROUP|HAVING|ORDER|LIMIT|JOIN|UNION)\b|$)', 1), '\s+', ' ', 'g'))) AS {}"
_NAMES = {"SELECT": "c_select", "WHERE": "c_where", "GROUP BY": "c_group", "HAVING": "c_having", "ORDER BY": "c_order", "LIMIT": "c_limit", "JOIN": "c_join"}


@query("SELECT sql_id, " + ", ".join(_CLAUSE.replace("{}", k, 1).replace("{}", v, 1) for k, v in _NAMES.items()) + " FROM " + fixtures.STATEMENTS_SQL)
def sql_clauses(spark, sf):
    return fixtures.statements(spark).select("sql_id", *[sqltext.clause("sql", k).alias(v) for k, v in _NAMES.items()])


@query(f"SELECT sql_id, unnest(list_filter({list(sqltext.KEYWORDS)!r}, lambda k: regexp_matches(sql, '(?i)\\b' || k || '\\b'))) AS keyword FROM {fixtures.STATEMENTS_SQL}")
def sql_keywords(spark, sf):
    return fixtures.statements(spark).select("sql_id", F.explode(sqltext.keywords("sql")).alias("keyword"))


_PAIR = "([\\p{L}_][\\p{L}\\p{N}_.]*)\\s*(?:=|!=|<>|(?i:\\bLIKE\\b))\\s*(?:''([^'']*)''|\"([^\"]*)\")"


@query(f"SELECT sql_id, split_part(c, '.', -1) AS \"column\", CASE WHEN a <> '' THEN a ELSE b END AS literal FROM (SELECT sql_id, unnest(regexp_extract_all(sql, '{_PAIR}', 1)) AS c, unnest(regexp_extract_all(sql, '{_PAIR}', 2)) AS a, unnest(regexp_extract_all(sql, '{_PAIR}', 3)) AS b FROM {fixtures.STATEMENTS_SQL})")
def sql_literals(spark, sf):
    return fixtures.statements(spark).select("sql_id", F.inline(sqltext.literal_pairs("sql")))


@query()
def sql_postprocess(spark, sf):
    return spark.createDataFrame(fixtures.GENERATED, "id int, raw string").select("id", sqltext.post_process("raw").alias("sql"))


def english_sql(column: str) -> str:
    """A statement with the inline map's names in English, up to its first string."""
    head = f"split_part({column}, '\"', 1)"
    tail = f"{column}[length({head}) + 1:]"
    for source, target in sorted(((m[2], m[3]) for m in fixtures.MAP if m[2] != m[3]), key=lambda m: -len(m[0])):
        head = f"replace({head}, '{source}', '{target}')"
    return f"CASE WHEN db_id = 'arch' THEN {head} || {tail} ELSE {column} END"


_VI = fixtures.values_sql(fixtures.VI_STATEMENTS, "sql_id, db_id, sql")


@query(f"SELECT sql_id, {english_sql('sql')} AS translated FROM {_VI}")
def sql_translate(spark, sf):
    names = spark.createDataFrame(fixtures.MAP, "db_id string, kind string, source string, target string")
    return translate_statements(spark.createDataFrame(fixtures.VI_STATEMENTS, "sql_id int, db_id string, sql string"), names).select("sql_id", "translated")
