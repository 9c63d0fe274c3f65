"""Catalog, values, linking, graph and pruning over the star schema and inline questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, linking, masking, pruning
from ..session import settle
from ..sources import catalog as catalogs
from ..sources.values import cell_values as read_values
from ..sources.values import dump
from . import fixtures

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Tables whose stored values are searched: those of the star schema.
STAR = {k: v for k, v in catalogs.STAR_KEYS.items() if k not in ("events", "documents", "labels")}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def star(spark, sf):
    return catalogs.from_tables(spark, sf, fixtures.DB, STAR)


#: The star schema's catalog, as the oracles need it.
_COLUMNS = {
    "region": "r_regionkey:INTEGER r_name:TEXT", "nation": "n_nationkey:INTEGER n_name:TEXT n_regionkey:INTEGER",
    "customer": "c_custkey:INTEGER c_name:TEXT c_nationkey:INTEGER c_acctbal:DOUBLE c_mktsegment:TEXT",
    "supplier": "s_suppkey:INTEGER s_name:TEXT s_nationkey:INTEGER s_acctbal:DOUBLE",
    "part": "p_partkey:INTEGER p_name:TEXT p_brand:TEXT p_type:TEXT p_size:INTEGER p_retailprice:DOUBLE",
    "orders": "o_orderkey:INTEGER o_custkey:INTEGER o_orderstatus:TEXT o_totalprice:DOUBLE o_orderdate:TIMESTAMP o_orderpriority:TEXT",
    "lineitem": "l_orderkey:INTEGER l_partkey:INTEGER l_suppkey:INTEGER l_linenumber:INTEGER l_quantity:DOUBLE l_extendedprice:DOUBLE l_discount:DOUBLE l_tax:DOUBLE l_returnflag:TEXT l_linestatus:TEXT l_shipdate:TIMESTAMP",
}
_ROWS = [(i, t, *c.split(":"), c.split(":")[0] == STAR[t]) for i, (t, cs) in enumerate(_COLUMNS.items()) for c in cs.split()]
_CATALOG = fixtures.values_sql([(k, *r[:4], int(r[4])) for k, r in enumerate(_ROWS, 1)], "col_idx, table_idx, table_name, col_name, col_type, pk")
_AT = {f"{r[1]}.{r[2]}": (k, r[0]) for k, r in enumerate(_ROWS, 1)}
_FK_ROWS = [(*_AT[a], *_AT[b]) for a, b in catalogs.STAR_FKS if a in _AT and b in _AT]
_FKS = fixtures.values_sql(_FK_ROWS, "src_col_idx, a, dst_col_idx, b")
_EDGES = f"(SELECT DISTINCT a, b FROM {_FKS} UNION SELECT b, a FROM {_FKS})"


@query(f"SELECT 'star' AS db_id, col_idx, table_idx, table_name, col_name, col_type, pk = 1 AS is_pk FROM {_CATALOG}")
def catalog_columns(spark, sf):
    return star(spark, sf).named().select("db_id", "col_idx", "table_idx", "table_name", "col_name", "col_type", "is_pk")


@query(f"SELECT 'star' AS db_id, count(DISTINCT table_idx) AS tables, count(*) AS columns, (SELECT count(*) FROM {_FKS}) AS fks FROM {_CATALOG}")
def profile_catalog(spark, sf):
    return catalogs.profile(star(spark, sf))


_TEXT = [(t, c.split(":")[0]) for t, cs in _COLUMNS.items() for c in cs.split() if c.endswith(":TEXT")]
_VALUES = " UNION ALL ".join(f"(SELECT DISTINCT 'star' AS db_id, '{t}' AS table_name, '{c}' AS col_name, {c} AS value FROM {t} WHERE {c} IS NOT NULL ORDER BY {c} LIMIT 50)" for t, c in _TEXT)


_KEPT_VALUES: dict = {}


def values(spark, sf):
    """Stored values of the star schema, read once in an application and kept."""
    at = spark.sparkContext.applicationId, sf
    if at not in _KEPT_VALUES:
        _KEPT_VALUES[at] = settle(read_values(spark, sf, star(spark, sf)))
    return _KEPT_VALUES[at]


@query(_VALUES)
def cell_values(spark, sf):
    return read_values(spark, sf, star(spark, sf))


_LINES = f"SELECT db_id, table_name, col_name, table_name || '.' || col_name || ': ' || string_agg(value, ', ' ORDER BY value) AS line FROM (SELECT *, row_number() OVER (PARTITION BY table_name, col_name ORDER BY value) AS r FROM ({_VALUES})) WHERE r <= 20 GROUP BY db_id, table_name, col_name"


@query(f"SELECT * FROM (SELECT *, CAST(sum(length(line)) OVER (ORDER BY table_name, col_name ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM ({_LINES})) WHERE used <= 3000")
def cell_value_dump(spark, sf):
    return dump(values(spark, sf))


_P = "[\\!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]\\^_`{|}~]"
_KEY = "trim(regexp_replace(lower(value), '" + _P + "', '', 'g'))"
_QN = "trim(regexp_replace(lower(question), '" + _P + "', '', 'g'))"
_EXACT = f"SELECT DISTINCT question_id, q.db_id, table_name, col_name, value, 1.0::DOUBLE AS score FROM {fixtures.QUESTIONS_SQL} q JOIN ({_VALUES}) v ON {_KEY} <> '' AND contains(' ' || regexp_replace({_QN}, '\\s+', ' ', 'g') || ' ', ' ' || {_KEY} || ' ')"


@query(_EXACT)
def cell_match_exact(spark, sf):
    return linking.exact_values(fixtures.questions(spark), values(spark, sf))


_WORDS = f"list_filter(regexp_split_to_array({_QN}, '\\s+'), lambda t: length(t) > 2)"
_PARTIAL = f"SELECT DISTINCT question_id, db_id, table_name, col_name, value FROM (SELECT q.question_id, q.db_id, table_name, col_name, value FROM (SELECT question_id, db_id, unnest({_WORDS}) AS word FROM {fixtures.QUESTIONS_SQL}) q JOIN (SELECT *, unnest(regexp_split_to_array({_KEY}, '\\s+')) AS word FROM ({_VALUES}) WHERE {_KEY} <> '') v ON q.word = v.word)"


@query(f"SELECT *, 0.8::DOUBLE AS score FROM ({_PARTIAL} EXCEPT SELECT question_id, db_id, table_name, col_name, value FROM ({_EXACT}))")
def cell_match_partial(spark, sf):
    return linking.partial_values(fixtures.questions(spark), values(spark, sf))


_NEAR = f"len(list_filter({_WORDS}, lambda t: contains(t, {_KEY}) OR contains({_KEY}, t))) > 0"


@query(f"SELECT * FROM (SELECT question_id, q.db_id, table_name, col_name, value, CASE WHEN contains({_QN}, {_KEY}) THEN 1.0::DOUBLE WHEN {_NEAR} THEN 0.8::DOUBLE END AS score FROM {fixtures.QUESTIONS_SQL} q JOIN ({_VALUES}) v ON {_KEY} <> '') WHERE score IS NOT NULL")
def cell_match_legacy(spark, sf):
    return linking.legacy_values(fixtures.questions(spark), values(spark, sf))


@query()
def cell_match_fuzzy(spark, sf):
    return linking.fuzzy_values(fixtures.questions(spark), values(spark, sf))


@query()
def cell_match_topk(spark, sf):
    return linking.match_values(fixtures.questions(spark), values(spark, sf))


from .textual import _GRAMS, _QT  # noqa: E402


def _names_sql(kind: str) -> str:
    name, keys = ("table_name", "table_idx, NULL::INTEGER AS col_idx") if kind == "table" else ("col_name", "table_idx, col_idx")
    words = _QT.replace("lower(question)", f"lower({name})")
    parts = f"SELECT DISTINCT table_idx, col_idx, array_to_string(w, ' ') AS whole, array_to_string(list_slice(w, i + 1, i + n), ' ') AS gram FROM (SELECT *, unnest(range(0, len(w)::INTEGER - n + 1))::INTEGER AS i FROM (SELECT *, unnest(range(1, 6))::INTEGER AS n FROM (SELECT DISTINCT {keys}, {words} AS w FROM {_CATALOG})))"
    hits = f"SELECT g.question_id, p.table_idx, p.col_idx, CASE WHEN g.gram = p.whole THEN 'exact' ELSE 'partial' END AS match_type, CASE WHEN g.gram = p.whole THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score, g.gram AS span, row_number() OVER (PARTITION BY g.question_id, p.table_idx, p.col_idx ORDER BY CASE WHEN g.gram = p.whole THEN 0 ELSE 1 END, g.n DESC, g.pos, g.gram) AS r FROM ({_GRAMS}) g JOIN ({parts}) p ON g.gram = p.gram"
    return f"SELECT question_id, 'star' AS db_id, '{kind}' AS kind, table_idx, col_idx, match_type, score, span FROM ({hits}) WHERE r = 1"


@query(_names_sql("column"))
def link_columns(spark, sf):
    return linking.name_links(fixtures.questions(spark), star(spark, sf)).where("kind = 'column'")


@query(_names_sql("table"))
def link_tables(spark, sf):
    return linking.name_links(fixtures.questions(spark), star(spark, sf)).where("kind = 'table'")


_NUM = r"regexp_matches(question, '\b\d+(?:[.,]\d+)?\b')"
_DATE = r"regexp_matches(question, '\b\d{4}[-/]\d{2}[-/]\d{2}\b|\b\d{2}/\d{2}/\d{4}\b|(?i:\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{4}\b)')"


@query(f"SELECT question_id, 'star' AS db_id, table_idx, col_idx, 0.8::DOUBLE AS score FROM {fixtures.QUESTIONS_SQL} JOIN {_CATALOG} ON ({_NUM} AND col_type IN ('INTEGER', 'DOUBLE')) OR ({_DATE} AND col_type = 'TIMESTAMP')")
def link_num_date(spark, sf):
    return linking.num_date_links(fixtures.questions(spark), star(spark, sf)).select("question_id", "db_id", "table_idx", "col_idx", "score")


@query()
def link_semantic(spark, sf):
    return linking.semantic_links(fixtures.questions(spark), star(spark, sf), 0.4).withColumn("score", F.round("score", 6))


@query()
def link_all(spark, sf):
    return linking.link(fixtures.questions(spark), star(spark, sf), values(spark, sf))


@query()
def link_documents(spark, sf):
    q, c = fixtures.questions(spark), star(spark, sf)
    return linking.link_documents(q, linking.link(q, c, values(spark, sf)), c)


@query()
def value_hints(spark, sf):
    q, c, v = fixtures.questions(spark), star(spark, sf), values(spark, sf)
    hits = linking.match_values(q, v)
    return linking.value_hints(hits, linking.cell_links(hits, c), c).select("question_id", F.explode("hints").alias("column", "value"))


# --- graph ---------------------------------------------------------------------------------------------------------


@query(f"SELECT 'star' AS db_id, a AS table_idx, list_sort(list(DISTINCT b)) AS neighbors FROM {_EDGES} GROUP BY a")
def fk_neighbors(spark, sf):
    return graph.neighbors(graph.edges(star(spark, sf)))


@query(f"WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), w AS (SELECT 0 AS table_idx, 0 AS hops UNION SELECT e.b, w.hops + 1 FROM w JOIN e ON e.a = w.table_idx WHERE w.hops < 3) SELECT 'star' AS db_id, table_idx, min(hops) AS hops FROM w GROUP BY table_idx")
def fk_reachable(spark, sf):
    seeds = spark.createDataFrame([(fixtures.DB, 0)], "db_id string, table_idx int")
    return graph.reachable(graph.edges(star(spark, sf)), seeds, 3)


_G = fixtures.values_sql(fixtures.GRAPH, "a, b")
_BOTH = f"(SELECT a, b FROM {_G} UNION ALL SELECT b, a FROM {_G})"


@query(f"WITH RECURSIVE e AS (SELECT * FROM {_BOTH}), w AS (SELECT s AS src, [s] AS path, s AS here, 0 AS hops FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS s) UNION ALL SELECT src, list_append(path, b), b, hops + 1 FROM w JOIN e ON e.a = w.here WHERE hops < 6 AND NOT list_contains(path, b)), r AS (SELECT src, here AS dst, path, hops, min(hops) OVER (PARTITION BY src, here) AS least FROM w WHERE src < here) SELECT src, dst, path, hops FROM r WHERE hops = least")
def fk_shortest_paths(spark, sf):
    g = spark.createDataFrame([("g", a, b) for x, y in fixtures.GRAPH for a, b in ((x, y), (y, x))], "db_id string, a int, b int")
    pairs = spark.createDataFrame([("g", a, b) for a in range(7) for b in range(a + 1, 7)], "db_id string, src int, dst int")
    return graph.shortest_paths(g, pairs).select("src", "dst", "path", "hops")


_STRONG = f"SELECT DISTINCT question_id, table_idx FROM (SELECT question_id, table_idx FROM ({_names_sql('table')}) UNION ALL SELECT question_id, table_idx FROM ({_names_sql('column')}) WHERE match_type = 'exact')"
_WALKS = f"SELECT s AS src, [s] AS path, s AS here, 0 AS hops FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS s) UNION ALL SELECT src, list_append(path, b), b, hops + 1 FROM w JOIN {_EDGES} e ON e.a = w.here WHERE hops < 6 AND NOT list_contains(path, b)"


@query(f"WITH RECURSIVE w AS ({_WALKS}), least AS (SELECT src, here AS dst, path FROM (SELECT *, min(hops) OVER (PARTITION BY src, here) AS fewest FROM w) WHERE hops = fewest), seeds AS ({_STRONG}), counts AS (SELECT q.question_id, count(table_idx) AS n FROM {fixtures.QUESTIONS_SQL} q LEFT JOIN seeds s ON s.question_id = q.question_id GROUP BY q.question_id) "
       f"SELECT question_id, 'star' AS db_id, table_idx, 'all' AS how FROM counts, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS table_idx) WHERE n = 0 "
       f"UNION SELECT s.question_id, 'star', unnest(list_append((SELECT list(b) FROM {_EDGES} e WHERE e.a = s.table_idx), s.table_idx)), 'near' FROM seeds s JOIN counts c ON c.question_id = s.question_id AND n = 1 "
       f"UNION SELECT a.question_id, 'star', unnest(l.path), 'path' FROM seeds a JOIN seeds b ON a.question_id = b.question_id AND a.table_idx < b.table_idx JOIN least l ON l.src = a.table_idx AND l.dst = b.table_idx")  # fmt: skip
def graph_enhance(spark, sf):
    q, c = fixtures.questions(spark), star(spark, sf)
    return graph.enhance(q, linking.link(q, c, semantic=False), c)


_LINKED = f"SELECT question_id, table_idx, col_idx FROM ({_names_sql('table')}) UNION SELECT question_id, table_idx, col_idx FROM ({_names_sql('column')}) UNION SELECT question_id, table_idx, col_idx FROM (SELECT question_id, table_idx, col_idx FROM {fixtures.QUESTIONS_SQL} JOIN {_CATALOG} ON ({_NUM} AND col_type IN ('INTEGER', 'DOUBLE')) OR ({_DATE} AND col_type = 'TIMESTAMP'))"
_KEPT = f"SELECT DISTINCT question_id, table_idx FROM ({_LINKED}) UNION SELECT l.question_id, e.b FROM ({_LINKED}) l JOIN {_EDGES} e ON e.a = l.table_idx"


@query(f"SELECT question_id, 'star' AS db_id, table_idx FROM ({_KEPT})")
def prune_tables(spark, sf):
    q, c = fixtures.questions(spark), star(spark, sf)
    return pruning.pruned_tables(linking.link(q, c, semantic=False), c)


@query(f"SELECT DISTINCT question_id, 'star' AS db_id, col_idx FROM (SELECT question_id, col_idx FROM ({_LINKED}) WHERE col_idx IS NOT NULL UNION SELECT question_id, col_idx FROM ({_KEPT}) k JOIN {_CATALOG} c ON c.table_idx = k.table_idx AND pk = 1 UNION SELECT k.question_id, unnest([f.src_col_idx, f.dst_col_idx]) FROM ({_KEPT}) k JOIN {_FKS} f ON f.a = k.table_idx JOIN ({_KEPT}) m ON m.question_id = k.question_id AND m.table_idx = f.b)")
def prune_columns(spark, sf):
    q, c = fixtures.questions(spark), star(spark, sf)
    links = linking.link(q, c, semantic=False)
    return pruning.pruned_columns(links, c, pruning.pruned_tables(links, c))


_LINE = f"SELECT table_idx, table_name, 0 AS part, col_idx AS place, '  ' || col_name || ' ' || col_type || CASE WHEN pk = 1 THEN ' PRIMARY KEY' ELSE '' END AS line FROM {_CATALOG} UNION ALL SELECT s.table_idx, s.table_name, 1, f.src_col_idx, '  FOREIGN KEY (' || s.col_name || ') REFERENCES ' || d.table_name || '(' || d.col_name || ')' FROM {_FKS} f JOIN {_CATALOG} s ON s.col_idx = f.src_col_idx JOIN {_CATALOG} d ON d.col_idx = f.dst_col_idx"


@query(f"SELECT 'star' AS db_id, string_agg('CREATE TABLE ' || table_name || ' (' || chr(10) || body || chr(10) || ');', chr(10) || chr(10) ORDER BY table_idx) AS ddl FROM (SELECT table_idx, table_name, string_agg(line, ',' || chr(10) ORDER BY part, place) AS body FROM ({_LINE}) GROUP BY table_idx, table_name)")
def render_ddl(spark, sf):
    return catalogs.render_ddl(star(spark, sf))


def _masked(spark, sf, typed):
    q, c = fixtures.questions(spark), star(spark, sf)
    return masking.mask_questions(q, linking.link(q, c, values(spark, sf), semantic=False), typed).select("question_id", "masked")


@query()
def mask_question(spark, sf):
    return _masked(spark, sf, False)


@query()
def mask_question_typed(spark, sf):
    return _masked(spark, sf, True)
