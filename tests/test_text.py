"""Goldens and properties of the text and SQL-text operators."""

import pytest
from pyspark.sql import functions as F

from askframe.functions import dialect, sqltext, text

CLEAN = [
    ("select * from t where giới_tính = 'female'", 'select * from t where giới_tính = "female"'),
    ("select * from t where loại = 'Grondzeiler'", 'select * from t where loại = "Grondzeiler"'),
    ("select count ( * ) from kiến_trúc_sư where giới_tính = female", 'select count ( * ) from kiến_trúc_sư where giới_tính = "female"'),
    ("select tên , id from kiến_trúc_sư where giới_tính = male order by tên", 'select tên , id from kiến_trúc_sư where giới_tính = "male" order by tên'),
    ('select * from t where giới_tính = "female"', 'select * from t where giới_tính = "female"'),
    ("select * from t where id = 5", "select * from t where id = 5"),
    ("select t1.id, t1.tên from a as t1 join b as t2 on t1.id = t2.id kiến_trúc_sư", "select t1.id , t1.tên from a as t1 join b as t2 on t1.id = t2.id kiến_trúc_sư"),
    ("```sql\nselect count ( * ) from singer\n```", "select count ( * ) from singer"),
    ("select a from t where q = American or q = Canadian", 'select a from t where q = "American" or q = "Canadian"'),
    ("select a from t where x = 'a, b'", 'select a from t where x = "a, b"'),
    ("select a from t where a in (select b from c) and t.id in (select id from c) and t.id in (select id from c) and t.id in (select id from c)", "select a from t where a in (select b from c) and t.id in (select id from c)"),
]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column("v").alias("x")).first()["x"]


def test_post_process(spark):
    rows = spark.createDataFrame(CLEAN, "given string, want string").select("want", sqltext.post_process("given").alias("got")).collect()
    assert [(r["want"], r["got"]) for r in rows if r["want"] != r["got"]] == []


def test_known_columns_are_no_values(spark):
    q = "select * from a where x = y order by x"
    row = spark.createDataFrame([(q,)], "s string").select(sqltext.post_process("s", ("y",)).alias("a"), sqltext.post_process("s").alias("b")).first()
    assert row["a"] == q and row["b"] == 'select * from a where x = "y" order by x'


@pytest.mark.parametrize(("sql", "want"), [
    ("select name from student where age > 20", "SELECT _ FROM _ WHERE _ > _"),
    ("select t1.a , count ( * ) from x as t1 where b = 'select'", "SELECT _ , COUNT ( * ) FROM _ AS _ WHERE _ = _"),
])
def test_skeleton(spark, sql, want):
    got = one(spark, sqltext.skeleton, sql)
    assert got == want and one(spark, sqltext.skeleton, got) == got


def test_normalize_keeps_strings(spark):
    assert one(spark, sqltext.normalize, " select  a from t where b = 'from  x' ; ") == "SELECT a FROM t WHERE b = 'from  x'"


@pytest.mark.parametrize(("sql", "want"), [("select a from t", "easy"), ("select count(*) from t", "medium"), ("select a from t join u on x = y group by a", "hard"), ("select a from t where b in (select c from d)", "extra")])
def test_complexity(spark, sql, want):
    assert one(spark, sqltext.complexity, sql) == want


def test_literals_and_clauses(spark):
    pairs = one(spark, sqltext.literal_pairs, "select a from t where t1.b = 'x' and c LIKE \"%y\" and d > 3")
    assert [(p["column"], p["literal"]) for p in pairs] == [("b", "x"), ("c", "%y")]
    assert one(spark, lambda v: sqltext.clause(v, "WHERE"), "select a from t where  b = 1 order by c") == "B = 1"


def test_tokens(spark):
    assert one(spark, text.question_tokens, "Có bao_nhiêu sinh_viên của lớp A?") == ["bao_nhiêu", "sinh_viên", "lớp"]
    assert one(spark, text.tokens, "Hello, big_World a") == ["hello", "bigworld"]
    assert one(spark, text.mask_literals, "id 12 is 'x  y'  or 3.5") == "id NUM is STR or NUM"
    assert one(spark, text.nfc, "é") == "é"
    grams = one(spark, lambda v: text.ngrams(text.tokens(v), 2), "aa bb cc")
    assert [(g["n"], g["gram"]) for g in grams] == [(2, "aa bb"), (2, "bb cc"), (1, "aa"), (1, "bb"), (1, "cc")]


def test_nulls_and_empties(spark):
    rows = spark.createDataFrame([(None,), ("",)], "v string")
    columns = [sqltext.normalize("v"), sqltext.skeleton("v"), sqltext.post_process("v"), sqltext.complexity("v"), text.tokens("v"), text.ngrams(text.tokens("v"), 3), text.value_candidates("v"), text.mask_literals("v")]
    assert len(rows.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()) == 2


def test_cell_text(spark):
    row = spark.sql("select 1.0D a, 1 b, cast(null as string) c, 1e20D d, 0.5D e, true f").select(*[sqltext.cell_text(c, k).alias(c) for c, k in (("a", "double"), ("b", "int"), ("c", "string"), ("d", "double"), ("e", "double"), ("f", "boolean"))]).first()
    assert tuple(row) == ("1.0", "1", "none", "1e+20", "0.5", "1")


def test_dialect():
    assert dialect.to_spark('select "tên" from t where "x" like "a\'b"', ["tên", "t"]) == "select `tên` from t where 'x' ILIKE 'a''b'"
    assert dialect.quote_identifiers("select id kiến_trúc_sư from t where a = 'tên'", ["id kiến_trúc_sư", "tên"]) == "select `id kiến_trúc_sư` from t where a = 'tên'"
    for bad in ("drop table x", "select 1; select 2", "update t set a = 1", ""):
        with pytest.raises(dialect.NotAQuery):
            dialect.guard(bad)


def test_content_hash_separates(spark):
    rows = spark.createDataFrame([(["ab", "c"],), (["a", "bc"],)], "t array<string>").select(sqltext.content_hash("t").alias("h")).collect()
    assert rows[0]["h"] != rows[1]["h"]
    assert rows[0]["h"] != spark.createDataFrame([(["ab", "c"],)], "t array<string>").select(sqltext.content_hash("t", "m").alias("h")).first()["h"]


def test_clean_generated():
    assert sqltext.clean_generated("```sql\nselect select a from `t`; drop table t\n```") == "select a from t"
    assert sqltext.clean_generated("count(*) from t where a = \"x;y\"") == 'SELECT count(*) from t where a = "x;y"'
    assert sqltext.clean_generated("with a as (select 1) select * from a").startswith("with")


def test_truncate(spark):
    assert spark.range(1).select(sqltext.truncate_schema(F.repeat(F.lit("x"), 10), 4).alias("t")).first()["t"].startswith("xxxx\n")
