"""Catalog, linking, graph, execution, repair, evaluation and the engine, over inline inputs and the smallest data."""

import json

import pytest

from askframe.engine import Engine
from askframe.operators import graph, linking, masking, profiling, pruning, retrieval
from askframe.plans import config, evaluate, generate, prompt, repair, translate
from askframe.plans.execute import Executor, Status
from askframe.queries import fixtures
from askframe.queries.schema import star
from askframe.sources import catalog, files, tables, values

SHOP = [{"db_id": "shop", "table_names_original": ["customer", "orders"], "column_names_original": [[-1, "*"], [0, "id"], [0, "name"], [1, "id"], [1, "customer_id"], [1, "total"]], "column_types": ["text", "number", "text", "number", "number"], "primary_keys": [1, 3], "foreign_keys": [[4, 1]]}]


def test_catalog_json_and_ddl(spark, tmp_path):
    path = tmp_path / "tables.json"
    path.write_text(json.dumps(SHOP))
    c = catalog.read_json(spark, str(path))
    assert c.databases() == ["shop"] and c.columns.count() == 5
    assert c.columns.where("col_name = 'total'").first()["col_type"] == "TEXT"  # the list of types is too short
    ddl = catalog.render_ddl(c).first()["ddl"]
    assert ddl == "CREATE TABLE customer (\n  id NUMBER PRIMARY KEY,\n  name TEXT\n);\n\nCREATE TABLE orders (\n  id NUMBER PRIMARY KEY,\n  customer_id NUMBER,\n  total TEXT,\n  FOREIGN KEY (customer_id) REFERENCES customer(id)\n);"
    with pytest.raises(KeyError):
        c.of("none")


def test_links(spark, sf):
    q, c = fixtures.questions(spark), star(spark, sf)
    v = values.cell_values(spark, sf, c)
    rows = linking.link(q, c, v, semantic=False).collect()
    assert any(r["question_id"] == 3 and r["kind"] == "cell" and r["span"] == "BUILDING" for r in rows)
    assert any(r["question_id"] == 2 and r["kind"] == "table" and r["match_type"] == "exact" and r["span"] == "region" for r in rows)
    assert not any(r["question_id"] == 12 for r in rows)
    d = spark.createDataFrame([("toà_nhà", "BUILDING")], "source string, target string")
    asked = spark.createDataFrame([(1, "star", "khách toà_nhà")], "question_id int, db_id string, question string")
    spaced = spark.createDataFrame([("toà nhà", "BUILDING")], "source string, target string")
    assert linking.match_values(asked, v, dictionary=d.union(spaced)).where("value = 'BUILDING'").count() == 1


def test_graph(spark, sf):
    c = star(spark, sf)
    g = graph.edges(c)
    near = {r["table_idx"]: r["neighbors"] for r in graph.neighbors(g).collect()}
    assert near[1] == [0, 2, 3] and near[6] == [3, 4, 5]
    square = spark.createDataFrame([("g", a, b) for x, y in fixtures.GRAPH for a, b in ((x, y), (y, x))], "db_id string, a int, b int")
    pairs = spark.createDataFrame([("g", 0, 2), ("g", 0, 5), ("g", 4, 4)], "db_id string, src int, dst int")
    paths = sorted(r["path"] for r in graph.shortest_paths(square, pairs).collect())
    assert paths == [[0, 1, 2], [0, 3, 2], [4]]
    asked = spark.createDataFrame([(1, "star", "customer region"), (2, "star", "zzz"), (3, "star", "supplier")], "question_id int, db_id string, question string")
    links = linking.link(asked, c, semantic=False)
    rows = graph.enhance(asked, links, c).collect()
    assert sorted(r["table_idx"] for r in rows if r["question_id"] == 1) == [0, 1, 2]
    assert len([r for r in rows if r["question_id"] == 2]) == 7
    assert sorted(r["table_idx"] for r in rows if r["question_id"] == 3) == [1, 3, 6]
    new = graph.graph_links(graph.enhance(asked, links, c), links).where("question_id = 1").collect()
    assert [r["table_idx"] for r in new] == [1] and new[0]["match_type"] == "graph_path"
    kept, cols = pruning.prune(links, c)
    assert kept.where("question_id = 3").count() == 3 and cols.where("question_id = 3").count() > 3


def test_sparse_graph_is_guessed(spark):
    raw = [{**SHOP[0], "foreign_keys": []}]
    c = catalog.from_entries(spark.read.schema("db_id string, table_names_original array<string>, column_names_original array<array<string>>, column_types array<string>, primary_keys array<int>, foreign_keys array<array<int>>").json(spark.sparkContext.parallelize([json.dumps(raw[0])])))
    assert sorted((r["a"], r["b"]) for r in graph.edges(c).collect()) == [(0, 1), (1, 0)]


def test_mask():
    spans = [("customer", "table"), ("c_name", "column"), ("red ring", "cell")]
    q = "c_name of customer customer with 'red ring' or red_ring on 2020-01-02 and 12"
    assert masking.mask(q, spans, masking.TAGS) == "COLUMN of TABLE with VALUE or VALUE on DATE and NUM"
    once = masking.mask(q, spans, dict.fromkeys(masking.TAGS, "_"))
    assert once == "_ of _ with _ or _ on _ and _" and masking.mask("", spans, masking.TAGS) == ""


def test_retrieval(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)], f"s{i % 4}") for i in range(20)], "id int, embedding array<float>, skeleton string")
    q = [1.0, 1.0, 5.0]
    top = [r["id"] for r in retrieval.top_k(rows, q, 6).collect()]
    assert retrieval.mmr(rows, q, 6, weight=1.0) == top
    assert len(set(retrieval.mmr(rows, q, 50))) == 20
    best = retrieval.distinct_top_k(retrieval.top_k(rows, q, 12), "skeleton", 3).collect()
    assert len({r["skeleton"] for r in best}) == 3
    assert retrieval.top_k(rows, [0.0, 0.0, 0.0], 1).first()["score"] == 0.0
    assert retrieval.mmr(rows.limit(0), q, 3) == []


def test_execute(spark, sf):
    x = Executor(spark, folders={"star": sf}, timeout=30, most_rows=5)
    r = x.execute("select c_custkey from customer order by c_custkey", "star")
    assert r.status is Status.SUCCESS and len(r.rows) == 5 and r.truncated
    assert x.execute("select c_name from customer where c_custkey < 0", "star").status is Status.EMPTY
    assert x.execute("drop table customer", "star").status is Status.SYNTAX_ERROR
    assert x.execute("select nope from customer", "star").status is Status.RUNTIME_ERROR
    assert x.execute("select 1", "other").status is Status.DB_NOT_FOUND
    assert x.execute("select c_mktsegment from customer where c_mktsegment like 'build%' limit 1", "star").status is Status.SUCCESS
    assert x.execute("select c_mktsegment , c_name , count(*) from customer group by c_mktsegment", "star").status is Status.SUCCESS
    assert x.validate("select c_name from customer", "star") == (True, "") and not x.validate("select", "star")[0]
    short = Executor(spark, folders={"star": sf}, timeout=0.5)
    slow = short.execute("select count(*) from lineitem a, lineitem b, lineitem c where a.l_tax + b.l_tax + c.l_tax > 100", "star")
    assert slow.status is Status.TIMEOUT


def test_repair(spark, sf):
    x, c = Executor(spark, folders={"star": sf}, timeout=60), star(spark, sf)
    g = generate.ReplayGenerator({"q1": ["select nope from customer", "select c_name from customer limit 1"]})
    r = repair.Repairer(x, g, values_of=lambda d, col: values.column_values(spark, sf, c, col))
    o = r.repair("select also_nope from customer", "star", "q1", "")
    assert o.success and len(o.attempts) == 2
    o = r.repair("select c_name from customer where c_mktsegment = 'buildng'", "star", "q2", "")
    assert o.success and "'BUILDING'" in o.executed and o.generated != o.executed and not o.attempts
    assert repair.nearest_value("zzz", ["BUILDING"]) is None
    assert not repair.Repairer(x, generate.ReplayGenerator({}), attempts=1).repair("select 1", "none", "q", "").success


def test_same_rows(spark):
    a, b = spark.sql("select 1 a, 'X ' b union all select 1, 'X '"), spark.sql("select 1 c, 'x' d union all select 1, 'x'")
    assert evaluate.same_rows(a, b)
    assert not evaluate.same_rows(a, b.distinct())
    assert not evaluate.same_rows(spark.sql("select 1"), spark.sql("select 1.0D"))
    assert evaluate.same_rows(a.limit(0), spark.sql("select 1").limit(0)) and not evaluate.same_rows(a, spark.sql("select 1"))
    up, down = spark.sql("select id from range(3) order by id"), spark.sql("select id from range(3) order by id desc")
    assert evaluate.same_rows(up, down) and not evaluate.same_rows(up, down, ordered=True)
    assert evaluate.is_ordered("select a from t order by a") and not evaluate.is_ordered("select a from (select b from c order by b)")


def test_evaluation(spark, sf):
    scores = evaluate.score(spark, fixtures.predictions(spark), Executor(spark, folders={"star": sf}, timeout=60), legacy=True).cache()
    got = {r["index"]: r["exec_match"] for r in scores.collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 7: True, 8: True, 9: True}
    assert "execution" in evaluate.summary(scores)
    m = evaluate.metrics(scores).first()
    assert m["total"] == 9 and set(m["component_acc"]) == set(evaluate.CLAUSES)
    assert evaluate.overall(scores.limit(0)).first()["exact_match_acc"] == 0.0


def test_translate(spark):
    names = {s: t for _, _, s, t in fixtures.MAP}
    assert translate.translate("select count ( * ) from kiến_trúc_sư where giới_tính = \"tên\"", names) == 'select count ( * ) from architect where gender = "tên"'
    assert translate.translate("select t1.tên from a as t1 join nhà_máy as t2 on t1.id = t2.id kiến_trúc_sư", names) == "select t1.name from a as t1 join mill as t2 on t1.id = t2.architect_id"
    entry = "db_id string, table_names_original array<string>, column_names_original array<array<string>>"
    vi = spark.createDataFrame([("d", ["sinh viên"], [["-1", "*"], ["0", "tên"]])], entry)
    en = spark.createDataFrame([("d", ["student"], [["-1", "*"], ["0", "name"], ["0", "more"]])], entry)
    assert {(r["source"], r["target"]) for r in translate.build_map(vi, en).collect()} == {("sinh viên", "student"), ("sinh_viên", "student"), ("tên", "name")}


def test_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"db_id": "a", "question": "x", "query": "select 1"}, {"db_id": "b", "question": "y", "query": "select 2"}]))
    assert [r["db_id"] for r in files.read_questions(spark, str(tmp_path / "q.json"), 1).collect()] == ["a"]
    assert files.merge_json(spark, [str(tmp_path / "q.json"), str(tmp_path / "none.json")]).count() == 2
    (tmp_path / "gold.sql").write_text("select 1\ta\n\nselect '\t'\tb\n")
    assert [(r["sql"], r["db_id"]) for r in files.read_gold(spark, str(tmp_path / "gold.sql")).collect()] == [("select 1", "a"), ("select '\t'", "b")]
    cache = files.EmbeddingCache(spark, str(tmp_path / "cache"))
    assert cache.get("e", ["ab", "c"], "m") is None
    cache.put("e", ["ab", "c"], "m", spark.range(3))
    assert cache.get("e", ["ab", "c"], "m").count() == 3 and cache.get("e", ["a", "bc"], "m") is None and cache.get("e", ["ab", "c"], "n") is None
    cache.invalidate("e")
    assert cache.get("e", ["ab", "c"], "m") is None
    files.append_log(spark.range(2), str(tmp_path / "log"))
    files.append_log(spark.range(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3
    files.write_checkpoint(spark.range(2), str(tmp_path / "ck"), 0)
    files.write_checkpoint(spark.range(2), str(tmp_path / "ck"), 0)
    assert files.read_checkpoint(spark, str(tmp_path / "ck")).count() == 2


def test_resolve_and_metadata(spark, sf, tmp_path):
    (tmp_path / "a" / "a").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    assert tables.resolve(spark, str(tmp_path), "a").endswith("a/a") and tables.resolve(spark, str(tmp_path), "b").endswith("/b")
    assert tables.resolve(spark, str(tmp_path), "c") is None
    own = spark.newSession()
    assert "orders" in tables.register(own, sf) and "orders" in tables.table_names(own)
    assert ("r_name", "string") in tables.column_names(own, "region")


def test_config(tmp_path, monkeypatch):
    path = tmp_path / "c.yaml"
    path.write_text("test_limit: 7\nuse_mmr: true\n")
    monkeypatch.setenv("ASKFRAME_TEST_LIMIT", "9")
    c = config.load(str(path), retrieval_top_k=3)
    assert (c.test_limit, c.use_mmr, c.retrieval_top_k) == (9, True, 3)
    config.save(c, str(path))
    monkeypatch.delenv("ASKFRAME_TEST_LIMIT")
    assert config.load(str(path)) == c
    with pytest.raises(KeyError):
        config.load(str(path), unknown=1)


def test_prompt_and_generators():
    block = "a\nb\n\nc\nd\n\n"
    assert prompt.fit_examples(block, 0, 0) == block and prompt.fit_examples(block, 35, 10) == "a\nb\n\n" and prompt.fit_examples(block, 100, 10) == ""
    assert prompt.build("q?", "DDL").endswith("-- question: q?\nSELECT ")

    class Fails:
        def generate(self, prompt):
            raise OSError

    assert generate.RetryingGenerator(Fails(), 2, 0).generate("x") == generate.FALLBACK
    assert generate.ReplayGenerator({}).generate("x") == generate.FALLBACK


def test_engine(spark, sf):
    c = star(spark, sf)
    assert Engine(spark, c, {"star": sf}).ask("How many orders per customer of the BUILDING segment?", "star").sql == "SELECT customer.c_custkey, count(*) AS n FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE customer.c_mktsegment = 'BUILDING' GROUP BY customer.c_custkey"
    g = generate.ReplayGenerator({"names": ["```sql\nselect nope from customer\n```", "select c_name from customer limit 3"]})
    examples = retrieval.build_examples(spark.createDataFrame([(1, "star", "names of regions", "select r_name from region")], "id int, db_id string, question string, query string"))
    a = Engine(spark, c, {"star": sf}, g, examples, config.Config(sql_timeout_seconds=60)).ask("Give the names", "star")
    assert a.result.status is Status.SUCCESS and len(a.result.rows) == 3 and "names of regions" in a.prompt


def test_profiles(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(5, "x"), (6, "z")], "k int, v string")
    assert [(r["pos"], r["left_k"], r["right_k"], r["same"]) for r in profiling.align(a, b, "k", "v").orderBy("pos").collect()] == [(0, 1, 5, True), (1, 2, 6, False)]
    with pytest.raises(ValueError):
        profiling.align(a, b.limit(1), "k", "v")
    assert {(r["side"], r["value"]) for r in profiling.compare_sets(a, b, "v").collect()} == {("left", "y"), ("right", "z"), ("both", "x")}
