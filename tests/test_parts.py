"""Places, ordered comparison, fuzzy candidates, the chat client, segmenters and embedders."""

import http.server
import json
import threading
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from askframe.engine import Engine
from askframe.functions.text import compound_segmenter
from askframe.operators import graph, linking, profiling, retrieval, topk
from askframe.operators.vectors import model_embedder
from askframe.plans import evaluate, generate
from askframe.plans.template import Schema, statement
from askframe.queries import evaluation, fixtures
from askframe.queries.schema import star
from askframe.sources import files


def test_places_of_many_rows(spark):
    n = 200_000
    df = spark.range(0, n, 1, 16).select((F.col("id") * 7919 % n).alias("k"), F.col("id").alias("v"))
    got = topk.positions(df.orderBy("k")).agg(F.min("pos"), F.max("pos"), F.count_distinct("pos"), F.sum((F.col("pos") == F.col("k")).cast("int"))).first()
    assert tuple(got) == (0, n - 1, n, n)
    tied = df.select((F.col("k") % 5).alias("k"), "v")
    both = profiling.align(tied, tied.repartition(16), "k", "v")
    assert tuple(both.agg(F.count("*"), F.max("pos"), F.min(F.col("same").cast("int"))).first()) == (n, n - 1, 1)
    assert topk.positions(df.limit(0)).count() == 0


def test_prefix_under_a_budget(spark):
    df = spark.range(0, 5000, 1, 8).select((5000 - F.col("id")).alias("k"), (F.col("id") % 7 + 1).alias("size"))
    rows = sorted((r["k"], r["size"]) for r in df.collect())
    want, total = [], 0
    for k, size in rows:
        total += size
        if total <= 900:
            want.append((k, total))
    for bucket in (None, F.floor(F.col("k") / 50)):
        got = topk.budget_prefix(df, [F.col("k")], F.col("size"), 900, bucket)
        assert sorted((r["k"], r["used"]) for r in got.collect()) == want and got.columns == ["k", "size", "used"]


def test_rows_in_order(spark):
    a = spark.range(0, 5000, 1, 8).select("id", (F.col("id") * 3).alias("x"))
    assert evaluate.same_rows(a.orderBy("x"), a.repartition(5).orderBy("id"), ordered=True)
    assert not evaluate.same_rows(a.orderBy("x"), a.orderBy(F.desc("x")), ordered=True)
    assert evaluate.same_rows(a.orderBy("x"), a.orderBy(F.desc("x")))
    assert not evaluate.same_rows(a.orderBy("x"), a.where("id < 4999").orderBy("x"), ordered=True)


def test_results_in_files(spark, tmp_path):
    scores = spark.createDataFrame([(k, "d", "q", "p", "g", True, False, True, {"WHERE": True}, "easy", "") for k in range(300)], files.PREDICTION).repartition(4)
    files.write_results(scores, evaluate.metrics(scores.withColumn("component_present", F.col("component_scores"))), str(tmp_path / "r"))
    assert files.read_results(spark, str(tmp_path / "r")).count() == 300 and files.read_metrics(spark, str(tmp_path / "r")).first()["total"] == 300
    assert len(list((tmp_path / "r" / "predictions").glob("part-*"))) == 4


def test_fuzzy_loses_none(spark):
    words = ["ab", "axb", "building", "bulding", "buildings", "machinery", "machnery", "red", "rde", "aab", "aabb", "xyz", "hà nội", "hanoi", "furniture", "automobile", "automobil", "zz", "zzz", "1995", "1996"]
    asked = spark.createDataFrame([(1, "d", " ".join(words))], "question_id int, db_id string, question string")
    values = spark.createDataFrame([("d", "t", "c", w) for w in words], "db_id string, table_name string, col_name string, value string")
    for threshold in (0.6, 0.8, 0.9):
        got = {r["value"]: r["score"] for r in linking.fuzzy_values(asked, values, threshold).collect()}
        tokens = [t for t in " ".join(words).split() if len(t) > 1]
        want = {v: max(round(SequenceMatcher(None, t, v).ratio(), 3) for t in tokens) for v in words}
        assert got == {v: s for v, s in want.items() if s >= threshold}


def test_long_chains(spark):
    edges = [("g", a, b) for k in range(9) for a, b in ((k, k + 1), (k + 1, k))]
    pairs = spark.createDataFrame([("g", 0, 9)], "db_id string, src int, dst int")
    found = graph.shortest_paths(spark.createDataFrame(edges, "db_id string, a int, b int"), pairs).collect()
    assert [r["path"] for r in found] == [list(range(10))]


@pytest.fixture()
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        seen: list = []

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.seen.append((self.headers.get("Authorization"), body))
            busy = len(self.seen) == 1
            self.send_response(429 if busy else 200)
            if busy:
                self.send_header("Retry-After", "0.01")
            self.end_headers()
            self.wfile.write(b"" if busy else json.dumps({"choices": [{"message": {"content": "```sql\nselect r_name from region;\n```"}}], "usage": {"prompt_tokens": 11, "completion_tokens": 5}}).encode())

        def log_message(self, *args):
            pass

    s = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/v1/chat/completions", Handler.seen
    s.shutdown()


def test_chat_generator_against_a_server(spark, sf, server):
    url, seen = server
    g = generate.ChatGenerator(url, "some-model", key="k", pause=0)
    a = Engine(spark, star(spark, sf), {"star": sf}, g).ask("Which regions are there?", "star")
    assert len(a.result.rows) == 5 and [s[0] for s in seen] == ["Bearer k"] * 2 and seen[1][1]["model"] == "some-model"
    assert (g.usage.calls, g.usage.prompt_tokens, g.usage.answer_tokens, g.errors) == (1, 11, 5, 1)
    assert generate.ChatGenerator("http://127.0.0.1:1/none", "m", attempts=2, pause=0).generate("q") == generate.FALLBACK


def test_segmenter_and_embedder(spark, sf):
    join = compound_segmenter(["khách hàng", "đơn_hàng", "khách hàng lớn", "one"])
    df = spark.createDataFrame([("Khách  hàng của đơn hàng",), ("khách hàng lớn",), (None,)], "t string")
    assert [r[0] for r in df.select(join(F.col("t"))).collect()] == ["Khách_hàng của đơn_hàng", "khách_hàng_lớn", None]

    def encode(texts):
        return np.array([[float("region" in t.lower()), float("nation" in t.lower()), 0.1] for t in texts])

    asked = spark.createDataFrame([(1, "star", "the nation")], "question_id int, db_id string, question string")
    c = star(spark, sf)
    best = linking.semantic_links(asked, c, 0.99, model_embedder(encode)).where("kind = 'table'").join(c.tables, ["db_id", "table_idx"]).collect()
    assert [r["table_name"] for r in best] == ["nation"]
    solved = spark.createDataFrame([(1, "star", "regions", "select r_name from region"), (2, "star", "nations", "select n_name from nation")], "id int, db_id string, question string, query string")
    near = retrieval.retrieve(retrieval.build_examples(solved, model_embedder(encode)), retrieval.embed_query(spark, "a nation", model_embedder(encode)), 1).first()
    assert near["id"] == 2


def test_statements_of_unconnected_tables():
    s = Schema({0: "a", 1: "b", 2: "c"}, {1: (0, "id", "INT", True), 2: (1, "a_id", "INT", False), 3: (1, "name", "TEXT", False), 4: (2, "id", "INT", True)}, ((2, 1),))
    assert statement("a and c", s, [], []) == generate.FALLBACK
    assert statement("how many b per a", s, [], []) == "SELECT a.id, count(*) AS n FROM b JOIN a ON b.a_id = a.id GROUP BY a.id"
    assert statement("the a of x's", s, [], [(3, "x's")]) == "SELECT DISTINCT a.id FROM a JOIN b ON a.id = b.a_id WHERE b.name = 'x''s'"


def test_quoted_text_survives(spark, sf):
    g = generate.ReplayGenerator({"odd": "select 'say \"no\", like  that' as x"})
    a = Engine(spark, star(spark, sf), {"star": sf}, g).ask("odd", "star")
    assert a.result.rows[0]["x"] == 'say "no", like  that'


def test_asked_statements_differ(spark, sf):
    assert len(set(evaluation._asked(spark, sf).values())) == len(evaluation.ASKED) and generate.FALLBACK not in evaluation._asked(spark, sf).values()
    assert fixtures.questions(spark).count() == len(fixtures.QUESTIONS)
