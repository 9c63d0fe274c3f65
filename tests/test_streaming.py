"""The question feed gives what the batch operators give."""

import json

from askframe.operators.linking import link
from askframe.queries.schema import star
from askframe.streaming.feed import link_feed


def test_feed(spark, sf, tmp_path):
    asked = [{"question_id": 1, "db_id": "star", "question": "customers by region"}, {"question_id": 2, "db_id": "star", "question": "orders"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, asked)))
    c = star(spark, sf)
    stream = spark.readStream.schema("question_id int, db_id string, question string").json(str(tmp_path / "in"))
    q = link_feed(stream, c, str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()))
    want = link(spark.createDataFrame([tuple(a.values()) for a in asked], "question_id int, db_id string, question string"), c, semantic=False)
    assert got == sorted(map(str, want.collect())) and got
