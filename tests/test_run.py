"""A whole evaluation run: predictions kept in batches, results written and scored again after translation."""

from askframe.engine import Engine
from askframe.plans import config, run
from askframe.plans.generate import ReplayGenerator
from askframe.queries.schema import star
from askframe.sources import files


def test_run(spark, sf, tmp_path):
    g = ReplayGenerator({"regions": "select r_name from region", "nations": "select n_name from nation where n_regionkey = 0"})
    e = Engine(spark, star(spark, sf), {"star": sf}, g, config=config.Config(sql_timeout_seconds=60))
    asked = spark.createDataFrame([(0, "star", "all regions", "SELECT r_name FROM region"), (1, "star", "all nations", "select n_name from nation"), (2, "none", "lost", "select 1")], "index long, db_id string, question string, query string")
    report = run.evaluate_questions(e, asked, str(tmp_path), every=2, legacy=True)
    assert report.samples == 3 and report.failures == 1 and "3 questions" in report.text()
    rows = {r["index"]: r for r in files.read_results(spark, str(tmp_path / "results")).collect()}
    assert rows[0]["exact_match"] and rows[0]["exec_match"] and not rows[1]["exec_match"] and not rows[2]["exec_match"]
    assert not (tmp_path / "predictions").exists()
    names = spark.createDataFrame([("star", "table", "region", "vùng")], "db_id string, kind string, source string, target string")
    again = {r["index"]: r for r in run.evaluate_translated(spark, str(tmp_path), names).collect()}
    assert again[0]["gold_en"] == "SELECT r_name FROM vùng" and again[0]["exact_match"]


def test_settings_make_generator_and_examples(spark, tmp_path):
    path = tmp_path / "train.json"
    path.write_text('[{"db_id": "star", "question": "all regions", "query": "SELECT r_name FROM region"}]')
    c = config.load(llm_url="http://localhost:1/v1", llm_model="m", llm_attempts="2", train_path=str(path))
    g = run.generator(c)
    assert (g.model, g.attempts, g.timeout) == ("m", 2, 60.0) and run.generator(config.Config()) is None
    rows = run.examples(spark, c).collect()
    assert rows[0]["skeleton"] == "SELECT _ FROM _" and run.examples(spark, config.Config()) is None


def test_kept_batches_are_not_asked_again(spark, sf, tmp_path):
    class Counts:
        n = 0

        def generate(self, prompt):
            self.n += 1
            return "select r_name from region"

    g = Counts()
    e = Engine(spark, star(spark, sf), {"star": sf}, g, config=config.Config(sql_timeout_seconds=60))
    asked = spark.createDataFrame([(k, "star", f"q{k}", "select 1") for k in range(3)], "index long, db_id string, question string, query string")
    run.predict(e, asked.limit(2), str(tmp_path / "p"), every=2)
    before = g.n
    out, _ = run.predict(e, asked, str(tmp_path / "p"), every=2)
    assert g.n == before + 1 and out.count() == 3
