"""The pipeline against a brute-force version of its exact stages, and on odd rows."""

import corpus_pipeline
from askframe.llm import common, langid, suffixdedup
from askframe.llm.tokens import encoder, vocabulary

from .brute import near_brute
from .test_operators import remove_brute


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {r["doc_id"] for r in langid.language_ids(docs).collect() if r["lang_pred"] != "und" and r["score"] >= langid.LEAST}
    rows = {k: t for k, t in rows.items() if k in known}
    best = {}
    for k, t in rows.items():
        body = "".join(t.split()) if t.isascii() else t.translate({ord(c): None for c in " \t\n\x0b\x0c\r"})
        best.setdefault(body, []).append((-len(t), k))
    stay = {min(v)[1] for v in best.values()}
    rows = {k: t for k, t in rows.items() if k in stay}
    groups = near_brute(rows)
    assert any(groups[k] != k for k in rows)
    rows = {k: t for k, t in rows.items() if groups[k] == k}
    removed = remove_brute(rows.items())
    given, got = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        got[name] = given = stage(spark, given, sf).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert given.columns == docs.columns
    after = {r["doc_id"]: r["text"] for r in got["suffix_array_dedup"].collect()}
    assert set(after) == set(rows)
    assert all(removed[k][1] or after[k] == rows[k] for k in rows) and any(removed[k][1] for k in rows)
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} == set(rows)


def test_stages_keep_columns(spark):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (None, "some words here", "en", "s", 15, "x"), (3, "some more words here", "en", "s", 20, None), (3, "some more words here", "en", "s", 20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 5


def test_repeated_rows_and_clashing_ids(spark):
    """Of repeated rows one stays, of equal texts one, and a text whose doc_id also names a copy of another text stays."""
    t = [f"word{k}" for k in range(80)]
    text, near, other = " ".join(t), " ".join([*t[:40], "changed", *t[41:]]), " ".join(f"other{k}" for k in range(80))
    rows = [(5, text), (5, text), (5, text.replace(" ", "  ", 1)), (6, text), (6, other), (6, other), (7, near), (7, "a text of its own"), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda d: sorted((r["doc_id"], r["text"]) for r in d.collect())
    own = "a text of its own"
    exact = stages["exact_dedup"](spark, docs, "")
    assert kept(exact) == sorted([(5, text.replace(" ", "  ", 1)), (6, other), (7, near), (7, own), (8, "")], key=str) or kept(exact) == sorted([(5, text.replace(" ", "  ", 1)), (6, other), (7, near), (7, own), (8, None)], key=str)
    some = docs.where("text is not null")
    best = stages["near_dedup"](spark, some, "")
    assert {(r["doc_id"], " ".join(r["text"].split())) for r in best.collect()} == {(5, text), (6, other), (7, own), (8, "")} and best.count() == 4
    cut = stages["suffix_array_dedup"](spark, some, "")
    assert cut.count() == 9 and {(r["doc_id"], " ".join(r["text"].split())) for r in cut.collect()} >= {(5, text), (6, other), (7, own), (8, "")}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "language_id":
            now = stage(spark, now, "").cache()
    assert [r["doc_id"] for r in now.orderBy("doc_id", "text").collect()] == [5, 6, 7, 8]
    assert stages["best_fit_packing"](spark, now, "").count() == 4


def test_encoders_do_not_outlive_their_stage():
    """A worker that packed has no encoder left when it looks for repeats, so that their memory is never needed at once."""
    for after in (lambda: list(suffixdedup._ship(4, 100)(iter([]))), common.forget, common.tidy):
        encoder(vocabulary())
        common.tidy(encoding=True)
        assert encoder.cache_info().currsize == 1
        after()
        assert encoder.cache_info().currsize == 0
