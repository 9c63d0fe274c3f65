"""Cases of the first review that the other tests do not have."""

from askframe.llm import exactdedup, langid, licenses, simhash, suffixdedup


def test_wordings_without_licen(spark):
    made = ["Released under the GPL.", "distributed under the terms of the Apache", "Terms and\nconditions of the Eclipse Public", "the terms -- of the MIT", "under the tree"]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["detections"]) for r in licenses.scan(df).collect()}
    assert got == {0: ("gpl", 1), 1: ("apache", 1), 2: ("epl", 1), 3: ("mit", 1), 4: ("", 0)}


def test_short_texts_of_a_language_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    made = spark.createDataFrame([(10**6, "Re.", "en"), (10**6 + 1, "A.", "en"), (10**6 + 2, "1.", "en"), (10**6 + 3, None, "en"), (10**6 + 4, "", "en")], docs.schema)
    kept = langid.keep_known(docs.unionByName(made)).where("doc_id >= 1000000")
    assert sorted(r["doc_id"] for r in kept.collect()) == [10**6, 10**6 + 1]


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "some words", "a"), (1, "some words", "a"), (1, "some  words", "b"), (2, "other words", "a"), (2, "more words", "a"), (3, "somewords", "a"), (4, None, "a"), (4, "", "a"), (None, "none", "a"), (None, "none", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = exactdedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"] or 0), r["text"] or "") for r in kept.collect())
    assert got == [(0, "none"), (0, "none"), (1, "some  words"), (2, "more words"), (2, "other words"), (4, "")]


def test_texts_of_one_id(spark):
    """A text stays though its doc_id also names a copy of another; different texts of one doc_id are documents of their own."""
    x, y = "".join(f"{k:03}" for k in range(100)), "".join(f"{k:03}" for k in range(500, 540))
    rows = [(1, "a b"), (2, "ab"), (2, "a text of its own"), (3, x), (3, y + x), (4, x), (None, x)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in exactdedup.keep_one(docs).collect()) == [0, 1, 2, 3, 3]
    assert sorted(r["doc_id"] or 0 for r in simhash.keep_one(docs).collect()) == [0, 1, 2, 2, 3, 3]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffixdedup.removals(docs).collect())
    assert [g[:2] for g in got] == [(0, 300), (1, 3), (2, 2), (2, 17), (3, 300), (3, 420), (4, 300)] and got[0][2] == 0 and got[6][2] == 300
    assert {got[4][2], got[5][2]} == {0, 300}
    assert suffixdedup.without_repeats(docs).count() == 7


def test_a_component_of_many_fingerprints_in_cut_buckets(spark):
    """A chain of 2 ** 14 fingerprints, all but one at two bits from the next, with every bucket cut, at two radii."""
    gray = [(i ^ i >> 1) for i in range(1 << 14)]
    spread = [sum((g >> k & 1) << (4 * k) for k in range(14)) for g in gray]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in spread], "fp long")
    from askframe.llm.components import components

    for radius, most in ((2, 1), (3, 64)):
        labels = components(simhash.links(df, radius=radius, most=most)).collect()
        assert len(labels) == 1 << 14 and len({r["label"] for r in labels}) == 1


def test_hubs(spark):
    from askframe.llm.components import components

    edges = [(0, k) for k in range(1, 400)] + [(1000 + k, 399) for k in range(50)] + [(5000, 5001)]
    rows = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long"), hub=20).collect()}
    assert rows == {**dict.fromkeys([*range(400), *range(1000, 1050)], 0), 5000: 5000, 5001: 5000}
