"""Each training-data operator against a brute-force version, and on nulls, empties, ties, repeated rows and odd columns."""

import collections
import functools
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askframe.llm import bpe, components, exactdedup, langid, licenserules, licenses, packing, quality, simhash, suffixdedup, tokenfiles, toxicity
from askframe.llm.tokens import encoder, vocabulary

VOCAB = vocabulary()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns of clashing names."""
    long = "word " * 60_000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r", "en", None, 6), (None, "nobody's text", None, "a", 13), (4, "Some text", "en", "a", 9), (5, "Some  text", "en", "a", 10), (6, "Sometext", "de", "b", 8), (6, "Sometext", "de", "b", 8), (7, long, "en", "a", len(long)), (8, "é" * 300, "fr", "b", 300), (9, "日本 <|endoftext|> ß's", None, "b", 20), (10, "x" * 250 + "y" + "x" * 250, "en", "b", 501)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("kept", "keep_id", "lists", "entries", "_gone", "fp", "words", "length", "score", "key"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def reference_ids(text):
    return encoder(VOCAB).whole.encode(text or "", add_special_tokens=False).ids


# --- 1 -----------------------------------------------------------------------------------------------------------


def test_exact_against_sql(docs, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(map(tuple, exactdedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    assert got == sorted(con.sql(exactdedup.ORACLE).fetchall())


def test_exact_odd(odd):
    rows = exactdedup.exact_groups(odd).collect()
    assert len(rows) == odd.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["keep_id"], r["group_size"], r["kept"]))
    assert by[1] == [(3, 3, False)] and by[2] == [(3, 3, False)] and by[3] == [(3, 3, True)]  # blanks are longest
    assert by[4] == [(5, 4, False)] and by[5] == [(5, 4, True)] and by[6] == [(5, 4, False)] * 2
    assert by[None] == [(None, 1, True)]
    assert exactdedup.exact_groups(odd.limit(0)).count() == 0
    kept = exactdedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 5, 7, 8, 9, 10]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 60) - 1), max_size=200), st.integers(60, 64))
def test_golomb_round_trip(values, bits):
    v = np.array(sorted(values), np.uint64)
    assert exactdedup.ungolomb(exactdedup.golomb(v, 1 << bits)).tolist() == v.tolist()


# --- 2 -----------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    bad = ["idiot", "moron", "scum", "trash"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        t = [rng.choice(words) for _ in range(40)]
        if toxic:
            t[5:5] = rng.sample(bad, 2)
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(d, y).collect()}
    held = [i for i in out if out[i]["held_out"]]
    assert held == [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i]["predicted"] == (i % 6 == 0) for i in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_toxicity_odd(spark, odd, sf):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (None, 1, 1), (5, None, None), (7, 0, 1)], "doc_id long, toxic int, score int")
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    none = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert all(r["predicted"] == 0 and r["score"] < 1e-6 for r in none)
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0


def test_label_model_discounts_echoes():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.2
    votes = np.stack([np.where(y, rng.random(3000) < 0.7, rng.random(3000) < 0.02) for _ in range(4)], axis=1)
    votes = np.concatenate([votes, votes[:, :1], votes[:, :1]], axis=1).astype(np.uint8)  # two echoes of the first
    given_labels = y ^ (rng.random(3000) < 0.1)
    post, rates, correlation = toxicity.label_model(votes, given_labels, trust=0.9)
    assert ((post > 0.5) == y).mean() > (given_labels == y).mean() + 0.01 and (rates[1] > rates[0]).all()
    assert correlation[0, 4] > 0.9 and abs(correlation[1, 2]) < 0.3


# --- 3 -----------------------------------------------------------------------------------------------------------


@functools.cache
def compiled():
    return [(label, priority, re.compile(pattern, re.ASCII)) for label, _, priority, pattern in licenserules.rules()]


def scan_brute(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
    starts, base = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    found, norm = [], " " + " ".join(w) + " "
    for label, priority, pattern in compiled():  # every rule, whatever its keyword
        for m in pattern.finditer(norm):
            s = norm.count(" ", 0, m.start())
            found.append((s, -(s + m.group().count(" ")), -priority, label))
    kept = []
    for d in sorted(found):
        if kept and d[0] <= -kept[-1][1]:
            if d[2] < kept[-1][2]:
                kept[-1] = d
        else:
            kept.append(d)
    labels = base | {d[3] for d in kept}
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels))


def test_licenses(spark, docs, texts):
    rows = licenses.scan(docs).collect()
    assert [r for r in rows if tuple(r)[1:7] != scan_brute(texts[r["doc_id"]])] == []
    made = ["The MIT License", "licensed under the GNU Lesser General Public License version 2.1", "Apache license. apache LICENSE, mit license", "mit licence, Licença", "SPDX-License-Identifier: Apache-2.0", "licensed under CC BY-NC 4.0 license", "License", "general public license " * 50]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:7] for r in licenses.scan(df).collect()}
    assert got == {i: scan_brute(t) for i, t in enumerate(made)}
    assert got[1][5] == "gpl,lgpl-2.1" and got[4][5].startswith("apache")


def example(pattern, rng):
    """A text that an expression matches."""
    import re._constants as c
    import re._parser as p

    def made(items):
        out = ""
        for op, arg in items:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.IN:
                kind, own = rng.choice(arg)
                out += chr(own) if kind is c.LITERAL else chr(rng.randint(*own)) if kind is c.RANGE else rng.choice("0123456789")
            elif op is c.MAX_REPEAT:
                low, high, inner = arg
                out += "".join(made(inner) for _ in range(rng.randint(low, min(high, low + 2))))
            elif op is c.SUBPATTERN:
                out += made(arg[-1])
            elif op is c.BRANCH:
                out += made(rng.choice(arg[1]))
            elif op is not c.ASSERT:
                raise ValueError(op)
        return out

    return made(p.parse(pattern.replace("\\S", "x").replace("\\d", "[0-9]")))


def test_every_rule_is_found_by_its_keyword(spark):
    rng, texts = random.Random(3), []
    for label, keyword, _, pattern in licenserules.rules():
        for _ in range(2):
            t = example(pattern, rng)
            assert f" {keyword} " in f" {t} ", (label, keyword, t)
            texts.append("by the " + t + " of all")
    texts += [" ".join(rng.sample(texts, 3)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:7] for r in licenses.scan(df).collect()}
    assert got == {i: scan_brute(t) for i, t in enumerate(texts)}


def test_licence_texts(spark):
    made = {"Distributed under the terms of the GPL": "gpl", "Released under the WTFPL": "wtfpl", "This work is in the public domain, see CC0": "cc0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
            "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd", "Licensed under the GNU Lesser General Public License, version 2.1": "gpl,lgpl-2.1", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0+",
            "a licence to drive with a mit of 3": "", "nothing": "", "apache \u212aicense, m\u0130t license, \u0130\u00c9\u03a3 GPL": ""}
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(df).collect()} == dict(enumerate(made.values()))


def test_licenses_odd(odd):
    rows = licenses.scan(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["labels"] == "" for r in rows)
    assert next(r for r in rows if r["doc_id"] == 1)["n_words"] == 0 and licenses.scan(odd.limit(0)).count() == 0


# --- 4 -----------------------------------------------------------------------------------------------------------


def test_bpe(docs, texts):
    whole = encoder(VOCAB).whole
    for r in bpe.digests(docs, VOCAB).collect():
        ids = whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = whole.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


_SPICE = st.sampled_from([*"abAB'sS 1²½éÉßİΣς́́​日힣!\n\x00\x1c\x85\xa0ǅª_<|>", "'ll", "<|endoftext|>", "<|startoftext|>", "<|", " "])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(_SPICE, st.characters(max_codepoint=0x24F), st.characters(exclude_categories=["Cs", "Cn"], max_codepoint=0x2FFF)), max_size=14).map("".join))
def test_encoders_agree_with_the_library(text):
    want = reference_ids(text)
    assert encoder(VOCAB)(text).tolist() == want
    assert bpe.bpe(VOCAB).encode(text) == want
    assert bpe.bpe(VOCAB).both(text)[1] == encoder(VOCAB).whole.decode(want, skip_special_tokens=False)


def test_every_latin_letter():
    for c in map(chr, range(0x250)):
        assert encoder(VOCAB)(f"a{c}b {c}").tolist() == reference_ids(f"a{c}b {c}")


def test_bpe_odd(odd):
    rows = bpe.encode_decode(odd, VOCAB).collect()
    assert len(rows) == odd.count() and next(r for r in rows if r["doc_id"] == 1)["ids"] == []
    assert next(r for r in rows if r["doc_id"] == 9)["ids"] == reference_ids("日本 <|endoftext|> ß's")
    assert bpe.digests(odd.limit(0), VOCAB).count() == 0


# --- 5 -----------------------------------------------------------------------------------------------------------


def remove_brute(rows, window=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            if w in seen:
                gone[i : i + window] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[d] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most", [suffixdedup.MOST, 2])
def test_suffixes(spark, docs, texts, most):
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixdedup.removals(docs, most=most).collect()}
    assert got == remove_brute(texts.items())
    rng = random.Random(3)
    base = "".join(rng.choice("ab") for _ in range(300))
    rows = [(k, base[(p := rng.randint(0, 150)) : p + rng.randint(90, 150)] * rng.randint(1, 3) + rng.choice(["", "é" * 80, "x" * 300, base])) for k in range(60)]
    df = spark.createDataFrame([*rows, *rows[:20], (None, "q" * 500), (100, None)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixdedup.removals(df, most=most).collect()}
    assert got.pop(None)[1] == 0 and got.pop(100)[0] == 0 and got == remove_brute(rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=200))
def test_suffix_array(text):
    t = np.array(text, np.int32)
    assert suffixdedup.suffix_array(t, 1 << 40).tolist() == sorted(range(len(t)), key=lambda i: text[i:])
    order = suffixdedup.suffix_array(t, 9).tolist()
    assert sorted(order) == list(range(len(t))) and [text[i : i + 9] for i in order] == sorted(text[i : i + 9] for i in range(len(t)))


def test_suffixes_odd(odd):
    rows = {r["doc_id"]: r for r in suffixdedup.removals(odd).collect()}
    assert rows[1]["n_bytes"] == 0 and rows[6]["n_removed"] == 0 and rows[7]["n_removed"] > 299_000
    out = suffixdedup.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert next(r for r in out.collect() if r["doc_id"] == 7)["n_chars"] == 300_000 - rows[7]["n_removed"]
    assert suffixdedup.removals(odd.limit(0)).count() == 0


# --- 6 -----------------------------------------------------------------------------------------------------------


def test_language(spark, sf):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    rows = langid.language_ids(d).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) >= 0.97
    assert langid.keep_known(d).columns == d.columns


def test_bloom_rows_hold_what_was_put_in():
    code = np.random.default_rng(0).integers(0, 1 << 32, 5000).astype(np.uint32)
    table = np.zeros(1 << 17, np.uint8)
    for at in langid.places(code, 1 << 17, 3):
        table[at] |= 4
    mask = np.full(len(code), 255, np.uint8)
    for at in langid.places(code, 1 << 17, 3):
        mask &= table[at]
    assert (mask == 4).all()


def test_language_odd(odd):
    rows = langid.language_ids(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (1, 2, 3)) and by[9]["lang_pred"] != "und" and not by[None]["held_out"]
    assert langid.language_ids(odd.limit(0)).count() == 0
    nothing = langid.language_ids(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert langid.keep_known(odd).columns == odd.columns


# --- 7 -----------------------------------------------------------------------------------------------------------


def measure_brute(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, texts):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(texts) and [r for r in rows if tuple(r)[1:6] != measure_brute(texts[r["doc_id"]])] == []
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in rows)
    made = ["a b c a b c", "a b c\na b c\n\n \n", "# * $", "a a a a", "é ü x"]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(made)], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: tuple(r)[1:6] for r in quality.judge(df).collect()} == {i: measure_brute(t) for i, t in enumerate(made)}


def test_quality_fences_adapt(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(80)]
        mark = 20 if i % 3 == 0 else 2  # one source has many symbols in all its texts
        rows.append((i, " ".join(w + "#" if k < mark else w for k, w in enumerate(words)), "en", "code" if i % 3 == 0 else "prose"))
    rows.append((9999, " ".join(f"x{k}#" for k in range(80)), "en", "prose"))
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept[9999] and all(kept[i] for i in range(900))


def test_quality_odd(odd):
    rows = quality.judge(odd).collect()
    assert len(rows) == odd.count() and quality.judge(odd.limit(0)).count() == 0
    assert next(r for r in rows if r["doc_id"] == 7)["n_repeat_words"] == 60_000


# --- 8 -----------------------------------------------------------------------------------------------------------


def check_packed(rows, want):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    for d, t in want.items():
        ids = np.array([*reference_ids(t), 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r["piece"])):
            own = ids[at : at + packing.CAPACITY]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (k, at, len(own), zlib.crc32(own.tobytes()))
            at += len(own)
        assert at == len(ids)
    return len(by_seq), -(-sum(r["length"] for r in rows) // packing.CAPACITY)


def test_packing(docs, texts, odd):
    used, bound = check_packed(packing.pack_documents(docs, VOCAB).collect(), texts)
    assert used <= bound * 1.02 + 1
    rows = packing.pack_documents(odd, VOCAB).collect()
    assert len([r for r in rows if r["doc_id"] == 6]) == 2 and len([r for r in rows if r["doc_id"] is None]) == 1
    check_packed(rows, {k: t for k, t in {r["doc_id"]: r["text"] for r in odd.collect()}.items() if k not in (6, None)})
    assert packing.pack_documents(odd.limit(0), VOCAB).count() == 0


def test_pieces_are_ranked_by_one_sort(spark):
    """Every sort of a task holds a page of memory: one exchange and one sort rank the pieces, whatever the Arrow batches are."""
    cut = spark.range(300).selectExpr("id as doc_id", "0 as piece", "id % 3 * 500 + 40 as length", "id as ids_crc32")
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(rows)
    spark.conf.set(rows, "7")
    try:
        packed = packing.pack(cut)
        plan = packed._jdf.queryExecution().executedPlan().toString()
        got = packed.collect()
    finally:
        spark.conf.set(rows, usual)
    assert "SortMergeJoin" not in plan and plan.count("Window") == 1
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert at.setdefault(r["sequence_id"], 0) == r["offset"]
        at[r["sequence_id"]] += r["length"]
    assert len({r["doc_id"] for r in got}) == len(got) == 300 and max(at.values()) <= packing.CAPACITY


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 4), min_size=1, max_size=7), st.integers(1, 120))
def test_fullest(counts, room):
    took = packing.fullest(counts, room)
    best = {0}
    for length, n in counts.items():
        best |= {b + k * length for b in best for k in range(1, n + 1) if b + k * length <= room}
    assert sum(x * k for x, k in took.items()) == max(best) and all(took[x] <= counts[x] for x in took)


# --- 9 -----------------------------------------------------------------------------------------------------------


def fingerprint_brute(t):
    import xxhash

    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum((2 * sum(x >> j & 1 for x in h) > len(h)) << j for j in range(64))


def components_brute(fps):
    parent = {k: k for k in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2 and (x := root(a)) != (y := root(b)):
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in fps}


@pytest.mark.parametrize("most", [simhash.MOST, 1])
def test_simhash(docs, texts, most):
    fps = {k: fingerprint_brute(t) for k, t in texts.items()}
    want = components_brute(fps)
    for r in simhash.near_duplicates(docs, most=most).collect():
        assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", want[r["doc_id"]])


@pytest.mark.parametrize("most", [simhash.MOST, 3])
def test_links_of_dense_fingerprints(spark, most):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 150:
        x = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    rows = components.components(simhash.links(spark.createDataFrame(signed, "fp long"), most=most)).collect()
    label = {r["node"] % (1 << 64): r["label"] for r in rows}
    want = components_brute({x: x for x in fps})
    groups = collections.defaultdict(set)
    for x in fps:
        groups[want[x]].add(label.get(x, ("alone", x)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 255)), min_size=2, max_size=40), st.integers(0, 2))
def test_sliced_pairs(rows, radius):
    rows = sorted(set(rows))
    keys, fps = np.array([r[0] for r in rows]), np.array([r[1] << 56 | r[1] for r in rows], np.uint64)
    i, j = simhash.sliced_pairs(keys, fps, radius)
    want = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if keys[a] == keys[b] and (int(fps[a]) ^ int(fps[b])).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 205), (204, 205)]
    rows = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert rows == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 200, 204: 200, 205: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_odd(odd):
    rows = simhash.near_duplicates(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count() and by[None]["component_id"] is None
    assert by[1]["fingerprint"] == "0" * 16 and by[3]["component_id"] == 1
    assert by[4]["component_id"] == by[5]["component_id"] == 4
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.keep_one(odd).columns == odd.columns


# --- 10 ----------------------------------------------------------------------------------------------------------


def test_token_files(spark, docs, texts, odd, tmp_path):
    at = 0
    for r in sorted(tokenfiles.round_trip(docs, VOCAB).collect()):
        ids = np.array([*reference_ids(texts[r["doc_id"]]), 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    rows = tokenfiles.round_trip(odd, VOCAB).collect()
    assert len(rows) == odd.count() and next(r for r in rows if r["doc_id"] is None)["start"] == 0
    assert tokenfiles.round_trip(odd.limit(0), VOCAB).count() == 0
    many = spark.createDataFrame([(None if k % 3 else 7, f"text number {k} " * (k % 5)) for k in range(300)], "doc_id long, text string")
    at = 0
    for r in sorted(tokenfiles.round_trip(many, VOCAB).collect(), key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    tokenfiles.write(docs, str(tmp_path / "ids"), VOCAB)
    some = tokenfiles.find(spark, str(tmp_path / "ids"), [3, 5])
    assert {r["doc_id"]: r["ids"] for r in some.collect()} == {k: [*reference_ids(texts[k]), 1] for k in (3, 5)}
    assert "In(doc_id" in some._jdf.queryExecution().executedPlan().toString()
