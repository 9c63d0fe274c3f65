"""The label model, the n-gram filter and the fences against plain versions of them, and more languages than a word has bits."""

import math
import random

import numpy as np

from askframe.llm import langid, quality, toxicity


def label_model_brute(votes, given, trust, rounds=40):
    n, m = len(votes), len(votes[0])
    share = [1.0] * m
    for _ in range(2):
        post = [trust if g else 1 - trust for g in given]
        for _ in range(rounds):
            total = sum(post)
            prior = min(max(total / n, 0.01), 0.6)
            one = [(sum(p * r[j] for p, r in zip(post, votes)) + 0.5) / (total + 1) for j in range(m)]
            zero = [min((sum((1 - p) * r[j] for p, r in zip(post, votes)) + 0.05) / (n - total + 1), one[j]) for j in range(m)]
            new = []
            for r, g in zip(votes, given):
                x = math.log(prior / (1 - prior)) + (1 if g else -1) * math.log(trust / (1 - trust))
                x += sum(share[j] * math.log(one[j] / zero[j]) for j in range(m) if r[j])
                new.append(1 / (1 + math.exp(-min(max(x, -30), 30))))
            moved = max(abs(a - b) for a, b in zip(new, post))
            post = new
            if moved < 1e-4:
                break
        rest = [[r[j] - p * one[j] - (1 - p) * zero[j] for j in range(m)] for p, r in zip(post, votes)]
        scale = [math.sqrt(sum(x[j] ** 2 for x in rest) / n) + 1e-9 for j in range(m)]
        correlation = [[sum(x[i] * x[j] for x in rest) / n / scale[i] / scale[j] for j in range(m)] for i in range(m)]
        share = [1 / sum(max(c, 0) for c in row) for row in correlation]
    return post, [zero, one], correlation


def test_label_model_brute():
    rng = random.Random(6)
    truth = [rng.random() < 0.25 for _ in range(300)]
    votes = [[int(rng.random() < (0.6 if y else 0.03)) for _ in range(4)] for y in truth]
    votes = [[*r, r[0]] for r in votes]
    given = [y ^ (rng.random() < 0.08) for y in truth]
    post, rates, correlation = toxicity.label_model(np.array(votes, np.uint8), np.array(given), trust=0.9)
    want = label_model_brute(votes, given, 0.9)
    assert np.allclose(post, want[0]) and np.allclose(rates, want[1]) and np.allclose(correlation, want[2])


def test_scores_are_sums_of_weights(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.weights and model.accuracies.shape == (2, len(model.voters))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        names = toxicity.features(set(toxicity.WORD.findall((texts[r["doc_id"]] or "").lower())))
        z = model.intercept + sum(model.weights.get(n, 0.0) for n in names)
        assert abs(r["score"] - 1 / (1 + math.exp(-min(max(z, -30), 30)))) < 1e-8 and r["predicted"] == (r["score"] >= 0.5)


def test_fences_against_exact_quantiles(spark):
    rng, rows = random.Random(7), []
    for i in range(150):  # few enough for a sketch to hold them all
        marks = rng.randint(0, 40)
        rows.append((i, " ".join(f"w{i}x{k}" + ("#" if k < marks else "") for k in range(60)), "en", "a" if i % 3 else "b"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = quality._ratios(quality.measures(docs)).collect()

    def fence(values):
        v = np.sort(values)
        q = [v[min(len(v) - 1, max(0, math.ceil(p * len(v)) - 1))] for p in (0.25, 0.75, 0.98)]
        return max(0.10, q[1] + quality.REACH * (q[1] - q[0]), q[2])

    own = {s: [r["symbol_ratio"] for r in measured if r["source"] == s] for s in "ab"}
    wide = fence(own["a"] + own["b"])
    for r in quality.fences(quality._ratios(quality.measures(docs))).collect():
        n = len(own[r["source"]])
        want = (n * fence(own[r["source"]]) + quality.LEAST_ROWS * wide) / (n + quality.LEAST_ROWS)
        assert abs(r["fence_symbol_ratio"] - want) < 0.05 * want


def test_trust_is_estimated():
    rng = np.random.default_rng(4)
    for trust in (0.85, 0.92, 0.98):
        y = rng.random(8000) < 0.15
        votes = np.stack([np.where(y, rng.random(8000) < rng.uniform(0.2, 0.7), rng.random(8000) < 0.01) for _ in range(20)], axis=1)
        votes = np.concatenate([votes, votes[:, :3]], axis=1).astype(np.uint8)  # three echoes
        assert abs(toxicity.estimate_trust(votes, y ^ (rng.random(8000) > trust)) - trust) < 0.02
    assert toxicity.estimate_trust(np.zeros((10, 3), np.uint8), y[:10]) == 0.98


def classify_brute(model, text):
    """(language, score) by one look-up an n-gram."""
    raw, fold = text.encode(), b""
    for k, b in enumerate(raw):
        c = chr(b)
        if b < 128:
            fold += c.lower().encode() if c.isalpha() else b" "
        else:
            fold += bytes([b + 32 if 0x80 <= b <= 0x9E and k and raw[k - 1] == 0xC3 else b])
    grams = [fold[i : i + 4] for i in range(len(fold) - 3) if fold[i : i + 4] != b"    "]
    hits, width = [0] * len(model.languages), 8 * model.rows.dtype.itemsize
    for g in grams:
        rows = [int(p[0]) for p in langid.places(np.array([int.from_bytes(g, "little")], np.uint32), len(model.rows), langid.HASHES)]
        for k in range(len(hits)):
            hits[k] += all(int(model.rows[r, k // width]) >> (k % width) & 1 for r in rows)
    true = [max(0, (h - len(grams) * f) / (1 - f)) for h, f in zip(hits, model.false)]
    best = max(range(len(true)), key=lambda k: (true[k], -k)) if max(true) > 0 else model.usual
    return model.languages[best], min(1.0, true[best] / max(1, len(grams)))


def test_filter_brute(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    texts = [r["text"][:400] for r in docs.collect()] + ["a", "abcd", "ÉÀ Ça 1234", "!!!", "    "]
    data = "".join(texts).encode()
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    best, value = langid.score_texts(model, langid.HASHES, np.frombuffer(data, np.uint8), off)
    for t, b, v in zip(texts, best, value, strict=True):
        want = classify_brute(model, t)
        assert (model.languages[b], round(v, 9)) == (want[0], round(want[1], 9)), t


def test_seventy_languages(spark):
    rng, rows = random.Random(2), []
    words = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)] for k in range(70)}
    for i in range(1400):
        rows.append((i, " ".join(rng.choice(words[i % 70]) for _ in range(30)), f"l{i % 70:02}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.language_ids(docs).collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id'] % 70:02}" for r in got) >= 0.99 * len(rows)


def test_fences_are_blended_and_nulls_apart(spark):
    """A fence moves with the group's size instead of switching, and a null language is not an empty one."""
    rows = [(i, " ".join(f"w{i}x{k}" + ("#" if k < marks else "") for k in range(60)), lang, "s") for lang, marks, n in ((None, 12, 300), ("", 0, 300)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r["lang"]: r["fence_symbol_ratio"] for r in quality.fences(quality._ratios(quality.measures(docs))).collect()}
    assert found[None] > 0.19 and found[""] == 0.1
    two = [(i, " ".join(f"w{i}x{k}" + ("#" if k < (24 if i < 50 else 0) else "") for k in range(60)), "en", "a" if i < 50 else "b") for i in range(1050)]
    fence = {r["source"]: r["fence_symbol_ratio"] for r in quality.fences(quality._ratios(quality.measures(spark.createDataFrame(two, docs.schema)))).collect()}
    wide = 0.4  # 50 of 1,050 rows are beyond the 98th percentile's place
    assert abs(fence["a"] - (50 * 0.4 + 200 * wide) / 250) < 0.02 and abs(fence["b"] - (1000 * 0.1 + 200 * wide) / 1200) < 0.02
