"""Toxicity by weak supervision.

Many voters look at each labelled training document: lexicon voters (a word, or words with a common beginning, that occur
far more often in toxic documents) and pattern voters (shouting, exclamations, second person, several lexicon hits).  A
generative label model estimates by expectation maximisation how often each voter fires on either class, and from what
is left unexplained how voters correlate; voters that say the same share their weight.  The row's own label is one more voter,
whose accuracy is estimated from its and the voters' covariances.  A linear classifier over words and
word beginnings is trained on the posterior labels and scores every whole text.

The model is fitted on about ``sample`` labelled documents, chosen by a hash of doc_id, outside the held-out fold; labels,
lang, source and doc_id are no inputs of a score.

Defined results: a null or empty text scores what the classifier's intercept gives; without labels to learn from every
score is 0; a null doc_id is neither learnt from nor held out; repeated rows are independent; repeated labels of one document
count each; of extra columns none matters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import id_and_text, slices

SAMPLE = 8000
FOLDS, HELD_OUT = 5, 0
VOTERS = 240
STEMS = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
#: Patterns whose presence is a vote; the voters' accuracies are estimated like all others'.
PATTERNS = (r"!{2,}", r"\b[A-Z]{4,}\b[^a-z]{0,3}\b[A-Z]{4,}\b", r"(?i)\byou\s+(?:are|re)\b", r"(?i)\byou(?:'re)?\s+\w+\s+\w*(?:er|ot|id|on)\b", r"[?!]{3,}", r"(?i)\b(?:hate|kill|shut\s+up)\b")


@dataclass
class Model:
    """Weights of features (a word, or ``n:`` and a word's first n letters), intercept, and what the label model found."""

    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = -30.0
    voters: list[str] = field(default_factory=list)
    accuracies: np.ndarray | None = None
    correlations: np.ndarray | None = None


def features(words: set[str]) -> set[str]:
    """Words and their beginnings."""
    out = set(words)
    for n in STEMS:
        out.update({f"{n}:{w[:n]}" for w in words if len(w) >= n})
    return out


def estimate_trust(votes: np.ndarray, given: np.ndarray, most: int = 40, usual: float = 0.98) -> float:
    """How often given labels are right, from how they and pairs of voters agree.

    Where label and two voters are independent within a class, cov(label, a) cov(label, b) / cov(a, b) does not depend on the
    voters: it is (2 t - 1) ** 2 p (1 - p) for a trust of t and a share p of class 1, and p follows from t and the share of
    labels that are 1.  The median over pairs of the ``most`` voters that go best with the label, but for echoes of each other,
    gives t; without such pairs it is ``usual``."""
    n = len(votes)
    g, v = given - given.mean(), votes - votes.mean(axis=0)
    with_label = g @ v / n
    best = np.argsort(-with_label, kind="stable")[:most]
    best = best[with_label[best] > 0]
    both = v[:, best].T @ v[:, best] / n
    scale = np.sqrt(np.clip(np.diag(both), 1e-12, None))
    a, b = np.triu_indices(len(best), 1)
    like = both[a, b] / (scale[a] * scale[b])
    use = (like > 4 / np.sqrt(n)) & (like < 0.6)
    if not use.any():
        return usual
    c = np.median(with_label[best[a[use]]] * with_label[best[b[use]]] / both[a[use], b[use]])
    t = np.linspace(0.7, 0.995, 296)
    p = np.clip((given.mean() - 1 + t) / (2 * t - 1), 0.0, 1.0)
    return float(t[np.abs((2 * t - 1) ** 2 * p * (1 - p) - c).argmin()])


def label_model(votes: np.ndarray, given: np.ndarray, trust: float = 0.98, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row of 0/1 votes, the rates at which voters fire on classes 0 and 1, and correlations.

    ``given`` are the rows' own labels: one more voter, right with probability ``trust``, that ties the latent class to them.

    Two passes of expectation maximisation: the first takes voters as independent within a class, the second divides
    each voter's weight by the sum of its positive correlations with others, as estimated from the first one's residuals.
    """
    n, m = votes.shape
    v = votes.astype(float)
    share = np.ones(m)
    correlation = np.eye(m)
    for _ in range(2):
        post = np.where(given, trust, 1 - trust)
        for _ in range(rounds):
            prior = np.clip(post.mean(), 0.01, 0.6)
            one = (post @ v + 0.5) / (post.sum() + 1.0)
            zero = ((1 - post) @ v + 0.05) / ((1 - post).sum() + 1.0)
            zero = np.minimum(zero, one)  # a voter never speaks against its class
            log = np.log(prior / (1 - prior)) + np.where(given, 1, -1) * np.log(trust / (1 - trust)) + v @ (share * np.log(one / zero))  # a voter that does not fire abstains
            new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
            done = np.abs(new - post).max() < 1e-4
            post = new
            if done:
                break
        rest = v - np.outer(post, one) - np.outer(1 - post, zero)
        scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        correlation = (rest.T @ rest) / n / np.outer(scale, scale)
        share = 1 / np.clip(correlation, 0, None).sum(axis=1)
    return post, np.stack([zero, one]), correlation


def train_linear(rows: list[np.ndarray], size: int, target: np.ndarray, rounds: int = 400, rate: float = 1.0, ridge: float = 5e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of feature numbers with soft targets: full-batch descent with Adam's step sizes."""
    count = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), count)
    weight = np.where(target > 0.5, 0.5 / max(1e-9, (target > 0.5).mean()), 0.5 / max(1e-9, (target <= 0.5).mean()))
    w, b = np.zeros(size), 0.0
    m, s, mb, sb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[flat], minlength=len(rows)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        grad, gb = np.bincount(flat, weights=g[row], minlength=size) + ridge * w, g.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb**2
        step = rate / (1 + t / 50)
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-6) * 0.2
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + 1e-6) * 0.2
    return w, b


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """toxic, words (joined by blanks) and patterns (joined flags) of a bounded sample of labelled rows."""
    docs = id_and_text(docs)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where((crc % FOLDS != HELD_OUT) & F.col("toxic").isNotNull())
    share = min(1.0, sample / max(1, known.count()))
    even = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    chosen = docs.where(even < share).join(known.where(even < share), "doc_id")

    def run(batches):
        for batch in batches:
            words, flags = [], []
            for t in batch.column(1).to_pylist():
                words.append(" ".join(sorted(set(WORD.findall(t.lower())))))
                flags.append("".join("1" if re.search(p, t) else "0" for p in PATTERNS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string()), pa.array(flags, pa.string())], ["toxic", "words", "flags"])

    return chosen.select("toxic", "text").mapInArrow(run, "toxic int, words string, flags string")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, voters: int = VOTERS) -> Model:
    got = sorted(training_rows(docs, labels, sample).collect(), key=lambda r: (r.words, r.toxic))  # bounded by `sample`
    toxic = np.array([r.toxic == 1 for r in got])
    if not toxic.any() or toxic.all():
        return Model()
    names: dict[str, int] = {}
    rows = [np.array(sorted({names.setdefault(f, len(names)) for f in features(set(r.words.split()))}), np.int64) for r in got]
    label = list(names)
    of = np.bincount(np.concatenate(rows), minlength=len(label))
    bad = np.bincount(np.concatenate([r for r, t in zip(rows, toxic, strict=True) if t]), minlength=len(label))
    n1, n0 = toxic.sum(), (~toxic).sum()
    odds = np.log((bad + 0.5) / (n1 + 1)) - np.log((of - bad + 0.5) / (n0 + 1))
    error = np.sqrt(1 / (bad + 0.5) + 1 / (of - bad + 0.5))
    order = np.lexsort((np.arange(len(label)), -(odds / error)))
    lexicon = np.array([k for k in order[: 4 * voters] if bad[k] >= 3 and odds[k] / error[k] > 2.5 and odds[k] > 1.5][:voters], np.int64)
    lexicon_set = set(lexicon.tolist())
    column = {k: j for j, k in enumerate(lexicon.tolist())}
    votes = np.zeros((len(rows), len(lexicon) + 1 + len(PATTERNS)), np.uint8)
    for i, r in enumerate(rows):
        hits = [column[k] for k in r.tolist() if k in lexicon_set]
        votes[i, hits] = 1
        votes[i, len(lexicon)] = len({label[lexicon[h]].rpartition(":")[2][:4] for h in hits}) >= 2
    votes[:, len(lexicon) + 1 :] = [[int(x) for x in r.flags] for r in got]
    post, rates, correlation = label_model(votes, toxic, estimate_trust(votes, toxic))
    # Only features that speak for class 1 beyond chance take part: the absence of a common word says nothing.
    soft = np.bincount(np.concatenate(rows), weights=np.repeat(post, [len(r) for r in rows]), minlength=len(label))
    odds = np.log((soft + 0.5) / (post.sum() + 1)) - np.log((of - soft + 0.5) / ((1 - post).sum() + 1))
    common = np.flatnonzero((of >= 4) & (odds > 1.5) & (odds > 3.5 * np.sqrt(1 / (soft + 0.5) + 1 / (of - soft + 0.5))))
    renumber = np.full(len(label), -1)
    renumber[common] = np.arange(len(common))
    w, b = train_linear([(x := renumber[r])[x >= 0] for r in rows], len(common), post)
    keep = np.abs(w) > 1e-2
    named = [label[k] for k in lexicon] + ["several hits", *PATTERNS]
    return Model({label[k]: float(x) for k, x in zip(common[keep], w[keep], strict=True)}, float(b), named, rates, correlation)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = id_and_text(docs)
    given = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))  # bounded by the sample's vocabulary

    def run(batches):
        weights, intercept = given.value
        words = {k: v for k, v in weights.items() if ":" not in k}
        stems = [(n, {k.partition(":")[2]: v for k, v in weights.items() if k.startswith(f"{n}:")}) for n in STEMS]
        for batch in (part for whole in batches for part in slices(whole, 4 << 20)):
            z = np.empty(batch.num_rows)
            for i, t in enumerate(batch.column(1).to_pylist()):
                own = set(WORD.findall(t.lower()))
                total = sum([words[w] for w in own.intersection(words)])
                for n, table in stems:
                    total += sum([table[s] for s in {w[:n] for w in own}.intersection(table) if len(s) == n])
                z[i] = total
            value = 1 / (1 + np.exp(-np.clip(z + intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(value, 9))], ["doc_id", "score"])

    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    out = docs.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(crc % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    ship(docs.sparkSession)
    return score(docs, fit(docs, labels, sample))
