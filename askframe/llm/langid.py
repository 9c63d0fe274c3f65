"""Language identification with language-bitmask n-gram filters.

The commonest byte n-grams of each language go into one bit-sliced Bloom filter: a row of the table is a mask with a bit
for each language, of one byte for up to eight languages, else of as many 64-bit words as they need, and looking up an n-gram ANDs a few rows, which gives every language that has it.  A text's n-grams
are looked up all at once; per language the bits are counted, the count is corrected for the filter's measured rate of
false positives, and the language with the largest corrected share wins.

The model is fitted on at most about ``sample`` labelled documents of each language (chosen by a hash of doc_id), which
bounds it whatever the corpus (the driver holds ``top`` n-grams of each language); every document is then scored whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text where there is nothing to
learn from; a text too short for an n-gram gets the commonest language with score 0; ties go to the language that sorts
first; a null doc_id is neither learnt from nor held out; repeated rows are independent; of extra columns none matters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import checkpoint, forget, slices, text_bytes

GRAM = 4
SAMPLE = 3000
TOP = 8192
ROWS = 1 << 17
HASHES = 3
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
LEAST = 0.25
_SPACE = 0x20202020


@dataclass
class Model:
    """Languages in order, the filter's rows, each language's rate of false positives, and the commonest language."""

    languages: list[str]
    rows: np.ndarray
    false: np.ndarray
    usual: int


def _fold_table() -> np.ndarray:
    """Bytes as counted: A-Z lower-cased, other ASCII but letters to spaces, bytes of longer characters as they are."""
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    return t


def codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram codes of concatenated texts, and for each code its text."""
    b = _fold_table()[data]
    if len(b) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    b[upper] += 0x20  # capital letters of Latin-1 are those of lower case 0x20 before
    w = b.astype(np.uint32)
    n = len(b) - GRAM + 1
    code = w[:n] | (w[1 : n + 1] << np.uint32(8)) | (w[2 : n + 2] << np.uint32(16)) | (w[3:] << np.uint32(24))
    size = np.maximum(np.diff(off) - GRAM + 1, 0)
    doc = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(doc)) + np.repeat(off[:-1] - (np.cumsum(size) - size), size)
    code = code[at]
    use = code != _SPACE
    return code[use], doc[use]


def places(code: np.ndarray, rows: int, hashes: int) -> list[np.ndarray]:
    """Rows of the filter for each code and hash function."""
    h = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bits = rows.bit_length() - 1
    return [(h >> np.uint64(64 - bits * (k + 1))).astype(np.int64) & (rows - 1) for k in range(hashes)]


def fit(docs: DataFrame, sample: int = SAMPLE, top: int = TOP, rows: int = ROWS, hashes: int = HASHES) -> Model:
    """Learn from rows of ``docs`` (doc_id, text, lang) outside the held-out fold."""
    ship(docs.sparkSession)
    crc = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    train = docs.where((crc % FOLDS != HELD_OUT) & docs["lang"].isNotNull() & docs["text"].isNotNull()).select("doc_id", "text", "lang")
    counts = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return Model([], np.zeros((rows, 1), np.uint64), np.zeros(0), 0)
    languages = sorted(counts)
    even = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    number = {lang: k for k, lang in enumerate(languages)}
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / counts[lang]))])
    chosen = train.where(even < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                mine = batch.filter(pa.array(langs == lang))
                data, off = text_bytes(mine.column(1))
                code, n = np.unique(codes(data, off)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n, pa.int64())], ["lang", "code", "n"])

    grams = checkpoint(chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")))
    # A top list of each language; a language's n-grams are bounded by the sample.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = grams.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "code").toPandas()
    kind, width = (np.uint8, 8) if len(languages) <= 8 else (np.uint64, 64)
    table = np.zeros((rows, -(-len(languages) // width)), kind)
    for lang, own in best.groupby("lang"):
        word, bit = divmod(number[lang], width)
        for at in places(own["code"].to_numpy(np.uint32), rows, hashes):
            table[at, word] |= kind(1 << bit)
    full = np.array([(table[:, k // width] >> kind(k % width) & kind(1)).mean() for k in range(len(languages))])
    return Model(languages, table, full**hashes, number[max(languages, key=lambda x: (counts[x], x))])


def score_texts(model: Model, hashes: int, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the language and score for each of some concatenated texts."""
    n, some = len(off) - 1, len(model.languages)
    code, doc = codes(data, off)
    first, *rest = places(code, len(model.rows), hashes)
    mask = model.rows[first]
    for at in rest:
        mask = mask & model.rows[at]
    kind, width = mask.dtype.type, 8 * mask.dtype.itemsize
    total = np.bincount(doc, minlength=n).astype(float)
    hits = np.stack([np.bincount(doc, weights=(mask[:, k // width] >> kind(k % width)) & kind(1), minlength=n) for k in range(some)], axis=1)
    true = np.clip((hits - total[:, None] * model.false) / (1 - model.false), 0, None)
    best = true.argmax(axis=1)
    value = true[np.arange(n), best] / np.maximum(total, 1)
    best[true.max(axis=1) <= 0] = model.usual
    return best, np.clip(value, 0, 1)


def verdict(model: Model, docs: DataFrame, hashes: int = HASHES) -> Column:
    """The column (lang_pred, score) of the texts of ``docs``: only texts go to Python and only verdicts come back."""
    ship(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)  # bounded: rows of the filter, whatever the corpus

    def judge(part: pa.RecordBatch) -> pa.Array:
        model = given.value
        names = np.array([*model.languages, UNKNOWN], object)
        data, off = text_bytes(part.column(0))
        letter = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))))
        has = letter[off[1:]] > letter[off[:-1]]
        for k in np.flatnonzero(~has & (np.diff(off) > 0)):
            has[k] = any(c.isalpha() for c in part.column(0)[int(k)].as_py())
        best, value = score_texts(model, hashes, data, off) if model.languages else (np.zeros(len(has), int), np.zeros(len(has)))
        best = np.where(has, best, len(model.languages))
        return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(np.where(has, value, 0.0))], ["lang_pred", "score"])

    def run(texts):
        forget()
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [judge(part) for part in slices(batch, 2 << 20, 0)]
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(run, "lang_pred string, score double", F.ArrowUDFType.SCALAR)(F.coalesce(docs["text"].cast("string"), F.lit("")))


def identify(docs: DataFrame, model: Model, hashes: int = HASHES) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    crc = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(crc % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"), verdict(model, docs, hashes).alias("v"))
    return rows.select("doc_id", "held_out", "v.lang_pred", "v.score")


def language_ids(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit and identify."""
    return identify(docs, fit(docs, sample))


def keep_known(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents whose language is known: not ``und``, and at least ``least`` of the n-grams are the language's; texts too
    short for an n-gram leave nothing to measure and stay unless ``und``.  A filter where the rows are; nothing is shuffled."""
    v = verdict(fit(docs), docs)
    return docs.where((v["lang_pred"] != UNKNOWN) & ((v["score"] >= least) | (F.octet_length(docs["text"].cast("string")) < GRAM)))
