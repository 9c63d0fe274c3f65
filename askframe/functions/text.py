"""Text operators as column expressions: normalising, tokens, n-grams, literal masks."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vietnamese words that carry no meaning for linking.
STOP_WORDS = (
    "là", "của", "các", "những", "một", "có", "cho", "và", "hoặc", "nhưng", "không", "nào", "gì", "ai", "hãy", "liệt_kê",
    "hiển_thị", "tìm", "đưa", "trả_về", "lấy", "cho_biết", "tôi", "này", "kia", "rằng", "thì", "mà", "để", "với", "tại", "từ",
    "đến", "trong", "ngoài", "dưới", "trên", "khi", "lúc", "đang", "đã", "sẽ", "nhé", "nha", "ạ", "liệt", "kê",
)
PUNCTUATION = string.punctuation
PUNCTUATION_BUT_JOINER = PUNCTUATION.replace("_", "")
#: What counts as a number and as a date in a question.
NUMBER = r"\b\d+(?:[.,]\d+)?\b"
DATE = r"\b\d{4}[-/]\d{2}[-/]\d{2}\b|\b\d{2}/\d{2}/\d{4}\b|(?i:\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{4}\b)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise(text: Column | str) -> Column:
    """Lower case without punctuation, trimmed."""
    return F.trim(F.translate(F.lower(_c(text)), PUNCTUATION, ""))


def tokens(text: Column | str) -> Column:
    """White-space tokens of the normalised text, longer than one character."""
    return F.filter(F.split(normalise(text), r"\s+"), lambda t: F.length(t) > 1)


#: From a text column to one in which the words of a compound are joined by ``_``.
Segmenter = Callable[[Column], Column]


def compound_segmenter(compounds: Iterable[str]) -> Segmenter:
    """A segmenter that joins the words of known compounds, the longest first, whatever their case."""
    known = sorted({" ".join(c.lower().replace("_", " ").split()) for c in compounds if " " in c.strip() or "_" in c.strip("_")}, key=lambda c: (-len(c), c))
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(c).replace(r"\ ", r"\s+") for c in known) + r")(?!\w)", re.IGNORECASE) if known else None

    def join(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else pattern.sub(lambda m: "_".join(m.group().split()), t))

    udf = F.pandas_udf(join, "string", F.PandasUDFType.SCALAR)
    return (lambda text: udf(text)) if pattern else (lambda text: text)


def question_tokens(text: Column | str, drop_stop_words: bool = True, segment: Segmenter | None = None) -> Column:
    """Tokens of a question or of a schema name: punctuation goes but the word joiner ``_``, stop-words and single letters go.

    ``segment`` joins the words of compounds by ``_``; without it the text's own joiners count.
    """
    text = segment(_c(text)) if segment else _c(text)
    words = F.split(F.trim(F.translate(F.lower(text), PUNCTUATION_BUT_JOINER, "")), r"\s+")
    return F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS) if drop_stop_words else F.length(t) > 1)


def content_tokens(text: Column | str) -> Column:
    """As question_tokens, with letters' case kept."""
    words = F.split(F.trim(F.translate(_c(text), PUNCTUATION_BUT_JOINER, "")), r"\s+")
    return F.filter(words, lambda t: (F.length(t) > 1) & ~F.lower(t).isin(*STOP_WORDS))


def ngrams(words: Column | str, most: int) -> Column:
    """Array of (n, pos, gram) for n from ``most`` down to 1: all runs of n words, joined by blanks."""
    words = _c(words)

    def of(n: int) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct(F.lit(n).alias("n"), i.alias("pos"), F.array_join(F.slice(words, i + 1, n), " ").alias("gram")))
        return F.when(F.size(words) >= n, some).otherwise(F.array().cast("array<struct<n:int,pos:int,gram:string>>"))

    return F.flatten(F.array(*[of(n) for n in range(most, 0, -1)]))


def quoted_spans(text: Column | str) -> Column:
    """What stands between quotes."""
    return F.regexp_extract_all(_c(text), F.lit("['\"]([^'\"]+)['\"]"), F.lit(1))


def mask_literals(text: Column | str) -> Column:
    """Numbers become NUM, quoted strings STR; white space is collapsed."""
    masked = F.regexp_replace(_c(text), r"\b\d+(\.\d+)?\b", "NUM")
    masked = F.regexp_replace(masked, "'[^']*'|\"[^\"]*\"", "STR")
    return F.trim(F.regexp_replace(masked, r"\s+", " "))


def value_candidates(text: Column | str, most: int = 4) -> Column:
    """Substrings of a question that may be values: quoted ones, then content n-grams, the longest first; each once."""
    grams = F.transform(ngrams(content_tokens(text), most), lambda g: F.translate(g["gram"], "_", " "))
    spans = F.filter(F.transform(F.concat(quoted_spans(text), grams), lambda s: F.trim(s)), lambda s: F.length(s) >= 2)
    kept = F.aggregate(spans, F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("out")), lambda a, s: F.when(F.array_contains(a["keys"], F.lower(s)), a).otherwise(F.struct(F.concat(a["keys"], F.array(F.lower(s))).alias("keys"), F.concat(a["out"], F.array(s)).alias("out"))))
    return kept["out"]


def nfc(text: Column | str) -> Column:
    """Unicode normalisation form C; Spark has no function for it, so Arrow batches go through Python."""

    def normal(s):
        return s.str.normalize("NFC")

    return F.pandas_udf(normal, "string", F.PandasUDFType.SCALAR)(_c(text))


def has_number(text: Column | str) -> Column:
    return _c(text).rlike(NUMBER)


def has_date(text: Column | str) -> Column:
    return _c(text).rlike(DATE)
