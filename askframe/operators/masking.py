"""Masking what a question names: with one mark, or with one for each kind of thing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..functions.text import DATE, NUMBER, STOP_WORDS

TAGS = {"column": "COLUMN", "table": "TABLE", "cell": "VALUE", "num": "NUM", "date": "DATE"}
_KINDS = ("column", "table", "cell")
_LITERAL = re.compile(rf"(?P<date>{DATE.replace('(?i:', '(?:')})|(?P<num>{NUMBER})", re.IGNORECASE)
_DROP = re.compile(r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^`{|}~]")


def _words(question: str) -> list[tuple[str, str | None]]:
    """Words of a question, with the kind of those that are dates or numbers, which are found before punctuation goes."""
    out, at = [], 0
    for m in [*_LITERAL.finditer(question), None]:
        plain = question[at : m.start() if m else len(question)]
        out += [(w, None) for w in _DROP.sub("", plain.lower()).split() if len(w) > 1 and w not in STOP_WORDS]
        if m:
            out.append((m.group(0).lower(), m.lastgroup))
            at = m.end()
    return out


def mask(question: str, spans: list[tuple[str, str]], tags: dict[str, str], collapse: bool = True) -> str:
    """Mask the spans (text, kind), the longest first, then dates and numbers; marks of one kind in a row become one.

    ``_`` joins the words of a compound as a blank does, so that a value with blanks masks its joined form too.
    """
    words = _words(question)
    marks: list[str | None] = [None] * len(words)
    for text, kind in sorted(set(spans), key=lambda s: (-len(s[0].split()), -len(s[0]), s)):
        for want in {tuple(text.lower().split()), (text.lower().replace(" ", "_"),)}:
            n = len(want)
            for i in range(len(words) - n + 1):
                if n and not any(marks[i : i + n]) and tuple(w for w, _ in words[i : i + n]) == want:
                    marks[i : i + n] = [kind] * n
    out: list[str] = []
    before = None
    for (word, literal), kind in zip(words, marks, strict=True):
        mark = tags[kind or literal] if kind or literal else None
        if not (collapse and mark and mark == before):
            out.append(mark or word)
        before = mark
    return " ".join(out)


def _masked(question: Column, spans: Column, tags: dict[str, str], collapse: bool) -> Column:
    def run(q: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([mask(a, [(x["span"], x["kind"]) for x in ([] if b is None else b)], tags, collapse) for a, b in zip(q, s, strict=True)])

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)(question, spans)


def mask_questions(questions: DataFrame, links: DataFrame, typed: bool = False, mark: str = "_", collapse: bool = True) -> DataFrame:
    """questions with ``masked``: what links name is masked, by ``mark`` or by the tag of its kind."""
    ship(questions.sparkSession)
    spans = links.where(F.col("span").isNotNull() & F.col("kind").isin(*_KINDS)).groupBy("question_id").agg(F.collect_set(F.struct("span", "kind")).alias("spans"))
    tags = TAGS if typed else dict.fromkeys(TAGS, mark)
    return questions.join(spans, "question_id", "left").withColumn("masked", _masked(F.col("question"), F.col("spans"), tags, collapse)).drop("spans")
