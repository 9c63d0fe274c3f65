"""Operators on SQL text, as column expressions wherever Spark's functions express them.

Literals are told apart from code first, so that keyword casing, comma spacing and the like never touch a string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import mask_literals

#: The SQL vocabulary that normalising knows.
KEYWORDS = (
    "SELECT FROM WHERE JOIN LEFT RIGHT INNER OUTER FULL CROSS ON AND OR NOT IN EXISTS BETWEEN LIKE IS NULL AS DISTINCT GROUP BY "
    "HAVING ORDER ASC DESC LIMIT OFFSET UNION INTERSECT EXCEPT ALL CASE WHEN THEN ELSE END WITH INSERT UPDATE DELETE SET INTO "
    "VALUES CREATE TABLE DROP ALTER INDEX PRIMARY KEY FOREIGN REFERENCES COUNT SUM AVG MIN MAX COALESCE IFNULL CAST SUBSTR "
    "LENGTH TRIM UPPER LOWER"
).split()
CLAUSES = ("SELECT", "WHERE", "GROUP BY", "HAVING", "ORDER BY", "LIMIT", "JOIN")
LEVELS = ("easy", "medium", "hard", "extra")
_WORDS = "|".join(KEYWORDS)
_STRING = "'(?:[^']|'')*'|\"[^\"]*\""
_ENDS = "FROM|WHERE|GROUP|HAVING|ORDER|LIMIT|JOIN|UNION"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _outside_strings(sql: Column, change) -> Column:
    """``change`` applied to what stands outside string literals; the array of parts and the array of literals alternate."""
    parts, strings = F.split(sql, _STRING), F.regexp_extract_all(sql, F.lit(f"({_STRING})"), F.lit(1))
    return F.array_join(F.flatten(F.zip_with(F.transform(parts, change), strings, lambda p, s: F.array(F.coalesce(p, F.lit("")), F.coalesce(s, F.lit(""))))), "")


def _upper_keywords(part: Column) -> Column:
    """Keywords in capitals, by the words of the part and what stands between them."""
    words = F.regexp_extract_all(part, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    gaps = F.split(part, r"[\p{L}\p{N}_]+")
    cased = F.transform(words, lambda w: F.when(F.upper(w).isin(*KEYWORDS), F.upper(w)).otherwise(w))
    return F.array_join(F.flatten(F.zip_with(gaps, cased, lambda g, w: F.array(F.coalesce(g, F.lit("")), F.coalesce(w, F.lit(""))))), "")


def normalize(sql: Column | str) -> Column:
    """Keywords in capitals, single blanks, no final semicolon; string literals keep their letters."""
    bare = F.regexp_replace(F.trim(_c(sql)), r"(?s)[;\s]+$", "")
    return F.trim(_outside_strings(bare, lambda p: F.regexp_replace(_upper_keywords(p), r"\s+", " ")))


def skeleton(sql: Column | str) -> Column:
    """Keywords, operators and punctuation of a statement, with ``_`` for every literal and identifier (dotted ones are one)."""
    text = F.regexp_replace(normalize(sql), _STRING, "_")
    text = F.regexp_replace(text, r"(?<![\p{L}\p{N}_.])\d+(?:\.\d+)?(?![\p{L}\p{N}_])", "_")
    name = rf"(?<![\p{{L}}\p{{N}}_.])(?!(?:{_WORDS})(?![\p{{L}}\p{{N}}_.]))[\p{{L}}_][\p{{L}}\p{{N}}_]*(?:\.(?:\*|[\p{{L}}\p{{N}}_]+))*"
    return F.regexp_replace(text, name, "_")


def literal_skeleton(sql: Column | str) -> Column:
    """Only literals masked: NUM and STR."""
    return mask_literals(sql)


def keywords(sql: Column | str) -> Column:
    """Keywords that occur, in the vocabulary's order."""
    return F.array_compact(F.array(*[F.when(_c(sql).rlike(rf"(?i)\b{k}\b"), F.lit(k)) for k in KEYWORDS]))


def has_join(sql: Column | str) -> Column:
    return _c(sql).rlike(r"(?i)\bJOIN\b")


def has_subquery(sql: Column | str) -> Column:
    return F.regexp_count(_c(sql), F.lit(r"(?i)\bSELECT\b")) >= 2


def has_aggregation(sql: Column | str) -> Column:
    return _c(sql).rlike(r"(?i)\b(?:COUNT|SUM|AVG|MIN|MAX)\s*\(")


def has_group_by(sql: Column | str) -> Column:
    return _c(sql).rlike(r"(?i)\bGROUP\s+BY\b")


def has_order_by(sql: Column | str) -> Column:
    return _c(sql).rlike(r"(?i)\bORDER\s+BY\b")


def complexity(sql: Column | str) -> Column:
    """extra: nested or three joins; hard: two joins, or one with grouping; medium: a join, aggregate or grouping; else easy."""
    joins = F.regexp_count(_c(sql), F.lit(r"(?i)\bJOIN\b"))
    return (
        F.when(has_subquery(sql) | (joins >= 3), "extra").when((joins >= 2) | ((joins >= 1) & has_group_by(sql)), "hard")
        .when((joins >= 1) | has_aggregation(sql) | has_group_by(sql), "medium").otherwise("easy")
    )


def clause(sql: Column | str, name: str) -> Column:
    """What follows the first occurrence of a clause's keyword up to the next clause, in capitals; empty if there is none."""
    body = F.regexp_extract(_c(sql), rf"(?is)\b{name}\b(.*?)(?:\b(?:{_ENDS})\b|$)", 1)
    return F.upper(F.trim(F.regexp_replace(body, r"\s+", " ")))


def clauses(sql: Column | str) -> Column:
    """Map from clause to its text."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in CLAUSES]), F.array(*[clause(sql, c) for c in CLAUSES]))


def literal_pairs(sql: Column | str) -> Column:
    """(column, literal) of comparisons with a quoted value by =, !=, <> or LIKE."""
    at = r"""([\p{L}_][\p{L}\p{N}_.]*)\s*(?:=|!=|<>|(?i:\bLIKE\b))\s*(?:'([^']*)'|"([^"]*)")"""
    column = F.regexp_extract_all(_c(sql), F.lit(at), F.lit(1))
    one, two = F.regexp_extract_all(_c(sql), F.lit(at), F.lit(2)), F.regexp_extract_all(_c(sql), F.lit(at), F.lit(3))
    return F.transform(F.arrays_zip(column.alias("c"), one.alias("a"), two.alias("b")), lambda x: F.struct(F.element_at(F.split(x["c"], r"\."), -1).alias("column"), F.when(x["a"] != "", x["a"]).otherwise(x["b"]).alias("literal")))


# --- cleaning of generated text --------------------------------------------------------------------------------------


def strip_fence(sql: Column | str) -> Column:
    """The first fenced block, if there is one."""
    fenced = F.regexp_extract(_c(sql), r"(?is)```(?:sql)?\s*(.*?)\s*```", 1)
    return F.trim(F.when(fenced != "", fenced).otherwise(_c(sql)))


_LOOP = r"(?i)(\band\s+[\p{L}\p{N}_.]+\s+in\s*\(\s*select\b)"


def cut_repetition(sql: Column | str) -> Column:
    """Three or more ``and x in (select``: cut before the second and close what is open."""
    parts = F.split(_c(sql), _LOOP)
    first = F.concat(F.get(parts, F.lit(0)), F.regexp_extract(_c(sql), _LOOP, 1), F.get(parts, F.lit(1)))
    head = F.rtrim(first)
    opened = F.regexp_count(head, F.lit(r"\(")) - F.regexp_count(head, F.lit(r"\)"))
    return F.when(F.regexp_count(_c(sql), F.lit(_LOOP)) >= 3, F.concat(head, F.repeat(F.lit(")"), F.greatest(opened, F.lit(0))))).otherwise(_c(sql))


def double_quotes(sql: Column | str) -> Column:
    """Single-quoted strings in double quotes, as generated SQL is compared; not for what Spark executes."""
    return F.regexp_replace(_c(sql), "'([^']*)'", '"$1"')


#: Words that are never values.
NOT_VALUES = (*(k.lower() for k in KEYWORDS), "true", "false")


def quote_bare_values(sql: Column | str, columns: tuple[str, ...] = ()) -> Column:
    """A bare word right after a comparison that ends its condition is a string; names in ``columns`` and keywords are not."""
    skip = "|".join(re.escape(x) for x in (*NOT_VALUES, *columns))
    bare = rf"(?i)([=!<>]\s*)(?!(?:{skip})(?![\p{{L}}\p{{N}}_]))([\p{{L}}][\p{{L}}\p{{N}}_]*)(?![\p{{L}}\p{{N}}_.(])(?=\s*(?:\)|$)|\s+(?:and|or|order|group|having|limit|union)\b)"
    return _outside_strings(_c(sql), lambda p: F.regexp_replace(p, bare, '$1"$2"'))


def space_commas(sql: Column | str) -> Column:
    return _outside_strings(_c(sql), lambda p: F.regexp_replace(p, r"\s*,\s*", " , "))


def collapse_blanks(sql: Column | str) -> Column:
    return F.trim(_outside_strings(_c(sql), lambda p: F.regexp_replace(p, r"\s+", " ")))


def post_process(sql: Column | str, columns: tuple[str, ...] = ()) -> Column:
    """The chain that every generated statement takes."""
    out = cut_repetition(strip_fence(F.trim(_c(sql))))
    return collapse_blanks(space_commas(quote_bare_values(double_quotes(out), columns)))


def executable(sql: Column | str, columns: tuple[str, ...] = ()) -> Column:
    """The chain for a statement that is to run: as ``post_process``, but string literals keep their quotes and all they hold."""
    return collapse_blanks(space_commas(quote_bare_values(cut_repetition(strip_fence(F.trim(_c(sql)))), columns)))


def clean_generated(raw: str) -> str:
    """A generator's answer as one statement: fence and all after the first semicolon go, ``select select`` is one, and
    what starts with neither SELECT nor WITH gets a SELECT.  String quotes stay."""
    fenced = re.search(r"```(?:sql)?\s*(.*?)\s*```", raw, re.DOTALL | re.IGNORECASE)
    text = (fenced.group(1) if fenced else raw).strip()
    text = re.split(r";(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)", text, maxsplit=1)[0]
    text = re.sub(rf"({_STRING})|`|\s+", lambda m: m.group(1) or ("" if m.group() == "`" else " "), text).strip()
    text = re.sub(r"(?i)^(?:select\s+)+(?=select\b)", "", text)
    return text if re.match(r"(?i)(select|with)\b", text) else f"SELECT {text}"


def truncate_schema(text: Column | str, most: int = 4000) -> Column:
    """A schema's text cut to ``most`` characters, with a mark."""
    return F.when(F.length(_c(text)) > most, F.concat(F.substring(_c(text), 1, most), F.lit("\n-- (cut)"))).otherwise(_c(text))


def content_hash(texts: Column | str, model: str = "") -> Column:
    """SHA-256 of an array of texts, with separators, and of the model they were embedded by."""
    return F.sha2(F.concat_ws("\x1f", F.lit(model), _c(texts)), 256)


def cell_text(value: Column | str, kind: str) -> Column:
    """A result cell as the comparison of results sees it: trimmed lower case; null is ``none``, a whole double ends in .0."""
    v = _c(value)
    if kind in ("double", "float"):
        text = F.when((v == F.floor(v)) & (F.abs(v) < 1e16), F.concat(v.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(F.regexp_replace(F.lower(v.cast("string")), r"^(-?\d)\.0e(\d+)$", "$1e+$2"))
    elif kind == "boolean":
        text = F.when(v, "1").otherwise("0")
    else:
        text = v.cast("string")
    return F.lower(F.trim(F.coalesce(text, F.lit("None"))))
