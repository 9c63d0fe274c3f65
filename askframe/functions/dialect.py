"""From generated SQL to what Spark runs: only queries, identifiers in backticks, and the differences in meaning."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|[^\W\d]\w*|\d+(?:\.\d+)?|\s+|.", re.DOTALL)
_CHANGES = re.compile(r"(?i)\b(insert|update|delete|create|drop|alter|merge|truncate|replace|attach|pragma|set|use)\b")


class NotAQuery(ValueError):
    """The statement is something else than one query."""


def tokens(sql: str) -> list[str]:
    """Strings, comments, words, numbers, blanks and single characters; they join to the statement again."""
    return _TOKEN.findall(sql)


def guard(sql: str) -> str:
    """The statement without its last semicolon, if it is a single query; NotAQuery otherwise."""
    text = re.sub(r"[;\s]+$", "", sql.strip())
    code = " ".join(t for t in tokens(text) if t[0] not in "'\"`" and not t.startswith("--"))
    if ";" in code or not re.match(r"(?i)\s*(\(\s*)*(select|with|values)\b", code) or _CHANGES.match(code.lstrip("( ")):
        raise NotAQuery(text[:80])
    return text


def quote_identifiers(sql: str, names: list[str]) -> str:
    """Names of the catalog that are no plain identifiers (blanks, letters beyond ASCII) in backticks, the longest first, outside
    of strings.  A dotted prefix stays as it is."""
    odd = sorted({n for n in names if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", n)}, key=len, reverse=True)
    if not odd:
        return sql
    name = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, odd)) + r")(?!\w)", re.IGNORECASE)
    out, code = [], ""
    for t in [*tokens(sql), ""]:
        if t and t[0] not in "'\"`" and not t.startswith("--"):
            code += t
        else:
            out += [name.sub(r"`\1`", code), t]
            code = ""
    return "".join(out)


def _strings(sql: str, columns: frozenset[str]) -> str:
    """Double-quoted text is a string unless it names a column, then an identifier, as in SQLite."""
    out = []
    for t in tokens(sql):
        if t[0] == '"' and len(t) > 1:
            body = t[1:-1]
            out.append(f"`{body}`" if body.lower() in columns else "'" + body.replace("'", "''") + "'")
        else:
            out.append(t)
    return "".join(out)


def to_spark(sql: str, names: list[str], columns: list[str] | None = None) -> str:
    """A guarded statement in Spark's dialect: strings, identifiers, and LIKE that ignores case."""
    known = frozenset(c.lower() for c in (columns if columns is not None else names))
    text = quote_identifiers(_strings(guard(sql), known), names)
    return "".join("ILIKE" if t.upper() == "LIKE" else t for t in tokens(text))


def left_associative(parts: list[str], operators: list[str]) -> str:
    """Set operations in the order they are written: INTERSECT binds no tighter than UNION there."""
    out = parts[0]
    for op, p in zip(operators, parts[1:], strict=True):
        out = f"SELECT * FROM ({out}) {op} SELECT * FROM ({p})"
    return out


def loosen_grouping(sql: str, bare: list[str]) -> str:
    """Columns that are neither grouped nor aggregated, as any value of their group."""
    def change(m: re.Match) -> str:
        items = re.sub(r"(?<![\w.(])(" + "|".join(map(re.escape, sorted(bare, key=len, reverse=True))) + r")(?![\w.(])", r"any_value(\1)", m.group(2))
        return m.group(1) + items + m.group(3)

    return re.sub(r"(?is)^(\s*select\s+(?:distinct\s+)?)(.*?)(\s+from\b)", change, sql, count=1)
