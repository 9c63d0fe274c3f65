"""Repairing statements that fail: replace literals that no row has, then ask the generator again, a few times."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from difflib import SequenceMatcher

from ..functions.dialect import tokens
from .execute import Executor, Result, Status
from .generate import SqlGenerator

SCHEMA_MOST = 4000
_LITERAL = re.compile(r"([^\W\d][\w.]*)\s*(?:=|!=|<>|\blike\b)\s*(?:'((?:[^']|'')*)'|\"([^\"]*)\")", re.IGNORECASE)


@dataclass
class Attempt:
    sql: str
    status: Status
    error: str


@dataclass
class Outcome:
    success: bool
    generated: str  # as the generator wrote it
    executed: str  # as it ran: translated and with literals replaced
    result: Result
    attempts: list[Attempt] = field(default_factory=list)


def literals(sql: str) -> list[tuple[str, str]]:
    """(column, literal) of comparisons with quoted values."""
    return [(m.group(1).rpartition(".")[2], m.group(2) if m.group(2) is not None else m.group(3)) for m in _LITERAL.finditer(sql)]


def nearest_value(literal: str, values: list[str], least: float = 0.6) -> str | None:
    """The stored value that a literal most likely means: equal but for case, else the most similar of at least ``least``."""
    for v in values:
        if v.lower() == literal.lower():
            return v
    scored = sorted(((SequenceMatcher(None, literal.lower(), v.lower()).ratio(), v) for v in values), key=lambda x: (-x[0], x[1]))
    return scored[0][1] if scored and scored[0][0] >= least else None


def replace_literal(sql: str, old: str, new: str) -> str:
    """Replace a string literal wherever it stands as one."""
    return "".join(("'" + new.replace("'", "''") + "'") if t[0] in "'\"" and len(t) > 1 and t[1:-1].replace("''", "'") == old else t for t in tokens(sql))


def choose_value(generator: SqlGenerator, question: str, column: str, literal: str, values: list[str]) -> str | None:
    """The stored value that the generator says a literal means; None if it names none of them."""
    listed = "".join(f"- {v}\n" for v in values)
    asked = f"### Which stored value of {column} does {literal!r} mean? Answer with one line of the list, or NONE.\n-- question: {question}\n{listed}"
    said = generator.raw(asked) if hasattr(generator, "raw") else None
    said = " ".join((said or "").strip().strip("'\"").removeprefix("- ").split())
    return next((v for v in values if v.lower() == said.lower()), None)


def repair_prompt(question: str, schema: str, sql: str, error: str, earlier: list[Attempt], values: str) -> str:
    """What the generator is told about a failure."""
    cut = schema if len(schema) <= SCHEMA_MOST else schema[:SCHEMA_MOST] + "\n-- (cut)"
    past = "".join(f"-- tried before: {a.sql}\n--   {a.error or a.status.value}\n" for a in earlier)
    why = f"-- it failed: {error}\n" if error else "-- it ran, but its result is wrong\n"
    return f"### Correct the SQL query; answer with one query and nothing else.\n-- schema\n{cut}\n{values}{past}-- query: {sql}\n{why}-- question: {question}\nSELECT "


class Repairer:
    """Runs a statement and mends it.  ``values_of(db_id, column)`` gives stored values, ``translate`` maps identifiers."""

    def __init__(self, executor: Executor, generator: SqlGenerator, values_of: Callable[[str, str], list[str]] | None = None, translate: Callable[[str, str], str] | None = None, dump: Callable[[str], str] | None = None, attempts: int = 3, empty_fails: bool = True) -> None:
        self.executor, self.generator, self.attempts, self.empty_fails = executor, generator, attempts, empty_fails
        self.values_of, self.translate, self.dump = values_of, translate, dump

    def _good(self, r: Result) -> bool:
        return r.status is Status.SUCCESS or (r.status is Status.EMPTY and not self.empty_fails)

    def _run(self, sql: str, db_id: str) -> tuple[str, Result]:
        text = sql
        if self.translate:
            try:
                text = self.translate(sql, db_id)
            except (KeyError, ValueError):
                text = sql
        return text, self.executor.execute(text, db_id)

    def _with_stored_values(self, sql: str, db_id: str, question: str) -> str | None:
        """The statement with literals that the column does not hold replaced by the nearest ones it holds, or by those that
        the generator chooses where none is near."""
        out = sql
        for column, literal in literals(sql) if self.values_of else []:
            values = self.values_of(db_id, column)
            if literal not in values:
                best = nearest_value(literal, values)
                if best is None and values:
                    best = choose_value(self.generator, question, column, literal, values)
                out = out if best is None else replace_literal(out, literal, best)
        return out if out != sql else None

    def repair(self, sql: str, db_id: str, question: str, schema: str) -> Outcome:
        history: list[Attempt] = []
        written = sql
        for k in range(self.attempts + 1):
            text, result = self._run(written, db_id)
            if not self._good(result) and result.status is Status.EMPTY and (other := self._with_stored_values(text, db_id, question)):
                again = self.executor.execute(other, db_id)
                if self._good(again):
                    text, result = other, again
            if self._good(result) or k == self.attempts or result.status is Status.DB_NOT_FOUND:
                return Outcome(self._good(result), written, text, result, history)
            history.append(Attempt(written, result.status, result.short_error()))
            written = self.generator.generate(repair_prompt(question, schema, written, result.short_error(), history[:-1], self.dump(db_id) if self.dump else ""))
        raise AssertionError("unreachable")
