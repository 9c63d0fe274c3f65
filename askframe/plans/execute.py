"""Running generated SQL: read-only, with a cap on rows, a timeout that cancels, and a class for each outcome."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from ..functions.dialect import NotAQuery, loosen_grouping, to_spark
from ..sources.tables import register, resolve
from .listing import listing


class Status(Enum):
    SUCCESS = "success"
    SYNTAX_ERROR = "syntax_error"
    RUNTIME_ERROR = "runtime_error"
    TIMEOUT = "timeout"
    EMPTY = "empty"
    DB_NOT_FOUND = "db_not_found"


@dataclass
class Result:
    status: Status
    sql: str
    rows: list[Row] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    truncated: bool = False
    error: str = ""

    @property
    def success(self) -> bool:
        return self.status in (Status.SUCCESS, Status.EMPTY)

    def short_error(self, most: int = 200) -> str:
        """The error in one line."""
        text = {Status.EMPTY: "the query returned no rows", Status.TIMEOUT: "the query took too long", Status.DB_NOT_FOUND: "there is no such database"}.get(self.status, self.error)
        return " ".join(text.split())[:most]


def _describe(e: BaseException) -> str:
    code = e.getCondition() if isinstance(e, PySparkException) else None
    return f"[{code}] {e}" if code and code not in str(e) else str(e)


class Executor:
    """Runs statements over databases below ``root`` (folders of Parquet tables) or given folders."""

    def __init__(self, spark: SparkSession, root: str | None = None, folders: dict[str, str] | None = None, timeout: float = 5.0, most_rows: int = 1000) -> None:
        self.spark, self.root, self.folders = spark, root, dict(folders or {})
        self.timeout, self.most_rows = timeout, most_rows
        self._sessions: dict[str, tuple[SparkSession, list[str], list[str]]] = {}

    def session(self, db_id: str) -> tuple[SparkSession, list[str], list[str]] | None:
        """The database's own session, in which its tables are views, its names and its columns."""
        if db_id not in self._sessions:
            folder = self.folders.get(db_id) or (resolve(self.spark, self.root, db_id) if self.root else None)
            if folder is None:
                return None
            own = self.spark.newSession()
            for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
                own.conf.set(k, self.spark.conf.get(k))
            tables = register(own, folder)
            columns = sorted({c for t in tables for c in own.table(t).columns})
            self._sessions[db_id] = own, [*tables, *columns], columns
        return self._sessions[db_id]

    def frame(self, sql: str, db_id: str) -> DataFrame:
        """The statement as a DataFrame, analysed but not run.  KeyError for an unknown database."""
        got = self.session(db_id)
        if got is None:
            raise KeyError(db_id)
        own, names, columns = got
        text = to_spark(sql, names, columns)
        try:
            out = own.sql(text)
            rows = listing(own, text)
            return out if rows is None else rows.toDF(*out.columns)
        except AnalysisException as e:
            if e.getCondition() and e.getCondition().startswith("MISSING_AGGREGATION"):
                bare = (e.getMessageParameters() or {}).get("expression", "").strip('"').replace("`", "")
                return own.sql(loosen_grouping(text, [bare, bare.rpartition(".")[2]] if "." in bare else [bare]))
            raise

    def validate(self, sql: str, db_id: str) -> tuple[bool, str]:
        """Whether the statement parses and resolves, and why not."""
        try:
            self.frame(sql, db_id).schema  # noqa: B018
        except (NotAQuery, KeyError, PySparkException) as e:
            return False, _describe(e)
        return True, ""

    def timed(self, run: Callable[[], Any], label: str = "") -> tuple[Any, BaseException | None]:
        """What ``run`` gives, or the error that ended it.  After the timeout its Spark jobs are cancelled: a TimeoutError."""
        box: dict = {}
        sc, group = self.spark.sparkContext, f"ask-{uuid.uuid4().hex}"

        def inside() -> None:
            try:
                sc.setJobGroup(group, label[:60], interruptOnCancel=True)
                box["value"] = run()
            except BaseException as e:  # noqa: BLE001
                box["error"] = e

        worker = threading.Thread(target=inside, daemon=True)
        worker.start()
        worker.join(self.timeout)
        if worker.is_alive():
            sc.cancelJobGroup(group)
            worker.join(1.0)
            return None, TimeoutError(label[:60])
        return box.get("value"), box.get("error")

    def execute(self, sql: str, db_id: str) -> Result:
        """Run a statement.  One row more than the cap is fetched, to tell whether there were more."""
        if self.session(db_id) is None:
            return Result(Status.DB_NOT_FOUND, sql)

        def run() -> tuple[list[str], list[Row]]:
            df = self.frame(sql, db_id)
            df = df.toDF(*[f"c{i}" for i in range(len(df.columns))]) if len(set(df.columns)) < len(df.columns) else df
            return df.columns, df.limit(self.most_rows + 1).collect()

        got, e = self.timed(run, sql)
        if isinstance(e, TimeoutError):
            return Result(Status.TIMEOUT, sql)
        if e is not None:
            status = Status.SYNTAX_ERROR if isinstance(e, ParseException | NotAQuery) else Status.RUNTIME_ERROR
            return Result(status, sql, error=_describe(e))
        columns, rows = got
        return Result(Status.SUCCESS if rows else Status.EMPTY, sql, rows[: self.most_rows], columns, len(rows) > self.most_rows)
