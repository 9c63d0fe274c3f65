"""Session helpers: a builder with the engine's settings, and shipping of the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def build_session(app: str = "askframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow transfer; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false"}
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Rows and bytes of an Arrow batch, where the session leaves Spark's own values: whole texts may be long, and an executor holds
#: a batch of each running task several times over.
_BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20), str(8 << 20)))


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once for each application, where it is not installed there, and bound the
    batches that go to Python workers."""
    for key, usual, ours in _BATCHES:
        if spark.conf.get(key, None) in (None, usual):
            spark.conf.set(key, ours)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(prefix=f"{root.name}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, a temporary one serves a local
    master; on a cluster that is an error, since a machine's own folder is no shared one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="askframe-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def settle(df: DataFrame) -> DataFrame:
    """Cut a lineage: a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
