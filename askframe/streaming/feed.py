"""Linking questions as they arrive: Structured Streaming, a micro-batch at a time.

An extension: nothing in the query surface needs it.  Each batch is linked by the batch operators and written under its
number, so that a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.linking import link
from ..sources.catalog import Catalog


def link_feed(questions: DataFrame, catalog: Catalog, to: str, checkpoint: str, values: DataFrame | None = None, semantic: bool = False, once: bool = False) -> StreamingQuery:
    """Start a stream that writes the links of streamed questions (question_id, db_id, question) to ``to``/batch=<number>."""

    def write(batch: DataFrame, number: int) -> None:
        link(batch, catalog, values, semantic).write.mode("overwrite").parquet(f"{to}/batch={number}")

    writer = questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
