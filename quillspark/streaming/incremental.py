"""Keeping an index fresh from a stream of document rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import Index


def apply_batch(index: Index, rows: DataFrame) -> None:
    """Upserts ``rows`` (collection, path, title, body, modified_at) and merges segments when there are many.

    Applying a batch again changes nothing, so a restarted stream is safe.
    """
    index.upsert(rows)
    index.tidy()


def follow(index: Index, stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Starts a query that applies each micro-batch of ``stream`` to ``index``, until what is there has been read."""
    return stream.writeStream.foreachBatch(lambda rows, _: apply_batch(index, rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
