"""Continuous insertion: each micro-batch of a stream is one insertion of the batch kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rangevec.plans.index import RangeIndex


def insert_stream(index: RangeIndex, rows: DataFrame, checkpoint: str, path: str | None = None, once: bool = False) -> StreamingQuery:
    """Add a stream of (vec_id, embedding, scalar) to the index; with ``path`` each batch is saved as a version.

    A micro-batch that is delivered again after a failure replaces its rows, so each row is there once.
    """

    def add(batch: DataFrame, _: int) -> None:
        if batch.head(1):
            index.add(batch, replace=True)
            if path:
                index.save(path)

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
