"""Postings of documents that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators.index import postings


def stream_postings(documents: DataFrame, path: str, checkpoint: str, tf: str = "count") -> StreamingQuery:
    """Appends the postings of each micro-batch of ``documents (doc_id, text)`` as a Parquet partition of ``path``. A batch
    that is run again after a failure overwrites its own partition, so postings are written once."""

    def write(batch: DataFrame, number: int) -> None:
        postings(batch, tf=tf).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
