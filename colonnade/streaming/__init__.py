"""Operators over a stream, batch by batch.

Columns are sealed before they are queried, so an operator sees a batch as a frame of its own; results that add up, such as
counts or partial summaries, are combined when they are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_batches(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Appends what ``operator`` makes of every batch under ``folder``, in a folder of the batch's own: a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
