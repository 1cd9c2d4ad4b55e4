"""Percentile sketches kept up to date from a stream.

Sketches of separate batches add up to that of the whole, so a stream only has to append them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from colonnade.llm import sketch


def append_sketches(stream: DataFrame, keys: Sequence[str], columns: Sequence[str], folder: str, checkpoint: str, error: float = sketch.ERROR) -> StreamingQuery:
    """Appends the sketch of every batch under ``folder``, in a folder of the batch's own: a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        sketch.sketch(batch, keys, columns, error).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
