"""Harvest as a stream: texts that land are read once, over any number of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from jobloom.plans.discovery import candidates


def harvest_stream(
    texts: DataFrame, origin: str, order: str, out: str, checkpoint: str
) -> StreamingQuery:
    """Candidates of a streaming table of texts, appended to ``out``.

    Extraction is stateless; the checkpoint is the ledger of what has been read.
    """
    return (
        candidates(texts, origin, order)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
