"""Incremental results table: each micro-batch upserts its (model, algorithm) partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cohortlens.sources.io import RESULT_KEYS, result_upsert


def upsert_batch(path: str, keys: Sequence[str] = RESULT_KEYS):
    """A ``foreachBatch`` function: dynamic-partition overwrite of the batch's keys.

    Re-running a batch after a failure rewrites the same partitions with the
    same rows, so the sink is idempotent per (model, algorithm).
    """
    def fn(batch: DataFrame, batch_id: int) -> None:
        result_upsert(batch, path, keys)
    return fn


def start_results_upsert(stream: DataFrame, path: str, checkpoint: str,
                         keys: Sequence[str] = RESULT_KEYS, available_now: bool = True) -> StreamingQuery:
    """Start a stream of result rows into the results table at ``path``."""
    w = stream.writeStream.foreachBatch(upsert_batch(path, keys)).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
