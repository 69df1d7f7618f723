"""Streaming entry points.

The reference has no streaming operators (all inputs are finite files).  The one
incremental behaviour it has - persisting each (model, algorithm) result as soon
as it is computed, replacing an earlier entry - is offered here as a
``foreachBatch`` sink over the same partitioned results table as
``sources.io.result_upsert``.
"""

from cohortlens.streaming.results_sink import start_results_upsert, upsert_batch  # noqa: F401
