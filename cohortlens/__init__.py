"""cohortlens: survey-table analytics and risk modelling as Spark DataFrame operators.

Layout
------
sources/     scans, sinks, dictionary, results table, derived test fixtures
functions/   column-expression helpers (portable hash, null-safe flags, rounding)
operators/   DataFrame -> DataFrame operators (selection, recoding, imputation,
             joins, profiling, ranking, resampling, metrics)
plans/       learners and model workflows composed from the operators, plus the
             registry of named queries used by ``__spark_entry__``
streaming/   incremental results sink (``foreachBatch`` upsert)
"""

__version__ = "0.1.0"
