"""Helpers shared by the training-data operators: tables, written intermediates, positions."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.session import fresh_path

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_RANGE = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and kept when an executor is lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Lets an operator that returns its input's columns take extra columns of any names.

    While it runs, columns that no ``..._col`` argument names are called ``kept_column_<i>``.
    """
    signature = inspect.signature(operator)

    @wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        bound = signature.bind(docs, *args, **options)
        bound.apply_defaults()
        given = bound.arguments | bound.arguments.get("options", {})
        used = {v.lower() for k, v in given.items() if k.endswith("_col")}
        names = {c if c.lower() in used else f"kept_column_{i}": c for i, c in enumerate(docs.columns)}
        out = operator(docs.toDF(*names), *args, **options)
        return out.toDF(*[names.get(c, c) for c in out.columns])

    return run


def parts_for(rows: int, per_part: int = ROWS_PER_RANGE) -> int:
    """Partitions that hold about ``per_part`` rows each."""
    return max(1, math.ceil(rows / per_part))


def positions(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), out: str = "position",
              per_part: int = ROWS_PER_RANGE) -> DataFrame:
    """Add the 1-based position of each row in ``order`` order, counted anew in each ``by`` group.

    ``df`` should be a written table (it is read more than once); ``by`` columns
    must not be null. A range exchange cuts every group, however large, into
    runs of about ``per_part`` rows; a table with one row for each (run, group)
    gives where each run starts.
    """
    cols = [F.col(c) for c in (*by, *order)]
    runs = written(df.repartitionByRange(parts_for(df.count(), per_part), *cols)
                   .withColumn("_run", F.spark_partition_id()), "runs")
    before = Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (runs.groupBy("_run", *by).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = Window.partitionBy("_run", *by).orderBy(*order)
    return (runs.withColumn("_k", F.row_number().over(inside)).join(starts, ["_run", *by])
            .withColumn(out, F.col("_k") + F.col("_start")).drop("_k", "_start", "_run"))
