"""Scans, sinks, the variable dictionary and the results table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cohortlens.session import fresh_path


# ---------------------------------------------------------------- scans
def csv_scan(spark: SparkSession, path: str, schema: StructType | str | None = None,
             infer: bool = False) -> DataFrame:
    """Read CSV with a header.  Pass the schema; inference is a one-off tool (it scans the file)."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def csv_scan_projected(spark: SparkSession, path: str, schema: StructType | str, cols: Sequence[str]) -> DataFrame:
    """Read only the named columns; the CSV reader prunes the rest at parse time."""
    return csv_scan(spark, path, schema).select(*cols)


def dictionary_scan(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Variable dictionary (variavel, descricao, bloco, ordem) as a lookup table."""
    schema = "variavel string, descricao string, bloco string, ordem long"
    if fmt == "csv":
        return csv_scan(spark, path, schema)
    return spark.read.parquet(path).select("variavel", "descricao", "bloco", "ordem")


# ---------------------------------------------------------------- sinks
def csv_sink(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write a dataset.  Never overwrite a path the same plan reads from: use a new path."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def write_then_read(spark: SparkSession, df: DataFrame, name: str, fmt: str = "parquet",
                    schema: StructType | str | None = None) -> DataFrame:
    """Materialise ``df`` under the shared work folder and read it back (cuts lineage)."""
    path = csv_sink(df, fresh_path(spark, name), fmt)
    if fmt == "csv":
        return csv_scan(spark, path, schema if schema is not None else df.schema)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- results table
RESULT_KEYS = ("model", "algorithm")


def result_upsert(df: DataFrame, path: str, keys: Sequence[str] = RESULT_KEYS) -> None:
    """Persist result rows; rows of a (model, algorithm) already stored are replaced.

    The table is partitioned by the keys and written with dynamic partition
    overwrite, so only the partitions present in ``df`` are rewritten.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def resume_skip_done(jobs: DataFrame, done: DataFrame, keys: Sequence[str] = RESULT_KEYS) -> DataFrame:
    """Jobs not yet recorded in the results table (anti join on the keys)."""
    return jobs.join(done.select(*keys).distinct(), list(keys), "left_anti")


# ---------------------------------------------------------------- step report
def step_report(spark: SparkSession, step: str, before: Sequence[str], after: Sequence[str]) -> DataFrame:
    """Before/after report rows (step, kind, ordinal, column_name): dropped list and numbered kept list."""
    after_set = set(after)
    rows = [(step, "dropped", i + 1, c) for i, c in enumerate([c for c in before if c not in after_set])]
    rows += [(step, "kept", i + 1, c) for i, c in enumerate(after)]
    rows += [(step, "n_before", len(before), None), (step, "n_after", len(after), None)]
    return spark.createDataFrame(rows, "step string, kind string, ordinal int, column_name string")
