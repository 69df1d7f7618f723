"""Joins, unions and id checks.

Row alignment is always a join on the id column; row order is never relied on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class UnknownIdError(ValueError):
    pass


def left_join_feature(df: DataFrame, feature: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left equi-join of a derived feature table on the id."""
    return df.join(feature, on, "left")


def inner_join_ids(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Restrict rows to ids present in ``ids`` (semi join: no columns, no duplicates added)."""
    return df.join(ids, on, "left_semi")


def align_lookup(model_rows: DataFrame, raw: DataFrame, on: str, check: bool = True) -> DataFrame:
    """For each id of the model table fetch the raw row; an unknown id is an error.

    The check is one anti-join count; the result is a left join (model rows
    keep their multiplicity).
    """
    if check:
        missing = model_rows.select(on).join(raw.select(on), on, "left_anti").limit(1).count()
        if missing:
            raise UnknownIdError(f"ids of the model table are missing from the raw table ({on})")
    return model_rows.join(raw, on, "left")


def label_lookup(names: DataFrame, dictionary_first: DataFrame, name_col: str = "variavel") -> DataFrame:
    """Variable -> description, falling back to the name itself (dictionary keyed by lower name ``_k``)."""
    j = names.join(dictionary_first.select("_k", "descricao"), F.lower(F.col(name_col)) == F.col("_k"), "left")
    return j.select(*names.columns, F.coalesce("descricao", F.col(name_col)).alias("label"))


def union_rows(*dfs: DataFrame) -> DataFrame:
    """Concatenate datasets by column name, no de-duplication."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def concat_columns(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Column-wise concatenation = equi-join on the id (1:1)."""
    return left.join(right, on, "inner")


def union_ids(*ids: DataFrame) -> DataFrame:
    """Set union of id columns (one column each)."""
    out = ids[0]
    for d in ids[1:]:
        out = out.union(d)
    return out.distinct()


def id_overlap(train: DataFrame, test: DataFrame, on: str) -> DataFrame:
    """(n_train, n_test, n_overlap): train and test ids must not intersect."""
    tagged = train.select(on, F.lit(1).alias("_tr"), F.lit(0).alias("_te")).unionByName(
        test.select(on, F.lit(0).alias("_tr"), F.lit(1).alias("_te")))
    per_id = tagged.groupBy(on).agg(F.max("_tr").alias("a"), F.max("_te").alias("b"))
    return per_id.agg(
        F.sum("a").cast("long").alias("n_train_ids"),
        F.sum("b").cast("long").alias("n_test_ids"),
        F.sum(F.col("a") * F.col("b")).cast("long").alias("n_overlap"),
    )


def column_set_difference(present: DataFrame, kept: DataFrame, col: str) -> DataFrame:
    """Names present but not kept (set difference on a name table)."""
    return present.select(col).subtract(kept.select(col))
