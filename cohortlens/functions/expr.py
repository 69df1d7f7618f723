"""Column-expression helpers with explicit missing-value rules.

pandas comparisons with a missing value are False; Spark's are NULL.  Every
flag helper here states its missing rule and returns an IntegerType 0/1.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c, digits: int = 2) -> Column:
    """NumPy-style rounding: ``rint(x * 10**d) / 10**d`` (Spark ``round`` is half-up)."""
    scale = float(10**digits)
    return F.rint(_c(c) * F.lit(scale)) / F.lit(scale)


def eq_flag(c, value) -> Column:
    """1 if equal to value else 0; missing gives 0."""
    return F.coalesce(_c(c) == F.lit(value), F.lit(False)).cast("int")


def in_flag(c, values: Iterable) -> Column:
    """1 if in the set else 0; missing gives 0."""
    return F.coalesce(_c(c).isin(list(values)), F.lit(False)).cast("int")


def not_contains_flag_expr(c, needle: str, missing_as: int = 1) -> Column:
    """1 if the substring is absent; missing gives ``missing_as`` (1 by default)."""
    c = _c(c)
    return F.when(c.isNull(), F.lit(missing_as)).otherwise((~c.contains(needle)).cast("int"))


def all_null_guard(flag: Column, cols: list) -> Column:
    """NULL when every source column is missing, else ``flag``."""
    return F.when(F.coalesce(*[_c(c) for c in cols]).isNotNull(), flag)
