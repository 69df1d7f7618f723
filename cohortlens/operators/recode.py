"""Scalar recoding and feature construction.

Everything here is a native column expression (no Python UDF).  Operators
that need a fitted value (category lists, medians) compute it with one small
job and apply it as literals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.expr import all_null_guard, eq_flag, in_flag, not_contains_flag_expr
from cohortlens.operators.ranking import ordered_positions, quantile_dict

#: More categories than this are one sparse vector column instead of a column each.
MAX_ONE_HOT_CATEGORIES = 1000


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def categories(df: DataFrame, col: str, limit: int = MAX_ONE_HOT_CATEGORIES) -> list | None:
    """Sorted distinct non-missing values; None instead of collecting more than ``limit``."""
    vals = [r[0] for r in df.where(_q(col).isNotNull()).select(_q(col)).distinct().limit(limit + 1).collect()]
    return None if len(vals) > limit else sorted(vals)


def one_hot(df: DataFrame, col: str, cats: Sequence, prefix: str | None = None, drop_source: bool = True) -> DataFrame:
    """One 0/1 int column per listed category (``prefix_value``); missing -> all zeros."""
    prefix = prefix or col
    new = {f"{prefix}_{v}": eq_flag(_q(col), v) for v in cats}
    out = df.withColumns(new)
    return out.drop(col) if drop_source else out


def one_hot_full(df: DataFrame, col: str, prefix: str | None = None, limit: int = MAX_ONE_HOT_CATEGORIES) -> DataFrame:
    """A 0/1 column for every category; above ``limit`` categories one sparse vector (``one_hot_sparse``)."""
    cats = categories(df, col, limit)
    return one_hot_sparse(df, col, prefix) if cats is None else one_hot(df, col, cats, prefix)


def one_hot_drop_first(df: DataFrame, col: str, prefix: str | None = None, limit: int = MAX_ONE_HOT_CATEGORIES) -> DataFrame:
    """``one_hot_full`` without the first category: its rows are all zeros, like those without a value."""
    cats = categories(df, col, limit)
    return one_hot_sparse(df, col, prefix, drop_first=True) if cats is None else one_hot(df, col, cats[1:], prefix)


def category_positions(df: DataFrame, col: str) -> DataFrame:
    """(col, ``position``): every non-missing value with its 0-based place in sort order; no category reaches the driver."""
    values = df.where(_q(col).isNotNull()).select(_q(col)).distinct()
    return ordered_positions(values, f"`{col}`").withColumnRenamed("_pos", "position")


def one_hot_positions(df: DataFrame, col: str) -> DataFrame:
    """``df`` with ``position``, the place of its one non-zero entry (NULL for a missing value).

    The dictionary is joined, whatever its size; the join planner broadcasts a small one
    and splits hot categories of a large one.
    """
    return df.join(category_positions(df, col), col, "left")


def one_hot_sparse(df: DataFrame, col: str, prefix: str | None = None, drop_first: bool = False, drop_source: bool = True) -> DataFrame:
    """One sparse vector column ``<prefix>_onehot`` as wide as there are categories, in sort order.

    A missing value (and with ``drop_first`` the first category, which then has no place) is the
    zero vector.  An empty column gives vectors of width 1.
    """
    dictionary = category_positions(df, col)
    size = dictionary.count() - int(drop_first)
    place = F.col("position") - int(drop_first)
    # MLlib's encoder drops the last index: that of the rows without an entry
    index = F.when(place >= 0, place).otherwise(F.lit(max(1, size))).cast("double")
    marked = df.join(dictionary, col, "left").withColumn("_index", index)
    marked = marked.withMetadata("_index", {"ml_attr": {"type": "nominal", "num_vals": max(1, size) + 1}})
    encoder = OneHotEncoder(inputCol="_index", outputCol=f"{prefix or col}_onehot", dropLast=True)
    out = encoder.fit(marked).transform(marked).drop("_index", "position")
    return out.drop(col) if drop_source else out


def fit_one_hot_capped(train: DataFrame, col: str, max_categories: int = 20) -> dict:
    """Learn the kept categories on training rows.

    With more than ``max_categories`` categories, the ``max_categories - 1``
    most frequent are kept (equal counts: the later value in sort order wins)
    and the others are pooled into one infrequent column.
    """
    counts = train.where(_q(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    n_cats = counts.count()
    if n_cats <= max_categories:
        kept = categories(train, col, max_categories)
        return {"col": col, "kept": kept, "infrequent": []}
    ranked = counts.orderBy(F.desc("n"), F.desc(col)).limit(max_categories - 1).collect()
    kept = sorted(r[col] for r in ranked[: max_categories - 1])
    infrequent = counts.where(~_q(col).isin(kept)).select(col)
    return {"col": col, "kept": kept, "infrequent": infrequent}


def apply_one_hot_capped(df: DataFrame, fitted: dict, prefix: str | None = None) -> DataFrame:
    """Kept categories as columns, seen-but-infrequent as ``prefix_infrequent``; unseen -> zeros."""
    col = fitted["col"]
    prefix = prefix or col
    out = one_hot(df, col, fitted["kept"], prefix, drop_source=False)
    inf = fitted["infrequent"]
    if isinstance(inf, DataFrame):
        tag = inf.select(_q(col).alias("_inf_v")).distinct().withColumn("_inf", F.lit(1))
        out = out.join(tag, out[col] == tag["_inf_v"], "left").drop("_inf_v")
        out = out.withColumn(f"{prefix}_infrequent", F.coalesce("_inf", F.lit(0))).drop("_inf")
    return out.drop(col)


def merge_categories(df: DataFrame, col: str, rare: Sequence[str], into: str = "Outros") -> DataFrame:
    """Map the listed categories to one pooled label."""
    return df.withColumn(col, F.when(_q(col).isin(list(rare)), F.lit(into)).otherwise(_q(col)))


def rare_categories(df: DataFrame, col: str, threshold: float = 0.01) -> DataFrame:
    """Categories whose share of all rows is below ``threshold``: (category, n, share)."""
    total = df.count()
    counts = df.where(_q(col).isNotNull()).groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.lit(float(total))
    return counts.where(share < threshold).select("category", "n", F.round(share, 6).alias("share"))


def equality_flag(df: DataFrame, col: str, value, out: str) -> DataFrame:
    """1 if equal to value else 0; missing -> 0."""
    return df.withColumn(out, eq_flag(_q(col), value))


def membership_flag(df: DataFrame, col: str, values: Sequence, out: str) -> DataFrame:
    """1 if in the set else 0; missing -> 0."""
    return df.withColumn(out, in_flag(_q(col), values))


def not_contains_flag(df: DataFrame, col: str, needle: str, out: str, missing_as: int = 1) -> DataFrame:
    """1 if the substring is absent; missing -> ``missing_as`` (1, as the reference does)."""
    return df.withColumn(out, not_contains_flag_expr(_q(col), needle, missing_as))


def recode_map(df: DataFrame, col: str, mapping: Mapping, out: str | None = None) -> DataFrame:
    """Value map (e.g. Sim -> 1, Nao -> 0); unmapped and missing -> NULL."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out or col, m[_q(col)])


def ordinal_rules(df: DataFrame, col: str, rules: Sequence[tuple[str, int]], out: str | None = None) -> DataFrame:
    """First matching substring rule on lower(trim(text)) gives the code; else NULL."""
    t = F.lower(F.trim(_q(col)))
    expr = None
    for pat, code in rules:
        cond = t.contains(pat.lower())
        expr = F.when(cond, F.lit(code)) if expr is None else expr.when(cond, F.lit(code))
    return df.withColumn(out or col, expr if expr is not None else F.lit(None).cast("int"))


def unmapped_report(df: DataFrame, source_col: str, mapped_col: str) -> DataFrame:
    """Source values that the mapping left NULL, with counts."""
    return (df.where(_q(mapped_col).isNull() & _q(source_col).isNotNull())
            .groupBy(F.col(source_col).alias("value")).agg(F.count(F.lit(1)).alias("n")))


def derived_difference(df: DataFrame, a: str, b: str, out: str, a_fill: float | None = None) -> DataFrame:
    """a - b after filling missing a (by its median unless ``a_fill`` is given)."""
    if a_fill is None:
        a_fill = quantile_dict(df, [a], [0.5])[(a, 0.5)]
    return df.withColumn(out, F.coalesce(_q(a), F.lit(a_fill)) - _q(b))


def unit_convert(df: DataFrame, value_col: str, unit_col: str, factors: Mapping[str, float],
                 out: str | None = None, unknown_to_null: bool = False) -> DataFrame:
    """Multiply by the factor of the unit (e.g. Dias -> x24); other units unchanged (or NULL)."""
    expr = None
    for unit, f in factors.items():
        cond = _q(unit_col) == unit
        v = _q(value_col) * F.lit(float(f))
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    fallback = F.lit(None).cast("double") if unknown_to_null else _q(value_col)
    return df.withColumn(out or value_col, expr.otherwise(fallback))


def sentinel_median(df: DataFrame, col: str, code: float, valid: Column | None = None) -> float | None:
    """Median of the valid rows: value != code, and ``valid`` when given."""
    keep = (_q(col) != F.lit(code)) & _q(col).isNotNull()
    if valid is not None:
        keep = keep & F.coalesce(valid, F.lit(False))
    return quantile_dict(df.where(keep), [col], [0.5])[(col, 0.5)]


def sentinel_to_median(df: DataFrame, col: str, code: float, valid: Column | None = None,
                       out: str | None = None) -> DataFrame:
    """Replace the sentinel code by the median of valid rows; plain missing stays missing."""
    med = sentinel_median(df, col, code, valid)
    return df.withColumn(out or col, F.when(_q(col) == F.lit(code), F.lit(med)).otherwise(_q(col)))


def range_to_null(df: DataFrame, col: str, lower: float | None = None, upper: float | None = None,
                  lower_inclusive: bool = True, upper_inclusive: bool = True) -> DataFrame:
    """Values outside [lower, upper] become NULL."""
    x = _q(col)
    ok = F.lit(True)
    if lower is not None:
        ok = ok & ((x >= lower) if lower_inclusive else (x > lower))
    if upper is not None:
        ok = ok & ((x <= upper) if upper_inclusive else (x < upper))
    return df.withColumn(col, F.when(ok, x))


def any_of_flags(df: DataFrame, cols: Sequence[str], value: str, out: str) -> DataFrame:
    """1 if any column equals ``value``; NULL if all are missing; else 0."""
    flag = F.greatest(*[eq_flag(_q(c), value) for c in cols])
    return df.withColumn(out, all_null_guard(flag, list(cols)))


def consolidate_measures(df: DataFrame, a: str, b: str, out: str, invalid: float = 0.0) -> DataFrame:
    """Two measurements, ``invalid`` (0) treated as missing: mean if both, else the one, else NULL."""
    x = F.when(_q(a) != invalid, _q(a))
    y = F.when(_q(b) != invalid, _q(b))
    return df.withColumn(out, F.coalesce((x + y) / 2, x, y))


def consolidation_counts(df: DataFrame, a: str, b: str, invalid: float = 0.0) -> DataFrame:
    """Counts: both valid / only first / only second / zeros removed / none."""
    x_ok = _q(a).isNotNull() & (_q(a) != invalid)
    y_ok = _q(b).isNotNull() & (_q(b) != invalid)
    s = lambda c: F.sum(c.cast("long"))
    return df.agg(
        s(x_ok & y_ok).alias("n_both"),
        s(x_ok & ~y_ok).alias("n_only_first"),
        s(~x_ok & y_ok).alias("n_only_second"),
        s(F.coalesce(_q(a) == invalid, F.lit(False)) | F.coalesce(_q(b) == invalid, F.lit(False))).alias("n_zero_removed"),
        s(~x_ok & ~y_ok).alias("n_missing"),
    )


def ratio_feature(df: DataFrame, weight: str, height_cm: str, out: str) -> DataFrame:
    """weight / (height / 100)^2; zero or missing height -> NULL."""
    h = _q(height_cm) / 100.0
    return df.withColumn(out, F.when(h != 0, _q(weight) / (h * h)))


BIN_NAMES = ("desnutrido", "eutrofico", "sobrepeso", "obeso")


def bin_indicators(df: DataFrame, z: str, names: Sequence[str] = BIN_NAMES) -> DataFrame:
    """z-score -> four 0/1 columns: <= -2, (-2, 2], (2, 3], > 3; missing -> all zeros."""
    x = _q(z)
    conds = [x <= -2, (x > -2) & (x <= 2), (x > 2) & (x <= 3), x > 3]
    return df.withColumns({n: F.coalesce(c, F.lit(False)).cast("int") for n, c in zip(names, conds)})


def threshold_label(df: DataFrame, z: str, threshold: float = 3.0, out: str = "label") -> DataFrame:
    """label = 1 if z > threshold; missing -> 0."""
    return df.withColumn(out, F.coalesce(_q(z) > threshold, F.lit(False)).cast("int"))


def indicators_to_class(df: DataFrame, names: Sequence[str] = BIN_NAMES, out: str = "classe") -> DataFrame:
    """sum_i i * indicator_i -> class code."""
    return df.withColumn(out, sum(F.lit(i) * _q(n) for i, n in enumerate(names)).cast("int"))


def class_to_indicators(df: DataFrame, class_col: str, names: Sequence[str] = BIN_NAMES) -> DataFrame:
    """Class code -> indicator columns."""
    return df.withColumns({n: (_q(class_col) == i).cast("int") for i, n in enumerate(names)})


def group_aggregate_features(df: DataFrame, pairs: Mapping[str, Sequence[str]] = (),
                             negations: Mapping[str, str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """(a + b) clipped to 0/1 for each pair group, 1 - a for negations, then drop the group."""
    new = {}
    for out, cols in dict(pairs).items():
        new[out] = F.least(sum(_q(c) for c in cols), F.lit(1))
    for out, c in dict(negations).items():
        new[out] = F.lit(1) - _q(c)
    return df.withColumns(new).drop(*drop)


def ci_bracket(col: Column) -> Column:
    """Rewrite '(lo-hi)' as '[lo-hi]'."""
    return F.regexp_replace(F.regexp_replace(col, r"\(", "["), r"\)", "]")


def ci_string(mean: Column, lo: Column, hi: Column, digits: int = 3) -> Column:
    """'m [lo-hi]' with ``digits`` decimals."""
    f = f"%.{digits}f"
    return F.format_string(f"{f} [{f}-{f}]", mean, lo, hi)
