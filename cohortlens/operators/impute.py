"""Imputation and scaling as fit -> apply pairs.

``fit_*`` returns a small dict of fitted values (one job, report-sized
result); ``apply_*`` adds them as literals.  Fitting on the training rows and
applying to all rows keeps validation rows out of the fit.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import ranking
from cohortlens.operators.ranking import quantile_dict, unpivot
from cohortlens.session import fresh_path


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def constant_impute(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    """Missing -> constant (0)."""
    return df.fillna(value, subset=list(cols))


def fit_median(df: DataFrame, cols: Sequence[str]) -> dict:
    """Exact interpolated medians of the columns (distributed, see ranking.exact_quantiles)."""
    q = quantile_dict(df, cols, [0.5])
    return {c: q[(c, 0.5)] for c in cols}


def apply_fill(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(_q(c), F.lit(v)) for c, v in fills.items() if v is not None})


def median_impute(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing -> column median (interpolated, exact)."""
    return apply_fill(df, fit_median(df, cols))


def fit_mode(df: DataFrame, cols: Sequence[str], missing_label: str = "missing") -> dict:
    """Most frequent non-missing value per column (ties: smallest); all-missing -> ``missing_label``.

    One shuffle per value type: unpivot, count (feature, value), then
    min(struct(-count, value)) per feature; no window over a whole column.
    """
    out = {c: missing_label for c in cols}
    by_type: dict[str, list[str]] = {}
    for c in cols:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for t, group in by_type.items():
        long = unpivot(df, group, value_type=t).where(F.col("value").isNotNull())
        counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("feature").agg(
            F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))).alias("b")
        ).select("feature", "b.v").collect()
        for r in best:
            out[r["feature"]] = r["v"]
    return out


def fold_modes(df: DataFrame, cols: Sequence[str], fold_col: str, folds: Sequence[int], missing_label: str = "missing") -> dict[int, dict]:
    """``fit_mode`` of every fold's training part (the rows of all other folds), from one count by value and fold.

    A training part's count of a value is the total less the fold's.
    """
    folds = [int(k) for k in folds]
    out = {k: {c: missing_label for c in cols} for k in folds}
    by_type: dict[str, list[str]] = {}
    for c in cols:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    own = df.where(F.col(fold_col).isNotNull()).withColumn("_fold", F.col(fold_col))
    for t, group in by_type.items():
        long = unpivot(own, group, ["_fold"], value_type=t).where(F.col("value").isNotNull())
        counts = long.groupBy("feature", "value").agg(*[F.count(F.when(F.col("_fold") != k, 1)).alias(f"n{i}") for i, k in enumerate(folds)])
        best = counts.groupBy("feature").agg(*[F.min(F.when(F.col(f"n{i}") > 0, F.struct((-F.col(f"n{i}")).alias("k"), F.col("value").alias("v")))).alias(f"b{i}")
                                               for i in range(len(folds))]).collect()
        for r in best:
            for i, k in enumerate(folds):
                if r[f"b{i}"] is not None:
                    out[k][r["feature"]] = r[f"b{i}"]["v"]
    return out


def mode_impute(df: DataFrame, cols: Sequence[str], missing_label: str = "missing") -> DataFrame:
    return apply_fill(df, fit_mode(df, cols, missing_label))


def fit_impute(train: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str]) -> dict:
    """Learn medians (numeric) and modes (categorical) on the training rows."""
    fills = {}
    if num_cols:
        fills.update(fit_median(train, num_cols))
    if cat_cols:
        fills.update(fit_mode(train, cat_cols))
    return fills


def fit_transform_impute(train: DataFrame, target: DataFrame, num_cols: Sequence[str],
                         cat_cols: Sequence[str] = ()) -> DataFrame:
    """Fit on ``train``, apply to ``target`` (validation or all rows)."""
    return apply_fill(target, fit_impute(train, num_cols, cat_cols))


def cross_impute(df: DataFrame, fold_col: str, folds: Sequence[int], num_cols: Sequence[str], cat_cols: Sequence[str] = ()) -> DataFrame:
    """Every row once, missing values filled by a fit on the rows of all other folds: one scan applies all folds' fills.

    The rows are written once to the shared folder, where all fits and the result read them.
    """
    path = fresh_path(df.sparkSession, "folds")
    df.write.parquet(path)
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    medians = fold_fits(df, num_cols, num_cols, fold_col, folds) if num_cols else {}
    modes = fold_modes(df, cat_cols, fold_col, folds) if cat_cols else {}
    fills = {int(k): (medians[int(k)]["fills"] if num_cols else {}) | modes.get(int(k), {}) for k in folds}
    filled = {}
    for c in (*num_cols, *cat_cols):
        by_fold = [F.when(F.col(fold_col) == k, F.lit(f[c])) for k, f in fills.items() if f[c] is not None]
        if by_fold:
            filled[c] = F.coalesce(_q(c), *by_fold)
    return df.withColumns(filled)


def fit_robust_scale(train: DataFrame, cols: Sequence[str]) -> dict:
    """(median, IQR) per column on training rows; IQR 0 (or undefined) -> 1."""
    q = quantile_dict(train, cols, [0.25, 0.5, 0.75])
    out = {}
    for c in cols:
        q1, med, q3 = q[(c, 0.25)], q[(c, 0.5)], q[(c, 0.75)]
        iqr = (q3 - q1) if (q1 is not None and q3 is not None) else None
        out[c] = (med if med is not None else 0.0, iqr if iqr else 1.0)
    return out


def apply_robust_scale(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x - median) / IQR."""
    return df.withColumns({c: (_q(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def robust_scale(train: DataFrame, target: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_robust_scale(target, fit_robust_scale(train, cols))


def fold_fits(df: DataFrame, cols: Sequence[str], impute_cols: Sequence[str], fold_col: str, folds: Sequence[int]) -> dict[int, dict]:
    """For every fold what its training part (the rows of all other folds) gives: {"fills": {col: median}, "scale": {col: (median, IQR)}}.

    The scale is that of the filled columns.  All folds come from one count of
    (column, value) by fold: a training part's counts are the total less the
    fold's.  Tables of more than ``ranking.SMALL_DISTINCT`` rows are counted by bins
    of values first, and by value only in the bins of the wanted ranks.
    Undefined or zero IQRs are 1, as in ``fit_robust_scale``.
    """
    folds, cols = [int(k) for k in folds], list(dict.fromkeys([*cols, *impute_cols]))
    own = df.select(F.col(fold_col).alias("_fold"), *[_q(c).cast("double").alias(c) for c in cols])
    if df.count() <= ranking.SMALL_DISTINCT:
        found = _fold_quantiles(own, cols, set(impute_cols), folds)
    else:
        found = _fold_brackets(own, cols, set(impute_cols), folds)
    out = {}
    for k in folds:
        scale = {}
        for c in cols:
            med, q1, q2, q3 = found.get((c, k), (None, None, None, None))
            iqr = q3 - q1 if q1 is not None else None
            scale[c] = (q2 if q2 is not None else 0.0, iqr if iqr else 1.0)
        out[k] = {"fills": {c: found.get((c, k), (None,))[0] for c in impute_cols}, "scale": scale}
    return out


def _fold_quantiles(own: DataFrame, cols: list[str], filled: set[str], folds: list[int]) -> dict:
    """{(column, fold): (median, q25, q50, q75)} from counts by value; a column has at most SMALL_DISTINCT of them."""
    counts = (unpivot(own, cols, ["_fold"]).select("feature", "_fold", F.when(~F.isnan("value"), F.col("value")).alias("value"))
              .groupBy("feature", "value", "_fold").agg(F.count(F.lit(1)).alias("n")))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        name, missing = b["feature"].iloc[0], b["value"].isna()
        values, at = np.unique(b.loc[~missing, "value"].to_numpy(), return_inverse=True)
        rows = []
        for k in folds:
            train = (b["_fold"] != k).to_numpy() & b["_fold"].notna().to_numpy()
            n = np.bincount(at, weights=(b["n"] * train)[~missing].to_numpy(), minlength=len(values)).astype(np.int64)
            lost = int((b["n"] * train)[missing].sum())
            if not n.sum():
                continue
            med = _at_share(values, n, 0.5)
            if name in filled and lost:
                place = int(np.searchsorted(values, med))
                n2, v2 = np.insert(n, place, lost), np.insert(values, place, med)
            else:
                n2, v2 = n, values
            rows.append((name, k, med, *[_at_share(v2, n2, p) for p in (0.25, 0.5, 0.75)]))
        return pd.DataFrame(rows, columns=["feature", "fold", "med", "q1", "q2", "q3"])

    got = counts.groupBy("feature").applyInPandas(run, "feature string, fold int, med double, q1 double, q2 double, q3 double").collect()
    return {(r["feature"], r["fold"]): (r["med"], r["q1"], r["q2"], r["q3"]) for r in got}


def _at_share(values: np.ndarray, counts: np.ndarray, p: float) -> float:
    """The interpolated quantile of sorted values with counts."""
    ends = np.cumsum(counts)
    pos = p * (int(ends[-1]) - 1)
    lo, hi = (float(values[np.searchsorted(ends, r, side="right")]) for r in (math.floor(pos), math.ceil(pos)))
    return lo + (hi - lo) * (pos - math.floor(pos))


#: Bins of one column's values, and the accuracy of the sketch that gives their bounds.
FOLD_BINS, FOLD_ACCURACY = 1024, 4096


def _fold_brackets(own: DataFrame, cols: list[str], filled: set[str], folds: list[int]) -> dict:
    """The same for large tables, every column read once for all folds.

    1. A sketch cuts each column into bins of about equal numbers of rows.
    2. One scan counts rows by (column, bin, fold); a training part's counts are the total less the fold's. Which
       ranks a filled column's quantiles have among the present values follows from the numbers present and missing.
    3. Only values of the bins that hold wanted ranks are counted by value and shuffled.

    The bounds decide how many rows step 3 reads, not the result.
    """
    own = own.where(F.col("_fold").isNotNull()).select(
        F.coalesce(*[F.when(F.col("_fold") == k, F.lit(i)) for i, k in enumerate(folds)], F.lit(len(folds))).alias("_fold"),
        *[F.when(~F.isnan(_q(c)), _q(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    shares = [i / FOLD_BINS for i in range(1, FOLD_BINS)]
    sketched = own.agg(*[F.percentile_approx(f"c{i}", shares, FOLD_ACCURACY).alias(f"c{i}") for i in range(len(cols))]).first()
    edges = [np.unique(np.asarray(e or [], dtype=np.float64)) for e in sketched]
    size, parts = FOLD_BINS + 1, len(folds) + 1  # the last bin: missing values; the last part: other folds

    def counted(batches):
        cells = np.zeros((len(cols), parts, size), dtype=np.int64)
        for b in batches:
            fold = b["_fold"].to_numpy()
            for i, e in enumerate(edges):
                x = b[f"c{i}"].to_numpy(dtype=np.float64)
                at = np.where(np.isnan(x), FOLD_BINS, np.searchsorted(e, x, side="left"))
                cells[i] += np.bincount(fold * size + at, minlength=parts * size).reshape(parts, size)
        cells = cells.ravel()
        on = np.flatnonzero(cells)
        yield pd.DataFrame({"cell": on, "n": cells[on]})

    cells = np.zeros(len(cols) * parts * size, dtype=np.int64)
    for r in own.mapInPandas(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[r["cell"]] = r["n"]
    cells = cells.reshape(len(cols), parts, size)

    # of each (column, fold) the ranks that its quantiles need; None stands for the median that fills
    plans, wanted = {}, {}
    for i, c in enumerate(cols):
        for j, k in enumerate(folds):
            train = cells[i].sum(axis=0) - cells[i, j]
            n, lost = int(train[:-1].sum()), int(train[-1]) if c in filled else 0
            if not n:
                continue
            middle = 0.5 * (n - 1)
            first = math.floor(middle) + 1  # filled values stand behind the value at the median's lower rank
            place = lambda r: r if r < first else None if r < first + lost else r - lost  # noqa: E731, B023
            plan = [(0.5, n, lambda r: r)] + [(p, n + lost, place) for p in (0.25, 0.5, 0.75)]
            plans[c, k] = [(*[of(r) for r in (math.floor(p * (m - 1)), math.ceil(p * (m - 1)))], p * (m - 1) - math.floor(p * (m - 1)))
                           for p, m, of in plan]
            ends = np.cumsum(train[:-1])
            for rank in {r for lo, hi, _ in plans[c, k] for r in (lo, hi) if r is not None}:
                bin_ = int(np.searchsorted(ends, rank, side="right"))
                wanted.setdefault((i, bin_), []).append((j, rank, rank - int(ends[bin_] - train[bin_])))
    bins = {i: np.isin(np.arange(size), [b for own_i, b in wanted if own_i == i]) for i in {i for i, _ in wanted}}

    def inside(batches):
        for b in batches:
            for i, keep in bins.items():
                x = b[f"c{i}"].to_numpy(dtype=np.float64)
                at = np.where(np.isnan(x), FOLD_BINS, np.searchsorted(edges[i], x, side="left"))
                own_rows = keep[at]
                yield pd.DataFrame({"col": i, "bin": at[own_rows], "part": b["_fold"].to_numpy()[own_rows], "value": x[own_rows]})

    def ranked(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        values, at = np.unique(b["value"].to_numpy(), return_inverse=True)
        rows = []
        for j, rank, rest in wanted[int(key[0]), int(key[1])]:
            ends = np.cumsum(np.bincount(at, weights=b["n"] * (b["part"] != j), minlength=len(values)).astype(np.int64))
            rows.append((key[0], j, rank, float(values[np.searchsorted(ends, rest, side="right")])))
        return pd.DataFrame(rows, columns=["col", "part", "rank", "value"])

    counts = (own.mapInPandas(inside, "col int, bin int, part int, value double").groupBy("col", "bin", "part", "value")
              .agg(F.count(F.lit(1)).alias("n")))
    at_rank = {(r["col"], r["part"], r["rank"]): r["value"] for r in
               counts.groupBy("col", "bin").applyInPandas(ranked, "col int, part int, rank long, value double").collect()}
    out = {}
    for (c, k), plan in plans.items():
        found: list[float] = []
        for lo, hi, frac in plan:
            low, high = (found[0] if r is None else at_rank[cols.index(c), folds.index(k), r] for r in (lo, hi))
            found.append(low + (high - low) * frac)
        out[c, k] = tuple(found)
    return out
