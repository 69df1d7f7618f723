"""Evaluation statistics.

AUC and the Mann-Whitney U are computed from per-score counts: group by
(keys, score) first (a repeated score becomes one row), then running negative
counts by the two-step rank of :mod:`ranking`.  All features / folds /
replicates are keys of one job; nothing loops on the driver.  The counts are
written once; many of them are cut into sorted runs whose sums are put together
(``rank_sums``), so no window holds a large group.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cohortlens.operators import ranking
from cohortlens.operators.ranking import exact_quantiles, null_safe_join, unpivot
from cohortlens.session import fresh_path


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


# ------------------------------------------------------------------ AUC / U
def score_counts(df: DataFrame, score_col: str, label_col: str, keys: Sequence[str] = (),
                 weight_col: str | None = None) -> DataFrame:
    """(keys, score, pos, neg) with complete rows only: a missing or NaN score takes no part."""
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    y = F.col(label_col)
    return (df.where(_q(score_col).isNotNull() & ~F.isnan(_q(score_col).cast("double")) & y.isNotNull())
            .groupBy(*keys, F.col(score_col).cast("double").alias("score"))
            .agg(F.sum(F.when(y == 1, w).otherwise(0.0)).alias("pos"),
                 F.sum(F.when(y == 1, 0.0).otherwise(w)).alias("neg")))


def roc_auc(df: DataFrame, score_col: str, label_col: str, keys: Sequence[str] = (),
            n_groups_bound: int | None = None, weight_col: str | None = None) -> DataFrame:
    """Area under the ROC curve with tie midranks, per group of ``keys``.

    Output (keys..., auc, n_pos, n_neg); auc is NULL when a group has one class.
    """
    return auc_of_counts(score_counts(df, score_col, label_col, keys, weight_col), keys)


def auc_of_counts(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., auc, n_pos, n_neg) from one row (keys, score, pos, neg) for each score."""
    agg = rank_sums(counts, keys)
    return agg.select(
        *keys,
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u1") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"),
        F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"),
    )


def rank_sums(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., u1, n_pos, n_neg, tie) from one row (keys, score, pos, neg) for each score; NULL keys are a group.

    ``u1`` counts the pairs of a positive row and a negative row of a lower score (of the same score: half), ``tie`` is the sum of
    t^3 - t over the scores' row numbers.  The counts are written once to the shared folder.  More of them than
    ``ranking.SMALL_DISTINCT`` are sorted by range; every run of sorted rows that a task reads sends on its own sums and its
    lowest score, and the runs of a group, in the order of these, give the negatives below each.
    """
    keys = list(keys)
    stored = fresh_path(counts.sparkSession, "scores")
    counts.write.parquet(stored)
    counts = counts.sparkSession.read.schema(counts.schema).parquet(stored)
    n = counts.count()
    if n <= ranking.SMALL_DISTINCT:
        below = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
        t = F.col("pos") + F.col("neg")
        runs = counts.select(*keys, "score", "pos", "neg", (F.lit(0.5) * F.col("pos") * F.col("neg")).alias("u"), (t * t * t - t).alias("tie"))
    else:
        parts = max(counts.sparkSession.sparkContext.defaultParallelism, ranking.buckets_for(n))
        schema = StructType([counts.schema[k] for k in keys] + [StructField(c, counts.schema["score"].dataType) for c in ("score", "pos", "neg", "u", "tie")])
        runs = (counts.select(*keys, "score", "pos", "neg").repartitionByRange(parts, *keys, "score").sortWithinPartitions(*keys, "score")
                .mapInArrow(_run_sums(keys), schema))
        below = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    u = F.col("u") + F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0.0))
    return runs.withColumn("u", u).groupBy(*keys).agg(F.sum("u").alias("u1"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
                                                      F.sum("tie").alias("tie"))


def _run_sums(keys: Sequence[str]):
    """Batches of rows sorted by (keys, score) to one row for each batch and group."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, dtype=bool)
            new[0] = True
            for k in keys:
                column = b.column(b.schema.get_field_index(k))
                a, z = column.slice(1), column.slice(0, b.num_rows - 1)
                differs = pc.or_(pc.fill_null(pc.not_equal(a, z), False), pc.xor(pc.is_null(a), pc.is_null(z)))
                new[1:] |= differs.to_numpy(zero_copy_only=False)
            at = np.flatnonzero(new)
            pos, neg = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("pos", "neg"))
            lower = np.cumsum(neg) - neg
            lower -= np.repeat(lower[at], np.diff(np.append(at, len(pos))))
            t = pos + neg
            sums = [np.add.reduceat(v, at) for v in (pos, neg, pos * (lower + 0.5 * neg), t * t * t - t)]
            first = [b.column(b.schema.get_field_index(c)).take(pa.array(at)) for c in (*keys, "score")]
            yield pa.RecordBatch.from_arrays([*first, *map(pa.array, sums)], names=[*keys, "score", "pos", "neg", "u", "tie"])
    return run


def erfc_expr(x: Column) -> Column:
    """Complementary error function by a published Chebyshev fit (fractional error < 1.2e-7).

    Coefficients: W. H. Press et al., Numerical Recipes, section 6.2 (fixed values).
    """
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    coeffs = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
              0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(coeffs[-1])
    for c in reversed(coeffs[:-1]):
        poly = F.lit(c) + t * poly
    ans = t * F.exp(-z * z + poly)
    return F.when(x >= 0, ans).otherwise(F.lit(2.0) - ans)


def mann_whitney(df: DataFrame, value_col: str, label_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Two-sided Mann-Whitney U test between label 1 and label 0.

    U1 = AUC * n1 * n0 (midranks); tie-corrected normal approximation with
    continuity correction; p = erfc(z / sqrt 2).  Without rows of one class, or with
    one value only (no variance), z and p_value are NULL.
    """
    keys = list(keys)
    agg = rank_sums(score_counts(df, value_col, label_col, keys), keys).withColumnsRenamed({"n_pos": "n1", "n_neg": "n0"})
    n = F.col("n1") + F.col("n0")
    mu = F.col("n1") * F.col("n0") / 2.0
    sigma = F.sqrt(F.col("n1") * F.col("n0") / 12.0 * ((n + 1) - F.coalesce(F.try_divide(F.col("tie"), n * (n - 1)), F.lit(0.0))))
    u = F.greatest(F.col("u1"), F.col("n1") * F.col("n0") - F.col("u1"))
    z = F.try_divide(u - mu - 0.5, F.when(sigma > 0, sigma))
    p = F.least(F.lit(1.0), F.lit(2.0) * (F.lit(0.5) * erfc_expr(z / math.sqrt(2.0))))
    return agg.select(
        *keys, F.round("u1", 6).alias("u"), F.round(z, 6).alias("z"),
        F.round(F.when(sigma > 0, p), 6).alias("p_value"),
        F.col("n1").cast("long").alias("n1"), F.col("n0").cast("long").alias("n0"),
    )


#: Values of all features together whose replicates are summed by value instead of sorting the rows.
FEW_SCORES = 128


def _few_scores(told: DataFrame, numeric: Sequence[str], categorical: Sequence[str], by_category: DataFrame | None) -> dict[str, list[tuple]]:
    """{feature: [(score, which rows have it)]} of the features with the fewest values, ``FEW_SCORES`` in all at most; a sketch chooses them."""
    value = lambda c: F.when(~F.isnan(_q(c).cast("double")), _q(c).cast("double")) if c in numeric else _q(c).cast("string")
    sizes = told.agg(*[F.approx_count_distinct(value(c)).alias(f"n{i}") for i, c in enumerate([*numeric, *categorical])]).first()
    chosen, total = [], 0
    for n, c in sorted(zip(sizes, [*numeric, *categorical])):
        total += n
        if total > FEW_SCORES:
            break
        chosen.append(c)
    own = [c for c in chosen if c in numeric]
    found = {c: [] for c in chosen}
    if own:
        for c, values in zip(own, told.agg(*[F.collect_set(value(c)).alias(f"v{i}") for i, c in enumerate(own)]).first()):
            found[c] = [(v, value(c) == F.lit(v)) for v in sorted({v + 0.0 for v in values})]
    if len(own) < len(chosen):
        rows = by_category.where(~F.isnan("score") & F.col("feature").isin([c for c in chosen if c not in numeric])).collect()
        for r in sorted(rows, key=lambda r: (r["score"], r["category"])):
            found[r["feature"]].append((r["score"], value(r["feature"]) == F.lit(r["category"])))
    return found


def univariate_auc(df: DataFrame, label_col: str, numeric: Sequence[str] = (), categorical: Sequence[str] = (),
                   min_n: int = 50, min_pos: int = 5, n_boot: int = 0, id_col: str | None = None,
                   seed: int = 42) -> DataFrame:
    """AUC of each feature alone, all features in one job.

    Complete rows per feature; needs n >= min_n, >= min_pos positives and not
    all positive.  Numeric features score by value; categorical ones by the
    mean label of their category.  AUC folded to >= 0.5 (``auc_folded``).

    With ``n_boot`` > 0 (and ``id_col``), adds a bootstrap percentile interval of the
    AUC: each row gets a Poisson(1) weight per replicate (``replicates.poisson_draws``).  Weights of features of few
    values are summed by value, all from one matrix of weights; the weighted AUCs of the others come from one sort
    of the rows.  One-class replicates are skipped.
    """
    ids = [id_col] if (n_boot and id_col) else []
    y = F.col(label_col)
    told = df.where(y.isNotNull())
    counts = []
    if numeric:
        counts.append(score_counts(unpivot(told, numeric, [label_col], "double", "feature", "score"), "score", label_col, ["feature"]))
    if categorical:
        # rows of one category share their score: they are counted before any of them needs it
        cat = unpivot(told, categorical, [label_col], "string", "feature", "category").where(F.col("category").isNotNull())
        by_category = cat.groupBy("feature", "category").agg(
            F.avg(y.cast("double")).alias("score"), F.sum(F.when(y == 1, 1.0).otherwise(0.0)).alias("pos"),
            F.sum(F.when(y == 1, 0.0).otherwise(1.0)).alias("neg"))
        counts.append(by_category.where(~F.isnan("score")).groupBy("feature", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    auc = auc_of_counts(functools.reduce(DataFrame.unionByName, counts), ["feature"])
    n = F.col("n_pos") + F.col("n_neg")
    ok = (n >= min_n) & (F.col("n_pos") >= min_pos) & (F.col("n_neg") > 0)
    out = auc.where(ok).select(
        "feature", (F.col("n_pos") + F.col("n_neg")).alias("n"), "n_pos",
        F.round("auc", 6).alias("auc"),
        F.round(F.greatest(F.col("auc"), F.lit(1.0) - F.col("auc")), 6).alias("auc_folded"),
    )
    if not ids:
        return out
    from cohortlens.operators.replicates import poisson_draws, replicate_auc, replicate_auc_of_few

    few = _few_scores(told, numeric, categorical, by_category if categorical else None)
    reps = [replicate_auc_of_few(poisson_draws(told, id_col, n_boot, seed), few, label_col, "feature")] if few else []
    parts, many, wide = [], [c for c in numeric if c not in few], [c for c in categorical if c not in few]
    if many:
        parts.append(unpivot(df, many, [*ids, label_col], "double", "feature", "score"))
    if wide:
        cat = unpivot(df, wide, [*ids, label_col], "string", "feature", "category").where(F.col("category").isNotNull())
        parts.append(cat.join(by_category.select("feature", "category", "score"), ["feature", "category"]).select("feature", *ids, label_col, "score"))
    if parts:
        long = functools.reduce(DataFrame.unionByName, [p.select("feature", *ids, label_col, "score") for p in parts])
        long = long.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col(label_col).isNotNull())
        reps.append(replicate_auc(poisson_draws(long, id_col, n_boot, seed), "score", label_col, "feature"))
    rep = functools.reduce(DataFrame.unionByName, reps)
    # one value a replicate: n_boot of them in a group at most
    ciw = rep.groupBy("feature").agg(F.round(F.percentile("auc", 0.025), 6).alias("ci_lower"),
                                     F.round(F.percentile("auc", 0.975), 6).alias("ci_upper"))
    return out.join(ciw, "feature", "left")


# ------------------------------------------------------------------ confusion
def _sum_if(c: Column) -> Column:
    return F.sum(c.cast("long"))


def confusion_counts(df: DataFrame, pred_col: str, label_col: str, keys: Sequence[str] = (),
                     weight_col: str | None = None) -> DataFrame:
    p, y = F.col(pred_col), F.col(label_col)
    if weight_col:
        w = F.col(weight_col).cast("double")
        s = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    else:
        s = _sum_if
    return df.groupBy(*keys).agg(
        s((p == 1) & (y == 1)).alias("tp"), s((p == 1) & (y == 0)).alias("fp"),
        s((p == 0) & (y == 1)).alias("fn"), s((p == 0) & (y == 0)).alias("tn"),
    )


def _div0(a: Column, b: Column) -> Column:
    """a / b with zero division -> 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion_metrics(df: DataFrame, pred_col: str, label_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """TP/FP/FN/TN, precision, recall, F1 (zero division -> 0)."""
    c = confusion_counts(df, pred_col, label_col, keys)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    prec, rec = _div0(tp, tp + fp), _div0(tp, tp + fn)
    return c.select(
        *keys, "tp", "fp", "fn", "tn",
        F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"),
        F.round(_div0(2 * prec * rec, prec + rec), 6).alias("f1"),
    )


def holdout_metrics(df: DataFrame, pred_col: str, label_col: str, keys: Sequence[str] = (),
                    weight_col: str | None = None) -> DataFrame:
    """Confusion metrics plus accuracy, specificity, NPV, PPV.

    One-class cases: only negatives -> specificity 1, NPV 1, PPV 0;
    only positives -> specificity 0, NPV 0, PPV 1 (as the reference).  ``weight_col``
    counts each row with its (e.g. Poisson bootstrap) weight.
    """
    return holdout_rates(confusion_counts(df, pred_col, label_col, keys, weight_col), keys)


def confusion_flags(pred_col: str, label_col: str) -> dict[str, Column]:
    """tp, fp, fn, tn as conditions of a row."""
    p, y = F.col(pred_col), F.col(label_col)
    return {"tp": (p == 1) & (y == 1), "fp": (p == 1) & (y == 0), "fn": (p == 0) & (y == 1), "tn": (p == 0) & (y == 0)}


def holdout_rates(c: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The rates of ``holdout_metrics`` from counts tp, fp, fn, tn."""
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    n_pos, n_neg = tp + fn, fp + tn
    prec, rec = _div0(tp, tp + fp), _div0(tp, tp + fn)
    spec = _div0(tn, tn + fp)
    npv = _div0(tn, tn + fn)
    only_neg, only_pos = n_pos == 0, n_neg == 0
    return c.select(
        *keys, "tp", "fp", "fn", "tn",
        F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"),
        F.round(_div0(2 * prec * rec, prec + rec), 6).alias("f1"),
        F.round(_div0(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"),
        F.round(F.when(only_neg, 1.0).when(only_pos, 0.0).otherwise(spec), 6).alias("specificity"),
        F.round(F.when(only_neg, 1.0).when(only_pos, 0.0).otherwise(npv), 6).alias("npv"),
        F.round(F.when(only_neg, 0.0).when(only_pos, 1.0).otherwise(prec), 6).alias("ppv"),
    )


# ------------------------------------------------------------------ intervals
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def t_cdf(t: float, df: float) -> float:
    """Student-t distribution function by quadrature.

    With t = sqrt(df) tan(a), the density becomes cos(a)^(df - 1) over
    sqrt(pi) gamma(df/2) / gamma((df+1)/2), smooth enough for 64 Gauss-Legendre nodes.
    """
    angle = math.atan2(abs(t), math.sqrt(df))
    if df > 1:  # beyond 9 standard widths the integrand is below double precision
        angle = min(angle, 9.0 / math.sqrt(df - 1))
    at = 0.5 * angle * (_NODES + 1.0)
    area = 0.5 * angle * float(_WEIGHTS @ np.cos(at) ** (df - 1.0))
    scale = math.exp(math.lgamma((df + 1.0) / 2.0) - math.lgamma(df / 2.0)) / math.sqrt(math.pi)
    half = min(0.5, scale * area)
    return 0.5 + half if t >= 0 else 0.5 - half


@functools.lru_cache(maxsize=4096)
def t_ppf(p: float, df: float) -> float:
    """Student-t quantile (p in (0.5, 1)): bisection of the distribution function."""
    lo, hi = 0.0, 1.0
    while t_cdf(hi, df) < p:
        lo, hi = hi, 2.0 * hi
    for _ in range(100):
        mid = 0.5 * (lo + hi)
        if hi - lo <= 1e-14 * hi:
            break
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return 0.5 * (lo + hi)


def _t_rows(q: float):
    def run(batches):
        for b in batches:
            yield b.assign(_t=[t_ppf(q, int(n) - 1) for n in b["_n"]])

    return run


def t_interval(df: DataFrame, value_col: str, keys: Sequence[str], confidence: float = 0.95,
               digits: int | None = 6) -> DataFrame:
    """mean +- t(1 - a/2, n - 1) * sd / sqrt(n) per group; n <= 1 -> mean for both ends.

    The t values of the group sizes that occur are a small table, joined by
    size.  ``digits=None`` keeps full precision.
    """
    g = df.groupBy(*keys).agg(F.count(value_col).alias("n"), F.avg(value_col).alias("mean"),
                              F.stddev_samp(value_col).alias("sd"))
    sizes = g.where("n > 1").select(F.col("n").alias("_n")).distinct()
    t = sizes.mapInPandas(_t_rows(1 - (1 - confidence) / 2), "_n long, _t double")
    g = g.join(t, F.col("n") == F.col("_n"), "left")
    half = F.coalesce(F.col("_t") * F.col("sd") / F.sqrt(F.col("n")), F.lit(0.0))
    rnd = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return g.select(
        *keys, "n", rnd(F.col("mean")).alias("mean"),
        rnd(F.col("mean") - half).alias("ci_lower"), rnd(F.col("mean") + half).alias("ci_upper"),
    )


def percentile_interval(df: DataFrame, value_col: str, keys: Sequence[str] = (),
                        lower: float = 0.025, upper: float = 0.975) -> DataFrame:
    """mean and the lower / upper percentiles (exact, interpolated) per group."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.avg(value_col).alias("mean"))
    q = exact_quantiles(df, [value_col], [lower, upper], by=keys)
    qw = q.groupBy(*keys).agg(F.max(F.when(F.col("p") == lower, F.col("q"))).alias("ci_lower"),
                              F.max(F.when(F.col("p") == upper, F.col("q"))).alias("ci_upper"))
    if not keys:
        # one group: the two fitted percentiles come back as literals
        qd = {float(r["p"]): r["q"] for r in q.collect()}
        return m.select(F.round("mean", 6).alias("mean"), F.round(F.lit(qd.get(lower)), 6).alias("ci_lower"),
                        F.round(F.lit(qd.get(upper)), 6).alias("ci_upper"))
    j = null_safe_join(m, qw, keys)
    return j.select(*keys, F.round("mean", 6).alias("mean"), F.round("ci_lower", 6).alias("ci_lower"),
                    F.round("ci_upper", 6).alias("ci_upper"))


# ------------------------------------------------------------------ result-table rules
def feature_status(features: DataFrame, retained: DataFrame, missing_pct_col: str = "pct_missing",
                   threshold_pct: float = 30.0) -> DataFrame:
    """retained / removed_high_missing (> threshold) / removed_low_missing."""
    r = retained.select("feature").distinct().withColumn("_ret", F.lit(1))
    j = features.join(r, "feature", "left")
    return j.select(
        "feature", F.col(missing_pct_col).alias(missing_pct_col),
        F.when(F.col("_ret") == 1, "retained")
        .when(F.col(missing_pct_col) > threshold_pct, "removed_high_missing")
        .otherwise("removed_low_missing").alias("status"),
    )


def ci_excludes(df: DataFrame, estimate: str = "estimate", lo: str = "ci_lower", hi: str = "ci_upper",
                chance: float = 0.5) -> DataFrame:
    """Flags: lower bound above chance; significant coefficient (lo > 0 or hi < 0);
    direction Risk / Protective; rank by |estimate| (report-sized table)."""
    from pyspark.sql import Window

    w = Window.orderBy(F.desc(F.abs(F.col(estimate))), F.asc("feature"))
    return df.select(
        "*",
        (F.col(lo) > chance).cast("int").alias("above_chance"),
        ((F.col(lo) > 0) | (F.col(hi) < 0)).cast("int").alias("significant"),
        F.when(F.col(estimate) > 0, "Risk").otherwise("Protective").alias("direction"),
        F.row_number().over(w).alias("rank_abs"),
    )


def auc_band(df: DataFrame, mean: str = "auc", lo: str = "ci_lower", hi: str = "ci_upper",
             precision: str | None = "precision") -> DataFrame:
    """includes_chance (lo <= 0.5) / weak (hi < 0.7) / moderate; exceeds-chance and low-precision flags."""
    band = F.when(F.col(lo) <= 0.5, "includes_chance").when(F.col(hi) < 0.7, "weak").otherwise("moderate")
    cols = ["*", band.alias("band"), (F.col(lo) > 0.5).cast("int").alias("exceeds_chance")]
    if precision:
        cols.append((F.col(precision) < 0.10).cast("int").alias("low_precision"))
    return df.select(*cols)


def delta_verdict(new: DataFrame, old: DataFrame, keys: Sequence[str] = ("model", "algorithm"),
                  score: str = "auc", tolerance: float = 0.02) -> DataFrame:
    """new - old score per key; 'No change' if |d| < tolerance else 'Better' / 'Worse'."""
    j = new.select(*keys, F.col(score).alias("new")).join(old.select(*keys, F.col(score).alias("old")), list(keys))
    d = F.col("new") - F.col("old")
    return j.select(
        *keys, F.round("new", 6).alias("new"), F.round("old", 6).alias("old"), F.round(d, 6).alias("delta"),
        F.when(F.abs(d) < tolerance, "No change").when(d > 0, "Better").otherwise("Worse").alias("verdict"),
    )


def delta_summary(verdicts: DataFrame) -> DataFrame:
    """Counts per verdict and mean delta."""
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("delta"), 6).alias("mean_delta"))


def performance_table(long: DataFrame, metrics: Sequence[str], digits: int = 3) -> DataFrame:
    """Long results (model, algorithm, metric, mean, ci_lower, ci_upper) -> one row per
    (model, algorithm) with 'm [lo-hi]' strings per metric (pivot on a fixed metric list)."""
    f = f"%.{digits}f"
    txt = F.format_string(f"{f} [{f}-{f}]", "mean", "ci_lower", "ci_upper")
    return (long.select("model", "algorithm", "metric", txt.alias("_txt"))
            .groupBy("model", "algorithm").pivot("metric", list(metrics)).agg(F.first("_txt")))
