"""Splitting, resampling and weighting.

Every random choice is a seeded hash of (seed, keys), so results do not depend
on partitioning and an SQL oracle can repeat them.  Per-class ranks use the
two-step rank of :mod:`ranking` (hash buckets + offsets), so a class holding a
third of all rows is still spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.hashing import HASH_RANGE, portable_hash
from cohortlens.operators.ranking import counts_before, null_safe_join, rank_by_hash


def _class_counts(df: DataFrame, class_col: str) -> DataFrame:
    return df.groupBy(class_col).agg(F.count(F.lit(1)).alias("_n_class"))


def stratified_split(df: DataFrame, class_col: str, id_col: str, test_frac: float = 0.2, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """Exact per-class split: the first round(n_c * test_frac) rows of each class, ordered by
    (hash(seed, id), id), go to ``test``; the rest to ``train``."""
    h = df.withColumn("_h", portable_hash(seed, id_col))
    ranked = rank_by_hash(h, [class_col], "_h", id_col)
    ranked = null_safe_join(ranked, _class_counts(df, class_col), [class_col])
    n_test = F.floor(F.col("_n_class") * F.lit(float(test_frac)) + F.lit(0.5))
    return ranked.withColumn(out, F.when(F.col("_pos") < n_test, "test").otherwise("train")).drop("_h", "_pos", "_n_class")


def stratified_kfold(df: DataFrame, class_col: str, id_col: str, k: int = 5, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """fold = (rank within class by (hash(seed, id), id)) mod k: class-balanced, sizes differ by <= 1."""
    h = df.withColumn("_h", portable_hash(seed, id_col))
    ranked = rank_by_hash(h, [class_col], "_h", id_col)
    return ranked.withColumn(out, (F.col("_pos") % k).cast("int")).drop("_h", "_pos")


def nested_folds(df: DataFrame, class_col: str, id_col: str, fold_col: str = "fold", k_outer: int = 5,
                 k_inner: int = 5, seed: int = 7) -> DataFrame:
    """Inner folds inside each outer training part.

    Output rows (outer_fold, id, class, inner_fold): for each outer fold k, the
    rows with fold != k re-ranked within class by a second seeded hash.
    """
    outer = F.explode(F.sequence(F.lit(0), F.lit(k_outer - 1))).alias("outer_fold")
    ex = df.select(id_col, class_col, fold_col, outer).where(F.col(fold_col) != F.col("outer_fold"))
    ex = ex.withColumn("_h", portable_hash(seed, id_col))
    ranked = rank_by_hash(ex, ["outer_fold", class_col], "_h", id_col)
    return ranked.select("outer_fold", id_col, class_col, (F.col("_pos") % k_inner).cast("int").alias("inner_fold"))


def inner_folds(df: DataFrame, class_col: str, id_col: str, fold_col: str = "fold", k_outer: int = 5, k_inner: int = 5, seed: int = 7,
                out: str = "inner") -> DataFrame:
    """``nested_folds`` as one array column: element f is the row's inner fold inside the training part of outer fold f (NULL: not in it).

    A row's position among the rows of all other folds is its position among all rows, less that among the fold's: one ranking
    gives all of them, and no row is repeated or joined.
    """
    within = F.col(fold_col).isNotNull()
    before = {"_all": within, **{f"_own{f}": F.col(fold_col) == f for f in range(k_outer)}}
    h = df.withColumn("_h", portable_hash(seed, id_col))
    ranked = counts_before(h, [class_col], "_h", id_col, before)
    inner = F.array(*[F.when(F.col(fold_col) != f, ((F.col("_all") - F.col(f"_own{f}")) % k_inner).cast("int")) for f in range(k_outer)])
    return ranked.withColumn(out, inner).drop("_h", *before)


def row_positions(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """Dense 0-based row index ``_pos`` ordered by (hash(seed, id), id)."""
    h = df.withColumn("_h", portable_hash(seed, id_col)).withColumn("_all", F.lit(0))
    return rank_by_hash(h, ["_all"], "_h", id_col).drop("_h", "_all")


def bootstrap_rows(df: DataFrame, id_col: str, n_replicates: int, seed: int = 42) -> DataFrame:
    """Exact bootstrap: replicate b in 1..B draws n rows with replacement.

    Slot j of replicate b takes row ``hash(seed, b, j) mod n``.  The (b, j)
    slots are generated by ``spark.range`` (B * n rows) and joined to the
    indexed rows, so the cost is B * n rows spread over the cluster.  Output:
    the drawn rows with columns ``replicate`` and ``slot``.
    """
    spark = df.sparkSession
    pos = row_positions(df, id_col)
    n = df.count()
    if n == 0:
        return pos.select(F.lit(0).alias("replicate"), F.lit(0).alias("slot"), *df.columns).limit(0)
    slots = spark.range(0, n_replicates * n).select(
        (F.col("id") / F.lit(n)).cast("long").alias("_b0"), (F.col("id") % F.lit(n)).alias("slot")
    ).withColumn("replicate", (F.col("_b0") + 1).cast("int")).drop("_b0")
    slots = slots.withColumn("_pos", portable_hash(seed, "replicate", "slot") % F.lit(n))
    return slots.join(pos, "_pos").drop("_pos")


# Poisson(1) cumulative probabilities P(K <= k), k = 0..11 (fixed values: e^-1 * sum_{i<=k} 1/i!)
def _poisson1_cdf(kmax: int = 11) -> list[float]:
    out, term, acc = [], math.exp(-1.0), 0.0
    for i in range(kmax + 1):
        if i:
            term /= i
        acc += term
        out.append(acc)
    return out


def poisson_weight(u) -> F.Column:
    """Poisson(1) draw from a uniform u in [0, 1) by inverse CDF."""
    cdf = _poisson1_cdf()
    expr = None
    for k, c in enumerate(cdf):
        expr = F.when(u < c, F.lit(k)) if expr is None else expr.when(u < c, F.lit(k))
    return expr.otherwise(F.lit(len(cdf)))


def poisson_bootstrap_weights(df: DataFrame, id_col: str, n_replicates: int, seed: int = 42,
                              fast: bool = True) -> DataFrame:
    """Bootstrap at volume: each row gets a Poisson(1) weight per replicate.

    No join and no row index; replicate sizes vary around n.  Rows with
    weight 0 are dropped.  ``fast`` uses xxhash64; else the portable md5 hash.
    """
    rep = F.explode(F.sequence(F.lit(1), F.lit(n_replicates))).alias("replicate")
    ex = df.select("*", rep)
    if fast:
        u = (F.abs(F.xxhash64(F.lit(seed), F.col(id_col), F.col("replicate"))) % F.lit(1 << 30)) / float(1 << 30)
    else:
        u = portable_hash(seed, id_col, "replicate") / float(HASH_RANGE)
    return ex.withColumn("weight", poisson_weight(u)).where(F.col("weight") > 0)


def bootstrap_fold_mean(fold_scores: DataFrame, group_cols: Sequence[str], score_col: str, fold_col: str,
                        n_replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Resample the k fold scores of each group B times; mean per replicate; percentile CI.

    Output per group: mean of the fold scores, and the 2.5 / 97.5 percentiles
    of the B replicate means.  B is a parameter (bounded), so the per-group
    percentile holds at most B values.
    """
    g = list(group_cols)
    k = fold_scores.groupBy(*g).agg(F.count(F.lit(1)).alias("_k"), F.avg(score_col).alias("mean"))
    ex = k.select(*g, "_k", "mean", F.explode(F.sequence(F.lit(1), F.lit(n_replicates))).alias("replicate"))
    ex = ex.select(*g, "_k", "mean", "replicate", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("slot"))
    keystr = F.concat_ws("|", *[F.col(c).cast("string") for c in g]) if g else F.lit("")
    ex = ex.withColumn("_draw", (portable_hash(seed, keystr, "replicate", "slot") % F.col("_k")).cast("int"))
    scores = fold_scores.select(*g, F.col(fold_col).cast("int").alias("_draw"), F.col(score_col).alias("_s"))
    rep = ex.join(scores, [*g, "_draw"]).groupBy(*g, "mean", "replicate").agg(F.avg("_s").alias("_rm"))
    return rep.groupBy(*g, "mean").agg(
        F.percentile("_rm", 0.025).alias("ci_lower"), F.percentile("_rm", 0.975).alias("ci_upper")
    ).select(*g, F.round("mean", 6).alias("mean"), F.round("ci_lower", 6).alias("ci_lower"),
             F.round("ci_upper", 6).alias("ci_upper"))


def balanced_weights(df: DataFrame, label_col: str, out: str = "weight") -> DataFrame:
    """weight = n / (n_classes * n_class) (sklearn 'balanced'); a missing label is a class of its own.

    The counts are joined, whatever the number of classes.
    """
    counts = _class_counts(df, label_col)
    n, k = counts.agg(F.sum("_n_class"), F.count(F.lit(1))).first()
    weights = counts.select(label_col, (F.lit(float(n or 0)) / (F.lit(float(k or 1)) * F.col("_n_class"))).alias("_w"))
    return null_safe_join(df, weights, [label_col]).withColumn(out, F.col("_w")).drop("_w")


def pos_weight(df: DataFrame, label_col: str, weight: float | None = 33.0, out: str = "weight") -> DataFrame:
    """Positives get ``weight`` (33 in the reference); None -> n_neg / max(n_pos, 1)."""
    if weight is None:
        r = df.agg(F.sum((F.col(label_col) == 1).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).first()
        p = r["p"] or 0
        weight = (r["n"] - p) / max(p, 1)
    return df.withColumn(out, F.when(F.col(label_col) == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))
