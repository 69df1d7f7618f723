"""Hyper-parameter search as a table of jobs that a stopped run continues.

A job is one (model, algorithm, outer fold, inner fold, grid point).  Its AUC goes
into a results table partitioned by these keys as soon as it is known, and a rerun
on the same folder computes only what the table lacks (``resume_skip_done``).  The
outer folds' own metrics are kept the same way, so a finished search returns from
the table alone.

What all jobs of a training part share is fitted once: medians and scales of all
inner parts of an outer fold come from one count by fold (``impute.fold_fits``),
class weights from another, and all fits of naive Bayes from one count of moments.
Jobs of one outer fold are fitted at the same time, ``together`` of them, and their
AUCs come from one grouped job.

The folder belongs to one table of rows and one list of features: give other data
another folder or another ``model``.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import threading
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.operators import metrics, neighbors, resample
from cohortlens.operators.impute import apply_fill, apply_robust_scale, fold_fits
from cohortlens.plans import workflow as wf
from cohortlens.plans.learners import GaussianNBSmoothed, apply_gaussian_nb, assembler, make_learner, nb_fit, nb_moments, positive_score
from cohortlens.sources.io import resume_skip_done, result_upsert

#: The searched values of every learner.  ``maxDepth`` 30 is MLlib's deepest tree and stands for "no limit".
GRIDS: dict[str, dict[str, list]] = {
    "logreg_ridge": {"C": [0.1, 1.0, 10.0, 100.0]},
    "logreg_lasso": {"C": [0.1, 1.0, 10.0, 100.0]},
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [3, 5, 10, 30]},
    "decision_tree": {"maxDepth": [3, 5, 10, 15, 30], "minInstancesPerNode": [1, 2, 5, 10]},
    "gradient_boosting": {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 5, 7]},
    "weighted_boosting": {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 5, 7]},
    "balanced_boosting": {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 5, 7]},
    "knn_classify": {"k": [3, 5, 7, 9, 11], "weights": ["uniform", "distance"], "metric": ["euclidean", "manhattan"]},
    "gaussian_nb": {"var_smoothing": [1e-9, 1e-8, 1e-7, 1e-6]},
    "linear_svm": {"C": [0.1, 1.0, 10.0, 100.0]},
    "rbf_svm": {"C": [0.1, 1.0, 10.0], "gamma": ["scale", "auto", 0.001, 0.01]},
    "mlp": {"hidden": [[64], [128], [64, 32]]},
}

JOB_KEYS = ("model", "algorithm", "outer", "inner", "point")
FOLD_KEYS = ("model", "algorithm", "outer")
JOB_SCHEMA = "model string, algorithm string, outer int, inner int, point string, position int, params string, auc double, failed int"
FOLD_SCHEMA = ("model string, algorithm string, outer int, params string, inner_auc double, auc double, precision double, "
               "recall double, f1 double, failed int")

#: Jobs of one outer fold and learner that are fitted and stored together.
TOGETHER = 40
#: What an outer fold that can't be fitted scores (auc, precision, recall, f1).
FAILED_FOLD = (0.5, 0.0, 0.0, 0.0)


def grid_points(grid: Mapping[str, Sequence]) -> list[dict]:
    """All combinations, the last name varying fastest; an empty grid is one point of defaults."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def point_key(params: Mapping) -> str:
    """A short name of a grid point that serves as a folder name."""
    return hashlib.md5(json.dumps(params, sort_keys=True).encode()).hexdigest()[:16]


def job_table(spark: SparkSession, model: str, grids: Mapping[str, Mapping], k_outer: int, k_inner: int) -> DataFrame:
    """One row for each job, ``position`` being the point's place in its grid."""
    rows = [(model, algorithm, o, i, point_key(p), n, json.dumps(p, sort_keys=True))
            for algorithm, grid in grids.items() for n, p in enumerate(grid_points(grid)) for o in range(k_outer) for i in range(k_inner)]
    return spark.createDataFrame(rows, "model string, algorithm string, outer int, inner int, point string, position int, params string")


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows stored at ``path``; none where nothing was stored yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def best_points(jobs: DataFrame) -> DataFrame:
    """(model, algorithm, outer, params, inner_auc): the point of the largest mean AUC over the inner folds.

    Ties go to the earlier point.  Points that failed in any inner fold come last;
    an outer fold all of whose points failed has none.
    """
    by = list(FOLD_KEYS)
    mean = jobs.groupBy(*by, "point", "position", "params").agg(F.avg("auc").alias("inner_auc"), F.sum("failed").alias("n_failed"))
    # means of equal AUCs may differ in the last bit by the order of summing
    rank = Window.partitionBy(*by).orderBy(F.round("inner_auc", 12).desc(), "position")
    return (mean.where("n_failed = 0").withColumn("_r", F.row_number().over(rank)).where("_r = 1")
            .select(*by, "params", "inner_auc"))


def _resolved(params: dict, train: DataFrame, n_features: int) -> dict:
    """``gamma`` by name to a number: "auto" is 1 / features, "scale" that over the variance of all training values."""
    if params.get("gamma") == "auto":
        return {**params, "gamma": 1.0 / n_features}
    if params.get("gamma") == "scale":
        values = train.select(F.explode("_vector").alias("v"))
        variance = values.agg(F.var_pop("v")).first()[0]
        return {**params, "gamma": 1.0 / (n_features * variance) if variance else 1.0}
    return params


def part_scores(train: DataFrame, valid: DataFrame, algorithm: str, params: dict, features: Sequence[str], label: str,
                id_col: str, n_rows: int, weight: str | None) -> DataFrame:
    """``valid`` with ``score`` and ``pred`` by a fit on ``train``; both hold imputed and scaled features, and them as array ``_vector``."""
    if algorithm == "knn_classify":
        votes = neighbors.knn_classify(train, valid, params["k"], id_col, "_vector", label, params.get("weights", "uniform"),
                                       params.get("metric", "euclidean"))
        share = F.when(F.col("pred") == 1, F.col("vote_share")).otherwise(1.0 - F.col("vote_share"))
        return valid.join(votes.select(id_col, share.alias("score"), "pred"), id_col, "left")
    if algorithm == "gaussian_nb":
        return wf._with_pred(GaussianNBSmoothed(features, label, params.get("var_smoothing", 1e-9)).fit(train).transform(valid))
    params = _resolved(params, train, len(features))
    learner = make_learner(algorithm, params, label=label, weight=weight, n_features=len(features), sum_weights=float(n_rows))
    model = Pipeline(stages=[assembler(features), learner]).fit(train)
    return wf._with_pred(positive_score(model.transform(valid), algorithm))


class _Parts:
    """Training and validation rows of one table by fold, imputed and scaled by their training part."""

    def __init__(self, df: DataFrame, features: Sequence[str], impute: Sequence[str], label: str, fold_col: str, folds: Sequence[int]):
        self.df, self.features, self.label, self.fold_col, self.folds = df, list(features), label, fold_col, list(folds)
        self.fits = fold_fits(df, features, impute, fold_col, folds)
        cells = df.groupBy(fold_col, label).count().collect()
        self.classes = {k: {r[label] for r in cells if r[fold_col] != k} for k in self.folds}
        self.weights: dict[str, dict] = {}
        self.lock = threading.Lock()
        self.moments: list | None = None

    def naive_bayes(self, fold: int, var_smoothing: float) -> dict:
        """The fit of a fold's training part, from moments that all folds share; ValueError where it has not both classes."""
        if len(self.classes[fold]) < 2:
            raise ValueError(f"one class only outside fold {fold}")
        with self.lock:
            if self.moments is None:
                self.moments = nb_moments(self.df, self.fold_col, self.features, self.label)
        return nb_fit(self.moments, fold, self.features, var_smoothing, self.fits[fold]["fills"], self.fits[fold]["scale"])

    def ready(self, fold: int) -> DataFrame:
        """All rows, filled and scaled by a fold's training part."""
        fit = self.fits[fold]
        return apply_robust_scale(apply_fill(self.df, fit["fills"]), {c: fit["scale"][c] for c in self.features})

    def part(self, fold: int, algorithm: str) -> tuple[DataFrame, DataFrame, int, str | None]:
        """(train, valid, rows of train, name of its weight column or None); ValueError where train has not both classes."""
        if len(self.classes[fold]) < 2:
            raise ValueError(f"one class only outside fold {fold}")
        with self.lock:
            if algorithm not in self.weights:
                self.weights[algorithm] = wf.fold_weights(self.df, algorithm, self.label, self.fold_col, self.folds)
        n, weight = self.weights[algorithm][fold]
        ready = self.ready(fold).withColumn("_vector", F.array(*[F.col(c).cast("double") for c in self.features]))
        if weight is not None:
            ready = ready.withColumn("weight", weight)
        own = F.col(self.fold_col)
        return ready.where(own != fold), ready.where(own == fold), n, None if weight is None else "weight"


def _naive_bayes_scores(parts: _Parts, jobs: Sequence, label: str) -> list[DataFrame]:
    """(inner, point, label, score) of naive Bayes jobs: a validation part is read once for all its points."""
    out = []
    for inner in dict.fromkeys(job["inner"] for job in jobs):
        try:
            fits = {job["point"]: parts.naive_bayes(inner, json.loads(job["params"]).get("var_smoothing", 1e-9)) for job in jobs if job["inner"] == inner}
        except wf.FIT_ERRORS:
            continue
        rows = parts.ready(inner).where(F.col(parts.fold_col) == inner)
        names = {f"_s{i}": point for i, point in enumerate(fits)}
        for name, point in names.items():
            rows = apply_gaussian_nb(rows, fits[point], name)
        scores = F.explode(F.array(*[F.struct(F.lit(point).alias("point"), F.col(name).alias("score")) for name, point in names.items()]))
        out.append(rows.select(F.col(label).alias("label"), scores.alias("_s")).select(F.lit(inner).alias("inner"), "_s.point", "label", "_s.score"))
    return out


def _job_rows(parts: _Parts, group: Sequence, features, label: str, id_col: str, parallelism: int) -> list[tuple]:
    """Results of some jobs of one outer fold: fitted at the same time, all scored by one grouped job."""
    def fitted(job):
        try:
            train, valid, n, weight = parts.part(job["inner"], job["algorithm"])
            scored = part_scores(train, valid, job["algorithm"], json.loads(job["params"]), features, label, id_col, n, weight)
        except wf.FIT_ERRORS:
            return None
        return scored.select(F.lit(job["inner"]).alias("inner"), F.lit(job["point"]).alias("point"), F.col(label).alias("label"), "score")

    shared = [job for job in group if job["algorithm"] == "gaussian_nb"]
    own = [job for job in group if job["algorithm"] != "gaussian_nb"]
    scored = _naive_bayes_scores(parts, shared, label) + [s for s in (wf.concurrently(fitted, own, parallelism) if own else []) if s is not None]
    aucs = {}
    if scored:
        every = metrics.roc_auc(functools.reduce(DataFrame.unionByName, scored), "score", "label", ["inner", "point"], len(group))
        aucs = {(r["inner"], r["point"]): r["auc"] for r in every.collect()}
    found = [aucs.get((job["inner"], job["point"])) for job in group]
    return [(*[job[c] for c in JOB_KEYS], job["position"], job["params"], auc, int(auc is None)) for job, auc in zip(group, found)]


@wf.releases_caches
def search_cv(df: DataFrame, grids: Mapping[str, Mapping], features: Sequence[str], path: str, model: str = "M", label: str = "label",
              id_col: str = "id_anon", k_outer: int = 5, k_inner: int = 5, parallelism: int = 4, impute: Sequence[str] = (),
              together: int = TOGETHER) -> DataFrame:
    """Nested cross-validation of several learners over their grids; (model, algorithm, outer, params, inner_auc, auc, precision, recall,
    f1, failed), a row for each learner and outer fold.

    ``df`` has the outer fold in column ``fold``; inner folds are exact and stratified.
    Each outer fold is scored by its best point (``best_points``) fitted on all its
    training rows.  A fit that can't be made (``workflow.FIT_ERRORS``), or a validation
    part of one class, fails its point; an outer fold without a best point, or whose
    refit fails, scores AUC 0.5 and precision, recall and F1 0, as ``nested_cv`` does, with ``failed`` 1.
    Rows whose label or fold is null take no part.  An empty table fails every fold.

    ``path`` is a folder that driver and executors share.  After a stop, the same call
    goes on where the tables in it end; at most ``parallelism`` x ``TOGETHER`` points are computed again.
    """
    spark = df.sparkSession
    jobs_at, folds_at = f"{path}/jobs", f"{path}/folds"
    base = wf._cache(df.where(F.col(label).isin(0, 1) & F.col("fold").isNotNull()).select(id_col, label, "fold", *features))
    jobs = job_table(spark, model, grids, k_outer, k_inner)
    lock = threading.Lock()

    def store(rows, schema, at, keys):
        with lock:
            result_upsert(spark.createDataFrame(rows, schema).coalesce(1), at, keys)

    # ---- inner jobs that the table lacks
    todo: dict[int, dict[str, list]] = {}
    for r in resume_skip_done(jobs, stored(spark, jobs_at, JOB_SCHEMA), JOB_KEYS).orderBy("outer", "algorithm", "position", "inner").collect():
        todo.setdefault(r["outer"], {}).setdefault(r["algorithm"], []).append(r)
    if todo:
        inner = wf._cache(resample.nested_folds(base, label, id_col, "fold", k_outer, k_inner, seed=7))

    def search_fold(outer: int) -> None:
        rows = wf._cache(base.drop("fold").join(inner.where(F.col("outer_fold") == outer).select(id_col, "inner_fold"), id_col))
        parts = _Parts(rows, features, impute, label, "inner_fold", range(k_inner))
        for own in todo[outer].values():
            for i in range(0, len(own), together):
                store(_job_rows(parts, own[i:i + together], features, label, id_col, within), JOB_SCHEMA, jobs_at, JOB_KEYS)
        rows.unpersist()

    # at most ``parallelism`` fits at the same time, over outer folds first
    within = max(1, parallelism // max(1, len(todo)))
    wf.concurrently(search_fold, list(todo), parallelism)

    # ---- outer folds that the table lacks
    wanted = jobs.select(*FOLD_KEYS).distinct()
    open_folds = sorted(tuple(r) for r in resume_skip_done(wanted, stored(spark, folds_at, FOLD_SCHEMA), FOLD_KEYS).collect())
    if open_folds:
        asked = stored(spark, jobs_at, JOB_SCHEMA).join(jobs.select(*JOB_KEYS), list(JOB_KEYS), "left_semi")
        best = {(r["model"], r["algorithm"], r["outer"]): r for r in best_points(asked).collect()}
        ready = _Parts(base, features, impute, label, "fold", range(k_outer))

        def refit(key):
            chosen, result, failed = best.get(key), FAILED_FOLD, 1
            if chosen is not None:
                try:
                    params = json.loads(chosen["params"])
                    if key[1] == "gaussian_nb":
                        fitted = ready.naive_bayes(key[2], params.get("var_smoothing", 1e-9))
                        scored = wf._with_pred(apply_gaussian_nb(ready.ready(key[2]).where(F.col("fold") == key[2]), fitted))
                    else:
                        train, valid, n, weight = ready.part(key[2], key[1])
                        scored = part_scores(train, valid, key[1], params, features, label, id_col, n, weight)
                    scored = wf._cache(scored.select(id_col, F.lit(key[2]).alias("fold"), label, "score", "pred"))
                    m = wf.fold_metrics(scored, label).first()
                except wf.FIT_ERRORS:
                    m = None
                if m is not None and m["auc"] is not None:
                    result, failed = (m["auc"], m["precision"], m["recall"], m["f1"]), 0
            store([(*key, chosen["params"] if chosen else None, chosen["inner_auc"] if chosen else None, *result, failed)],
                  FOLD_SCHEMA, folds_at, FOLD_KEYS)

        wf.concurrently(refit, open_folds, parallelism)
    return stored(spark, folds_at, FOLD_SCHEMA).join(wanted, list(FOLD_KEYS), "left_semi").select(*FOLD_KEYS, "params", "inner_auc", "auc",
                                                                                                  "precision", "recall", "f1", "failed")


def summarize_search(folds: DataFrame) -> DataFrame:
    """(model, algorithm, metric, n, mean, ci_lower, ci_upper, n_failed): t intervals over the outer folds."""
    keys = ["model", "algorithm"]
    long = folds.unpivot([*keys, "outer"], ["auc", "precision", "recall", "f1"], "metric", "value")
    failed = folds.groupBy(*keys).agg(F.sum("failed").cast("int").alias("n_failed"))
    return metrics.t_interval(long, "value", [*keys, "metric"]).join(failed, keys).select(
        *keys, "metric", "n", "mean", "ci_lower", "ci_upper", "n_failed")
