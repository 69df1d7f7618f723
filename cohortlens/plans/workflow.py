"""Model workflows composed from operators and MLlib.

Folds are a column; every fit is a Spark job on the rows of its training
part; the predictions of all folds are unioned so that the per-fold metrics
come out of one grouped job (``keys=["fold"]``).  Inner hyper-parameter search
(``searched``) shares medians, scales and AUCs over our exact stratified inner folds.
"""

from __future__ import annotations

import contextvars
import functools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.errors import IllegalArgumentException
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.base import _FitMultipleIterator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import metrics, neighbors, replicates, resample
from cohortlens.operators.impute import apply_fill, apply_robust_scale, fit_median, fold_fits
from cohortlens.plans.learners import (
    GaussianNBSmoothed,
    RobustScaleIQR,
    RobustScaleIQRModel,
    assembler,
    make_learner,
    positive_score,
)
from cohortlens.plans.many_models import fit_replicates
from cohortlens.session import fresh_path


#: The frames that the running workflow has cached; one list for each call, shared with the threads it starts.
_OWN_CACHES: contextvars.ContextVar[list | None] = contextvars.ContextVar("own_caches", default=None)

#: What a learner raises when its training part can't be fitted (one class, empty, singular); anything else is a fault.
FIT_ERRORS = (IllegalArgumentException, ValueError, ArithmeticError)


def _cache(df: DataFrame) -> DataFrame:
    """cache() and remember it, so the enclosing workflow can release it."""
    df = df.cache()
    own = _OWN_CACHES.get()
    if own is not None:
        own.append(df)
    return df


def concurrently(fn, items: Sequence, workers: int) -> list:
    """fn of every item, in threads that belong to the calling workflow."""
    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(items)))) as pool:
        jobs = [pool.submit(contextvars.copy_context().run, fn, i) for i in items]
        return [j.result() for j in jobs]


def releases_caches(fn):
    """Run a workflow, write its result to the shared folder, then unpersist what it cached."""
    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        own: list = []
        token = _OWN_CACHES.set(own)
        try:
            out = fn(*args, **kwargs)
            path = fresh_path(out.sparkSession, f"result-{fn.__name__}")
            out.write.parquet(path)
            return out.sparkSession.read.schema(out.schema).parquet(path)
        finally:
            _OWN_CACHES.reset(token)
            for d in own:
                d.unpersist()
    return wrapper


class MedianImputeExact(Estimator):
    """Missing -> median of the rows passed to ``fit`` (exact, distributed)."""

    def __init__(self, inputCols: Sequence[str] = ()):
        super().__init__()
        self.inputCols = list(inputCols)

    def _fit(self, dataset: DataFrame) -> "MedianImputeExactModel":
        return MedianImputeExactModel(fit_median(dataset, self.inputCols))


class MedianImputeExactModel(Model):
    def __init__(self, fills: dict | None = None):
        super().__init__()
        self.fills = fills or {}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return apply_fill(dataset, self.fills)


def build_pipeline(learner_name: str, features: Sequence[str], params: dict | None = None, label: str = "label",
                   weight: str | None = "weight", n_rows: int = 1, impute: Sequence[str] = (),
                   scale: bool = True) -> Pipeline:
    """impute -> robust scale -> assemble -> learner (all fitted on the training rows only)."""
    stages = []
    if impute:
        stages.append(MedianImputeExact(impute))
    if scale:
        stages.append(RobustScaleIQR(features))
    if learner_name == "gaussian_nb":
        stages.append(GaussianNBSmoothed(features, label, (params or {}).get("var_smoothing", 1e-9)))
        return Pipeline(stages=stages)
    stages.append(assembler(features))
    stages.append(make_learner(learner_name, params, label=label, weight=weight, n_features=len(features),
                               sum_weights=float(n_rows)))
    return Pipeline(stages=stages)


def with_synthetic(rows: DataFrame, features: Sequence[str], label: str, id_col: str, counts: dict, k: int = 5, seed: int = 42) -> DataFrame:
    """(id, features, label) of prepared rows and of synthetic minority rows, whose ids are negative; written to the shared folder.

    ``counts``: the rows of each label.
    """
    rows = rows.select(id_col, *[F.col(c).cast("double").alias(c) for c in features], label)
    minority = rows.where(F.col(label) == 1).select(id_col, F.array(*features).alias("_vector"))
    made = neighbors.smote(minority, counts.get(0, 0) - counts.get(1, 0), id_col, "_vector", k, seed)
    made = made.select((-1 - F.col("syn_id")).alias(id_col), *[F.col("vector")[i].alias(c) for i, c in enumerate(features)],
                       F.lit(1).cast(rows.schema[label].dataType).alias(label))
    path = fresh_path(rows.sparkSession, "resampled")
    whole = rows.unionByName(made)
    whole.write.parquet(path)
    return rows.sparkSession.read.schema(whole.schema).parquet(path)


class SmotePipeline(Estimator):
    """impute -> robust scale -> SMOTE -> learner, where only ``fit`` sees synthetic rows.

    In a search every inner training part so has synthetic rows of its own minority (label 1) rows, and
    validation rows are neither parents nor children of any.  All parameter maps of one training part
    share its synthetic rows, which are written to the shared folder.  With fewer than two minority rows, or
    classes of one size, nothing is added.
    """

    def __init__(self, learner: Estimator | None = None, features: Sequence[str] = (), label: str = "label", id_col: str = "id_anon",
                 impute: Sequence[str] = (), k: int = 5, seed: int = 42):
        super().__init__()
        self.learner, self.features, self.label, self.id_col = learner, list(features), label, id_col
        self.impute, self.k, self.seed = list(impute), k, seed

    def copy(self, extra=None) -> "SmotePipeline":
        that = super().copy(extra)
        that.learner = self.learner.copy(extra)
        return that

    def resampled(self, dataset: DataFrame) -> tuple[list, DataFrame]:
        """The fitted preparations and the prepared rows (id, features, label) with the synthetic ones, whose ids are negative."""
        prepare = Pipeline(stages=[*([MedianImputeExact(self.impute)] if self.impute else []), RobustScaleIQR(self.features)]).fit(dataset)
        rows = prepare.transform(dataset)
        counts = {r[self.label]: r["count"] for r in rows.groupBy(self.label).count().collect()}
        return prepare.stages, with_synthetic(rows, self.features, self.label, self.id_col, counts, self.k, self.seed)

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict]):
        stages, rows = self.resampled(dataset)
        join = assembler(self.features)
        ready = join.transform(rows)
        return _FitMultipleIterator(lambda i: PipelineModel([*stages, join, self.learner.fit(ready, paramMaps[i])]), len(paramMaps))

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        return next(self.fitMultiple(dataset, [{}]))[1]


UNWEIGHTED = {"gradient_boosting", "mlp", "gaussian_nb"}


def _with_weights(df: DataFrame, learner_name: str, label: str) -> DataFrame:
    if learner_name in UNWEIGHTED:
        return df
    if learner_name == "weighted_boosting":
        return resample.pos_weight(df, label, 33.0)
    return resample.balanced_weights(df, label)


#: Learners that pass over their rows up to some hundred times, and whose fit is a sum over rows: it doesn't depend on how they are dealt out.
MANY_PASSES = {"logreg_ridge", "logreg_lasso", "logreg_elastic", "linear_svm", "rbf_svm"}
#: Rows of a task in these passes, at least: a pass over a small table takes as long as its tasks take to start.
PASS_ROWS = 200_000


def dealt(train: DataFrame, learner_name: str, n_rows: int) -> DataFrame:
    """``train`` in no more partitions than its passes have work for."""
    return train.coalesce(max(1, -(-n_rows // PASS_ROWS))) if learner_name in MANY_PASSES else train


#: Training rows that the fits running at the same time keep in memory, in all.
ROWS_AT_ONCE = 40_000_000


def at_once(n_rows: int, workers: int) -> int:
    """How many fits on ``n_rows`` rows each run at the same time: a learner keeps its rows for all its passes, and a large fit fills the cluster by itself."""
    return max(1, min(workers, ROWS_AT_ONCE // max(1, n_rows)))


def fit_score(rows: DataFrame, part_col: str, learner_name: str, features: Sequence[str],
              params: dict | None = None, label: str = "label", impute: Sequence[str] = ()) -> DataFrame:
    """Fit on the rows whose ``part_col`` is "train" (medians, scales, weights from these), return the "test" rows with ``score`` and ``pred``.

    The rows are kept for all passes; medians and scales come from one count (``impute.fold_fits``).
    """
    part = F.when(F.col(part_col) == "train", 1).when(F.col(part_col) == "test", 0)
    kept = _cache(rows.withColumn("_part", part))
    fit = fold_fits(kept, features, impute, "_part", [0])[0]
    n, weight = fold_weights(kept, learner_name, label, "_part", [0])[0]
    return _fitted_scores(kept, "_part", 0, fit, n, weight, learner_name, features, params, label)


def _fitted_scores(rows: DataFrame, fold_col: str, fold: int, fit: dict, n: int, weight: Column | None, learner_name: str, features: Sequence[str],
                   params: dict | None, label: str) -> DataFrame:
    """The rows of one fold, scored by a fit on the ``n`` rows of the others."""
    ready = apply_robust_scale(apply_fill(rows, fit["fills"]), {c: fit["scale"][c] for c in features})
    train, test = ready.where(F.col(fold_col) != fold), ready.where(F.col(fold_col) == fold)
    if weight is not None:
        train = train.withColumn("weight", weight)
    pipe = build_pipeline(learner_name, features, params, label, None if weight is None else "weight", n, scale=False)
    return _with_pred(positive_score(pipe.fit(dealt(train, learner_name, n)).transform(test), learner_name))


def _with_pred(scored: DataFrame) -> DataFrame:
    if "prediction" in scored.columns:
        return scored.withColumn("pred", F.col("prediction").cast("int"))
    return scored.withColumn("pred", (F.col("score") >= 0.5).cast("int"))


def class_weight(counts: dict, learner_name: str, label: str) -> Column | None:
    """The weight column of rows whose labels occur ``counts`` times; None for a learner without weights."""
    if learner_name in UNWEIGHTED:
        return None
    if learner_name == "weighted_boosting":
        return F.when(F.col(label) == 1, F.lit(33.0)).otherwise(F.lit(1.0))
    if not counts:
        return F.lit(1.0)
    n = sum(counts.values())  # balanced; a missing label is a class of its own
    return F.coalesce(*[F.when(F.col(label).eqNullSafe(F.lit(c)), F.lit(n / (len(counts) * m))) for c, m in counts.items()])


def fold_weights(df: DataFrame, learner_name: str, label: str, fold_col: str, folds: Sequence[int]) -> dict[int, tuple[int, Column | None]]:
    """For every fold the rows of its training part and its weight column, from one count by (fold, class)."""
    counts = df.groupBy(F.col(fold_col).alias("_fold"), F.col(label).alias("_cls")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for f in folds:
        own: dict = {}
        for r in counts:
            if r["_fold"] is not None and r["_fold"] != f:
                own[r["_cls"]] = own.get(r["_cls"], 0) + r["n"]
        n = sum(own.values())
        out[f] = (n, class_weight(own, learner_name, label))
    return out


def fold_predictions(df: DataFrame, learner_name: str, features: Sequence[str], params: dict | None = None,
                     label: str = "label", fold_col: str = "fold", k: int = 5, id_col: str = "id_anon",
                     impute: Sequence[str] = (), parallelism: int = 5) -> DataFrame:
    """Out-of-fold predictions (id, fold, label, score, pred) for every fold (simple CV, no search).

    Medians, scales, class weights and sizes of all training parts come from two
    jobs (``impute.fold_fits``, ``fold_weights``); each fold then only fits its learner.
    """
    cached = _cache(df)
    fits = fold_fits(cached, features, impute, fold_col, range(k))
    weights = fold_weights(cached, learner_name, label, fold_col, range(k))

    def one(f):
        n, weight = weights[f]
        scored = _fitted_scores(cached, fold_col, f, fits[f], n, weight, learner_name, features, params, label)
        # materialise the fold's predictions while the fold's model is at hand
        return _cache(scored.select(id_col, F.lit(f).alias("fold"), label, "score", "pred"))

    # independent folds are fitted concurrently (Spark schedules jobs from several threads)
    parts = concurrently(one, range(k), at_once(max((n for n, _ in weights.values()), default=0), min(parallelism, k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold_metrics(preds: DataFrame, label: str = "label") -> DataFrame:
    """Per fold: AUC, precision, recall, F1 (one grouped job each)."""
    auc = metrics.roc_auc(preds, "score", label, ["fold"], n_groups_bound=64).select("fold", "auc")
    conf = metrics.confusion_metrics(preds, "pred", label, ["fold"]).select("fold", "precision", "recall", "f1")
    return auc.join(conf, "fold")


def summarize_folds(fm: DataFrame, model: str, algorithm: str) -> DataFrame:
    """Long results: (model, algorithm, metric, mean, ci_lower, ci_upper) with t intervals over folds."""
    long = fm.unpivot(["fold"], ["auc", "precision", "recall", "f1"], "metric", "value")
    ti = metrics.t_interval(long, "value", ["metric"])
    return ti.select(F.lit(model).alias("model"), F.lit(algorithm).alias("algorithm"), "metric", "n",
                     "mean", "ci_lower", "ci_upper")


@releases_caches
def simple_cv(df: DataFrame, learner_name: str, features: Sequence[str], params: dict | None = None,
              model: str = "M", label: str = "label", impute: Sequence[str] = ()) -> DataFrame:
    preds = fold_predictions(df, learner_name, features, params, label, impute=impute)
    return summarize_folds(fold_metrics(preds, label), model, learner_name)


def param_grid(est, learner_name: str, grid: dict, n_rows: int):
    """ParamGridBuilder over the learner stage; C values become regParam = 1 / (C * n)."""
    learner = est.learner if isinstance(est, SmotePipeline) else est
    while hasattr(learner, "getStages"):
        learner = learner.getStages()[-1]
    b = ParamGridBuilder()
    for k, values in grid.items():
        if k == "C":
            b = b.addGrid(learner.regParam, [1.0 / (c * n_rows) for c in values])
        else:
            b = b.addGrid(getattr(learner, k), list(values))
    return b.build()


#: The training part that leaves no inner fold out.
WHOLE = -1


def searched(train: DataFrame, learner_name: str, features: Sequence[str], grid: dict, params: dict | None = None,
             label: str = "label", id_col: str = "id_anon", k_inner: int = 5, parallelism: int = 2, impute: Sequence[str] = (),
             smote_k: int | None = None, kept: bool = False) -> Model:
    """The best model of the grid by AUC over the folds of column ``inner_fold``, refitted on all of ``train``.

    With ``smote_k`` the minority of every training part is filled up by SMOTE (``with_synthetic``), once for all points;
    otherwise rows are weighted by class.  Medians and scales of all training parts come from one count
    (``impute.fold_fits``), ``parallelism`` models are fitted at the same time, and one grouped job gives all AUCs.
    ``kept`` tells that ``train`` is read from memory already.  The histogram boosters have no MLlib parameters: search them by ``search.search_cv``.
    """
    if learner_name in ("weighted_boosting", "balanced_boosting"):
        raise TypeError(f"{learner_name} is searched by search.search_cv")
    if learner_name == "gaussian_nb" and smote_k is not None:
        raise ValueError("gaussian_nb reads columns, not vectors: not with SMOTE")
    folds = list(range(k_inner))
    rows = train.select(*dict.fromkeys([*([id_col] if smote_k is not None else []), *features, *impute, label, "inner_fold"]))
    rows = rows if kept else rows.cache()
    try:
        counts = {(r["inner_fold"], r[label]): r["count"] for r in rows.groupBy("inner_fold", label).count().collect()}
        sizes = {f: {y: sum(n for (g, z), n in counts.items() if z == y and g != f) for y in {y for _, y in counts}} for f in [*folds, WHOLE]}
        total = sum(counts.values())
        if {f for f, _ in counts} != set(folds) or any(not sum(own.values()) for own in sizes.values()):
            raise ValueError(f"inner folds must be 0 to {k_inner - 1}, none of them empty or all of the rows")
        n = total if smote_k is None else 2 * max(sizes[WHOLE].values())
        weight = class_weight(sizes[WHOLE], learner_name, label) if smote_k is None else None
        fits = fold_fits(rows, features, impute, "inner_fold", [*folds, WHOLE])
        join = assembler(features)
        if learner_name == "gaussian_nb":
            learner = GaussianNBSmoothed(features, label, (params or {}).get("var_smoothing", 1e-9))
        else:
            learner = make_learner(learner_name, params, label=label, weight=None if weight is None else "weight", n_features=len(features),
                                   sum_weights=float(n))
        points = param_grid(learner, learner_name, grid, n) if grid else [{}]

        def ready(f):
            return apply_robust_scale(apply_fill(rows, fits[f]["fills"]), {c: fits[f]["scale"][c] for c in features})

        def part(f):
            own = ready(f).where(F.col("inner_fold") != f)
            if smote_k is not None:
                own = with_synthetic(own, features, label, id_col, sizes[f], smote_k)
            elif weight is not None:
                own = own.withColumn("weight", weight)
            return join.transform(dealt(own, learner_name, sum(sizes[f].values()) if smote_k is None else 2 * max(sizes[f].values())))

        def scored(job):
            f, i = job
            found = learner.fit(parts[f], points[i]).transform(join.transform(ready(f).where(F.col("inner_fold") == f)))
            score = F.col("score") if learner_name == "gaussian_nb" else vector_to_array("rawPrediction")[1]
            return found.select(F.lit(f).alias("_part"), F.lit(i).alias("_point"), F.col(label).alias("label"), score.alias("score"))

        parts = dict(zip([*folds, WHOLE], concurrently(part, [*folds, WHOLE], parallelism)))
        best = 0
        if len(points) > 1:
            every = concurrently(scored, [(f, i) for f in folds for i in range(len(points))], parallelism)
            aucs = metrics.roc_auc(functools.reduce(DataFrame.unionByName, every), "score", "label", ["_part", "_point"], len(every)).collect()
            # a part of one class tells nothing about the points; means of equal AUCs may differ in the last bit
            means = np.zeros(len(points))
            for r in sorted(aucs, key=lambda r: (r["_point"], r["_part"])):
                means[r["_point"]] += (r["auc"] or 0.0) / k_inner
            best = int(np.argmax(np.round(means, 12)))
        model = learner.fit(parts[WHOLE], points[best])
        return PipelineModel([*([MedianImputeExactModel(fits[WHOLE]["fills"])] if impute else []),
                              RobustScaleIQRModel({c: fits[WHOLE]["scale"][c] for c in features}),
                              *([] if learner_name == "gaussian_nb" else [join]), model])
    finally:
        if not kept:
            rows.unpersist()


@releases_caches
def nested_cv(df: DataFrame, learner_name: str, features: Sequence[str], grid: dict, params: dict | None = None,
              model: str = "M", label: str = "label", id_col: str = "id_anon", k_outer: int = 5, k_inner: int = 5,
              parallelism: int = 2, impute: Sequence[str] = (), smote_k: int | None = None) -> DataFrame:
    """Outer k folds; inner search (``searched``) on exact stratified inner folds; refit; score outer fold.

    An outer fold that can't be fitted scores AUC 0.5 and precision/recall/F1 0, as in the
    reference; ``n_failed`` tells how many did. Errors other than fit errors are raised.
    """
    base = _cache(resample.inner_folds(df, label, id_col, "fold", k_outer, k_inner, seed=7, out="_inner"))
    n, n_ids = base.agg(F.count(F.lit(1)), F.count_distinct(id_col)).first()
    own_ids = n == n_ids
    if not own_ids:  # rows of one id meet the inner folds of each other; a null id meets none
        inner = _cache(base.select(F.posexplode("_inner").alias("outer_fold", "inner_fold"), id_col).where(F.col("inner_fold").isNotNull()))
    # a fit keeps its rows in memory: so few at a time that they have room
    outer_at_once = at_once(n, k_outer)
    inner_at_once = at_once(n * outer_at_once, parallelism)

    def outer(f):
        if own_ids:
            train = base.withColumn("inner_fold", F.col("_inner")[f]).where(F.col("inner_fold").isNotNull())
        else:
            train = base.join(inner.where(F.col("outer_fold") == f).select(id_col, "inner_fold"), id_col)
        try:
            best = searched(train, learner_name, features, grid, params, label, id_col, k_inner, inner_at_once, impute, smote_k, kept=own_ids)
            scored = _with_pred(positive_score(best.transform(base.where(F.col("fold") == f)), learner_name))
            return f, _cache(scored.select(id_col, F.lit(f).alias("fold"), label, "score", "pred"))
        except FIT_ERRORS:
            return f, None

    # outer folds are independent: fit them concurrently (each runs its own inner search)
    results = concurrently(outer, range(k_outer), outer_at_once)
    parts = [p for _, p in results if p is not None]
    failed = [f for f, p in results if p is None]
    if not parts:
        raise RuntimeError("every outer fit failed")
    preds = parts[0]
    for p in parts[1:]:
        preds = preds.unionByName(p)
    fm = fold_metrics(preds, label)
    if failed:
        spark = df.sparkSession
        fm = fm.unionByName(spark.createDataFrame([(f, 0.5, 0.0, 0.0, 0.0) for f in failed],
                                                  "fold int, auc double, precision double, recall double, f1 double"))
    return summarize_folds(fm, model, learner_name + ("+smote" if smote_k else "")).withColumn("n_failed", F.lit(len(failed)))


@releases_caches
def holdout_validate(df: DataFrame, learner_name: str, features: Sequence[str], params: dict | None = None,
                     model: str = "M", label: str = "label", split_col: str = "split", id_col: str = "id_anon",
                     n_boot: int = 1000, seed: int = 42, impute: Sequence[str] = (),
                     resampling: str = "exact") -> DataFrame:
    """Fit on train, score test; metrics with percentile intervals over B bootstrap resamples of the test rows.

    Resamples with one class only are skipped for AUC (``n_boot_effective``).  The caller
    chooses the ``resampling``, and the result names it: "exact" draws n rows with replacement, "poisson"
    gives each test row a Poisson(1) weight per replicate (sizes then vary around n).  Neither copies rows.
    """
    if resampling not in ("exact", "poisson"):
        raise ValueError(f"resampling is exact or poisson, not {resampling}")
    scored = fit_score(df, split_col, learner_name, features, params, label, impute)
    preds = _cache(scored.select(id_col, label, "score", "pred"))
    draw = replicates.exact_draws if resampling == "exact" else replicates.poisson_draws
    drawn = draw(preds, id_col, n_boot, seed)
    auc = replicates.replicate_auc(drawn, "score", label)
    hm = metrics.holdout_rates(replicates.replicate_sums(drawn, metrics.confusion_flags("pred", label)), ["replicate"])
    per = hm.join(auc, "replicate", "left")
    cols = ["auc", "precision", "recall", "f1", "specificity", "accuracy", "npv", "ppv"]
    long = per.unpivot(["replicate"], cols, "metric", "value").where(F.col("value").isNotNull())
    pi = metrics.percentile_interval(long, "value", ["metric"])
    eff = long.groupBy("metric").agg(F.count(F.lit(1)).alias("n_boot_effective"))
    return pi.join(eff, "metric").select(F.lit(model).alias("model"), F.lit(learner_name).alias("algorithm"),
                                         "metric", "mean", "ci_lower", "ci_upper", "n_boot_effective",
                                         F.lit(resampling).alias("resampling"))


@releases_caches
def bootstrap_coefficients(df: DataFrame, features: Sequence[str], label: str = "label", id_col: str = "id_anon",
                           n_boot: int = 1000, C: float = 1.0, seed: int = 42) -> DataFrame:
    """Refit a ridge logistic regression on B exact resamples; percentile CI per coefficient.

    Every resample has its own medians, scales and balanced class weights; all are fitted
    together (``many_models.fit_replicates``).  Rows without a label of 0 or 1 take no part.  A resample
    of one class contributes the original coefficients (as the reference does); ``n_failed`` counts them.
    """
    spark = df.sparkSession
    rows = df.where(F.col(label).isin(0, 1)).select(id_col, label, *features)
    fits = fit_replicates(replicates.exact_draws(rows, id_col, n_boot, seed), features, label, C)
    coefs = np.where(fits.fitted[:, None], fits.coef, fits.coef[:1])
    report = [(f, *[round(float(v), 6) for v in (coefs[0, i], *np.quantile(coefs[1:, i], [0.025, 0.975]))], int((~fits.fitted[1:]).sum()))
              for i, f in enumerate(features)]
    return spark.createDataFrame(report, "feature string, coef double, ci_lower double, ci_upper double, n_failed int")


@releases_caches
def nonzero_selection(df: DataFrame, features: Sequence[str], label: str = "label", C: float = 0.1,
                      k: int = 5, tol: float = 1e-8, impute: Sequence[str] = ()) -> DataFrame:
    """Lasso per training fold (medians and scales of that fold's training rows); (fold, feature, coef) for coefficients above ``tol`` in absolute value."""
    spark = df.sparkSession
    cached = _cache(resample.balanced_weights(df, label))
    fits = fold_fits(cached, features, impute, "fold", range(k))
    sizes = {r["fold"]: r["count"] for r in cached.groupBy("fold").count().collect() if r["fold"] is not None}

    def one(f):
        n = sum(m for g, m in sizes.items() if g != f)
        ready = apply_robust_scale(apply_fill(cached, fits[f]["fills"]), {c: fits[f]["scale"][c] for c in features})
        pipe = Pipeline(stages=[assembler(features), make_learner("logreg_lasso", {"C": C}, weight="weight", sum_weights=float(n))])
        return pipe.fit(dealt(ready.where(F.col("fold") != f), "logreg_lasso", n)).stages[-1].coefficients.toArray()

    rows = [(f, feat, float(c)) for f, coefs in enumerate(concurrently(one, range(k), k)) for feat, c in zip(features, coefs) if abs(c) > tol]
    return spark.createDataFrame(rows, "fold int, feature string, coef double")


def expanded_features(base: DataFrame, extra: DataFrame, id_col: str, exclude_rules: dict,
                      max_categories: int = 20, fill_numeric: bool = True) -> DataFrame:
    """Base features + every valid extra column: numeric kept (median-imputed unless ``fill_numeric`` is off,
    for callers that impute within folds), strings with at most
    ``max_categories`` categories mode-imputed and one-hot encoded (first category dropped).

    Fitted values come from three small jobs: one HLL scan, one value-count pass over
    the low-cardinality strings (which gives their categories and modes), one median fit.
    """
    from pyspark.sql.types import NumericType, StringType

    from cohortlens.operators.impute import apply_fill, apply_robust_scale, fit_median, fold_fits
    from cohortlens.operators.profile import low_card_value_counts
    from cohortlens.operators.recode import one_hot
    from cohortlens.operators.select import candidate_column_list

    cand = candidate_column_list(extra.drop(id_col), exclude_rules)
    numeric = [c for c in cand if isinstance(extra.schema[c].dataType, NumericType)]
    strings = [c for c in cand if isinstance(extra.schema[c].dataType, StringType)]
    # the fits below read the joined matrix three times: write it once to the shared checkpoint folder
    from cohortlens.session import work_dir

    work_dir(base.sparkSession)
    x = base.join(extra.select(id_col, *numeric, *strings), id_col, "left").checkpoint()
    vc = low_card_value_counts(x, strings, max_categories)
    strings = [c for c in strings if vc[c] is not None]
    x = x.drop(*[c for c in cand if c not in numeric and c not in strings])
    fills = fit_median(x, numeric) if numeric and fill_numeric else {}
    for c in strings:
        # mode: highest count, ties to the smallest value; a column with no values gets "missing"
        fills[c] = min(vc[c].items(), key=lambda kv: (-kv[1], kv[0]))[0] if vc[c] else "missing"
    x = apply_fill(x, fills)
    for c in strings:
        x = one_hot(x, c, sorted(vc[c])[1:] if vc[c] else [])
    return x
