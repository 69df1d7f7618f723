"""MLlib learner factory and the pieces MLlib lacks.

* ``RobustScaleIQR`` - exact median/IQR scaler as a Pipeline Estimator (IQR 0
  -> divide by 1; MLlib's RobustScaler zeroes such features and uses
  approximate quantiles).
* ``GaussianNBSmoothed`` - Gaussian naive Bayes with variance smoothing
  (``var_smoothing`` x the largest feature variance added to every variance),
  fitted with one grouped aggregate and applied as column expressions.
* ``RandomFourierFeatures`` - RBF-kernel approximation (Rahimi & Recht 2007)
  in front of ``LinearSVC`` for the RBF margin classifier.

All fits are Spark jobs; fitted values are small dicts turned into literals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.impute import apply_robust_scale, fit_robust_scale
from cohortlens.plans.boosting import HistogramBooster


class RobustScaleIQR(Estimator):
    """(x - median) / IQR on the listed columns, fitted on the rows passed to ``fit``."""

    def __init__(self, inputCols: Sequence[str] = ()):
        super().__init__()
        self.inputCols = list(inputCols)

    def _fit(self, dataset: DataFrame) -> "RobustScaleIQRModel":
        return RobustScaleIQRModel(fit_robust_scale(dataset, self.inputCols))


class RobustScaleIQRModel(Model):
    def __init__(self, fitted: dict | None = None):
        super().__init__()
        self.fitted = fitted or {}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return apply_robust_scale(dataset, self.fitted)


class RandomFourierFeatures(Transformer):
    """features -> sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U[0, 2 pi) (seeded)."""

    def __init__(self, inputCol: str = "features", outputCol: str = "rff", n_features: int = 50,
                 gamma: float = 0.1, dim: int = 1, seed: int = 42):
        super().__init__()
        self.inputCol, self.outputCol = inputCol, outputCol
        rng = np.random.default_rng(seed)
        self.W = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_features, dim))
        self.b = rng.uniform(0.0, 2.0 * math.pi, size=n_features)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        w, b, scale = self.W, self.b, math.sqrt(2.0 / len(self.b))

        @F.pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            rows = np.array([*x], dtype=np.float64).reshape(-1, w.shape[1])
            dot = np.zeros((len(rows), len(b)))
            for j in range(w.shape[1]):
                dot += rows[:, j, None] * w[:, j]
            return pd.Series([*(scale * np.cos(dot + b))])

        return dataset.withColumn(self.outputCol, array_to_vector(mapped(vector_to_array(F.col(self.inputCol)))))


class GaussianNBSmoothed(Estimator):
    """Gaussian NB with sklearn-style variance smoothing; outputs ``score`` = P(label = 1 | x)."""

    def __init__(self, featureCols: Sequence[str] = (), labelCol: str = "label", var_smoothing: float = 1e-9):
        super().__init__()
        self.featureCols, self.labelCol, self.var_smoothing = list(featureCols), labelCol, var_smoothing

    def _fit(self, dataset: DataFrame) -> "GaussianNBSmoothedModel":
        return GaussianNBSmoothedModel(fit_gaussian_nb(dataset, self.featureCols, self.labelCol, self.var_smoothing))


class GaussianNBSmoothedModel(Model):
    def __init__(self, fitted: dict | None = None):
        super().__init__()
        self.fitted = fitted or {}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return apply_gaussian_nb(dataset, self.fitted)


def fit_gaussian_nb(df: DataFrame, cols: Sequence[str], label: str, var_smoothing: float = 1e-9) -> dict:
    """Per-class priors, means and population variances (one grouped aggregate)."""
    whole = df.withColumn("_nb_fold", F.lit(0))
    return fit_gaussian_nb_folds(whole, "_nb_fold", [-1], cols, label, var_smoothing)[-1]


def _merged(parts: list[tuple[float, float, float]]) -> tuple[float, float, float]:
    """(count, mean, squared deviations) of several parts together."""
    n = mean = dev = 0.0
    for m, a, d in parts:
        if m:
            step = a - mean
            dev += d + step * step * n * m / (n + m)
            mean += step * m / (n + m)
            n += m
    return n, mean, dev


def fit_gaussian_nb_folds(df: DataFrame, fold_col: str, folds: Sequence[int], cols: Sequence[str], label: str,
                          var_smoothing: float = 1e-9) -> dict[int, dict]:
    """The fit of every fold's training part (all other folds), from one aggregate by (fold, class).

    Counts, means and squared deviations of the parts are put together on the
    driver: folds x classes x columns numbers, whatever the rows.
    """
    cells = nb_moments(df, fold_col, cols, label)
    return {k: nb_fit(cells, k, cols, var_smoothing) for k in folds}


def nb_moments(df: DataFrame, fold_col: str, cols: Sequence[str], label: str) -> list[tuple]:
    """(fold, class, rows, [(count, mean, squared deviations) of each column]) of every fold and class."""
    g = df.where(F.col(label).isin(0, 1)).groupBy(F.col(fold_col).alias("_fold"), F.col(label).alias("_cls")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[e for i, c in enumerate(cols) for e in (F.count(c).alias(f"n_{i}"), F.avg(c).alias(f"m_{i}"), F.var_pop(c).alias(f"v_{i}"))]).collect()
    return [(r["_fold"], r["_cls"], r["_n"], [(r[f"n_{i}"], r[f"m_{i}"] or 0.0, (r[f"v_{i}"] or 0.0) * r[f"n_{i}"]) for i in range(len(cols))]) for r in g]


def nb_fit(cells: Sequence[tuple], fold, cols: Sequence[str], var_smoothing: float = 1e-9, fills: dict | None = None,
           scale: dict | None = None) -> dict:
    """The fit of a fold's training part (all other folds) from ``nb_moments``.

    ``fills`` and ``scale`` give the fit of rows whose missing values are filled and whose columns are then scaled,
    (x - median) / IQR: both change the moments only.
    """
    def moments(rows: list, i: int) -> tuple[float, float, float]:
        fill = (fills or {}).get(cols[i])
        parts = [m for _, _, n, own in rows for m in (own[i], *([(n - own[i][0], fill, 0.0)] if fill is not None else []))]
        n, mean, dev = _merged(parts)
        middle, width = (scale or {}).get(cols[i], (0.0, 1.0))
        return n, (mean - middle) / width, dev / (width * width)

    rows = [r for r in cells if r[0] != fold]
    every = [moments(rows, i) for i in range(len(cols))]
    # features that never vary leave no scale of their own: the smoothing itself is the variance then
    eps = var_smoothing * max((d / n if n else 0.0) for n, _, d in every) or var_smoothing
    total, classes = sum(r[2] for r in rows), {}
    for cls in sorted({r[1] for r in rows}):
        own = [r for r in rows if r[1] == cls]
        found = [moments(own, i) for i in range(len(cols))]
        classes[cls] = {"prior": sum(r[2] for r in own) / total,
                        "mean": {c: (m[1] if m[0] else None) for c, m in zip(cols, found)},
                        "var": {c: (m[2] / m[0] if m[0] else 0.0) + eps for c, m in zip(cols, found)}}
    return {"cols": list(cols), "classes": classes}


def _nb_joint(fitted: dict, cls) -> Column:
    p = fitted["classes"][cls]
    expr = F.lit(math.log(p["prior"]))
    for c in fitted["cols"]:
        v, m = p["var"][c], p["mean"][c]
        dev = F.col(c) - F.lit(m)
        expr = expr - F.lit(0.5 * math.log(2.0 * math.pi * v)) - dev * dev / F.lit(2.0 * v)
    return expr


def apply_gaussian_nb(df: DataFrame, fitted: dict, out: str = "score") -> DataFrame:
    """score = P(class 1 | x) by the log-sum-exp of the two joint log-likelihoods."""
    missing = {0, 1} - set(fitted["classes"])
    if missing:  # a class that training never saw is never predicted
        return df.withColumn(out, F.lit(0.0 if 1 in missing else 1.0))
    j1, j0 = _nb_joint(fitted, 1), _nb_joint(fitted, 0)
    return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(j0 - j1)))


# ----------------------------------------------------------------------------- factory
def make_learner(name: str, params: dict | None = None, features: str = "features", label: str = "label",
                 weight: str | None = "weight", n_features: int = 1, sum_weights: float = 1.0):
    """MLlib estimator for a learner key of SURVEY 2.8 (``weight`` None -> unweighted)."""
    p = dict(params or {})
    common = {"featuresCol": features, "labelCol": label}
    if name in ("logreg_ridge", "logreg_lasso", "logreg_elastic"):
        C = p.get("C", 1.0)
        enet = {"logreg_ridge": 0.0, "logreg_lasso": 1.0}.get(name, p.get("l1_ratio", 0.5))
        # reference objective: 1/2 |w|^2 + C sum w_i loss_i;  MLlib: mean weighted loss + reg * penalty;
        # tolerance 1e-4 as the reference learner's default
        lr = LogisticRegression(**common, regParam=1.0 / (C * sum_weights), elasticNetParam=enet,
                                standardization=False, maxIter=p.get("maxIter", 100), tol=p.get("tol", 1e-4))
        return lr.setWeightCol(weight) if weight else lr
    if name == "random_forest":
        rf = RandomForestClassifier(**common, numTrees=p.get("numTrees", 100), maxDepth=p.get("maxDepth", 5),
                                    minInstancesPerNode=p.get("minInstancesPerNode", 1), seed=p.get("seed", 42))
        return rf.setWeightCol(weight) if weight else rf
    if name == "decision_tree":
        dt = DecisionTreeClassifier(**common, maxDepth=p.get("maxDepth", 5),
                                    minInstancesPerNode=p.get("minInstancesPerNode", 1), seed=p.get("seed", 42))
        return dt.setWeightCol(weight) if weight else dt
    if name == "gradient_boosting":
        return GBTClassifier(**common, maxIter=p.get("maxIter", 100), stepSize=p.get("stepSize", 0.1),
                             maxDepth=p.get("maxDepth", 3), seed=p.get("seed", 42))
    if name in ("weighted_boosting", "balanced_boosting"):
        return HistogramBooster(**common, weightCol=weight, maxIter=p.get("maxIter", 50), stepSize=p.get("stepSize", 0.1),
                                maxDepth=p.get("maxDepth", 3), max_leaves=p.get("max_leaves"), reg_lambda=p.get("reg_lambda", 1.0))
    if name == "linear_svm":
        svc = LinearSVC(**common, regParam=1.0 / (p.get("C", 1.0) * sum_weights), maxIter=p.get("maxIter", 50),
                        tol=p.get("tol", 1e-4), standardization=False)
        return svc.setWeightCol(weight) if weight else svc
    if name == "rbf_svm":
        rff = RandomFourierFeatures(features, "rff", p.get("n_components", 50), p.get("gamma", 0.1), n_features,
                                    p.get("seed", 42))
        svc = LinearSVC(featuresCol="rff", labelCol=label, regParam=1.0 / (p.get("C", 1.0) * sum_weights),
                        maxIter=p.get("maxIter", 50), tol=p.get("tol", 1e-4), standardization=False)
        if weight:
            svc = svc.setWeightCol(weight)
        return Pipeline(stages=[rff, svc])
    if name == "mlp":
        hidden = list(p.get("hidden", [64]))
        return MultilayerPerceptronClassifier(**common, layers=[n_features, *hidden, 2],
                                              maxIter=p.get("maxIter", 500), seed=p.get("seed", 42))
    raise KeyError(name)


def positive_score(df: DataFrame, learner_name: str) -> DataFrame:
    """``score`` column: probability of class 1, or the raw margin for margin classifiers."""
    if learner_name in ("linear_svm", "rbf_svm"):
        return df.withColumn("score", vector_to_array("rawPrediction")[1])
    if "probability" in df.columns:
        return df.withColumn("score", vector_to_array("probability")[1])
    return df


def assembler(cols: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep")
