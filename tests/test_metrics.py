"""AUC, Mann-Whitney, confusion metrics and intervals."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import metrics, ranking


def _pairs_auc(s, y):
    pos = [a for a, b in zip(s, y) if b == 1]
    neg = [a for a, b in zip(s, y) if b == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


@pytest.fixture
def scored(spark):
    rng = np.random.default_rng(5)
    s = np.round(rng.normal(size=400), 1)  # many ties
    y = (rng.random(400) < 1 / (1 + np.exp(-s))).astype(int)
    return spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int"), s, y


@pytest.mark.parametrize("large", [False, True])
def test_auc_matches_pairs(scored, monkeypatch, large):
    if large:
        monkeypatch.setattr(ranking, "SMALL_DISTINCT", 0)
    df, s, y = scored
    got = metrics.roc_auc(df, "s", "y").first().auc
    assert got == pytest.approx(_pairs_auc(s, y), abs=1e-12)


def test_auc_symmetry_and_monotone(scored):
    df, _, _ = scored
    a = metrics.roc_auc(df, "s", "y").first().auc
    neg = metrics.roc_auc(df.withColumn("s", -F.col("s")), "s", "y").first().auc
    mono = metrics.roc_auc(df.withColumn("s", F.exp("s") * 3 + 1), "s", "y").first().auc
    assert neg == pytest.approx(1 - a) and mono == pytest.approx(a)


def test_auc_one_class_is_null(spark):
    d = spark.createDataFrame([(1.0, 1), (2.0, 1)], "s double, y int")
    assert metrics.roc_auc(d, "s", "y").first().auc is None


def test_mann_whitney_against_formula(scored):
    df, s, y = scored
    r = metrics.mann_whitney(df, "s", "y").first()
    n1, n0 = int(y.sum()), int((1 - y).sum())
    u1 = _pairs_auc(s, y) * n1 * n0
    _, counts = np.unique(s, return_counts=True)
    n = n1 + n0
    sigma = math.sqrt(n1 * n0 / 12 * ((n + 1) - (counts ** 3 - counts).sum() / (n * (n - 1))))
    z = (max(u1, n1 * n0 - u1) - n1 * n0 / 2 - 0.5) / sigma
    p = math.erfc(z / math.sqrt(2))
    assert r.u == pytest.approx(u1, abs=1e-6)
    assert r.z == pytest.approx(z, abs=1e-6)
    assert r.p_value == pytest.approx(p, abs=2e-6)


def test_confusion_zero_division(spark):
    d = spark.createDataFrame([(0, 1), (0, 0)], "p int, y int")
    r = metrics.confusion_metrics(d, "p", "y").first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_holdout_one_class_cases(spark):
    only_neg = spark.createDataFrame([(0, 0), (1, 0)], "p int, y int")
    r = metrics.holdout_metrics(only_neg, "p", "y").first()
    assert (r.specificity, r.npv, r.ppv) == (1.0, 1.0, 0.0)
    only_pos = spark.createDataFrame([(0, 1), (1, 1)], "p int, y int")
    r = metrics.holdout_metrics(only_pos, "p", "y").first()
    assert (r.specificity, r.npv, r.ppv) == (0.0, 0.0, 1.0)


def test_t_quantiles():
    assert metrics.t_ppf(0.975, 4) == pytest.approx(2.7764451, abs=1e-7)
    assert metrics.t_ppf(0.975, 1) == pytest.approx(12.7062047, abs=1e-6)
    assert metrics.t_ppf(0.975, 30) == pytest.approx(2.0422725, abs=1e-7)


def test_t_interval_single_fold(spark):
    d = spark.createDataFrame([("a", 0.6), ("b", 0.5), ("b", 0.7)], "g string, v double")
    r = {x.g: x for x in metrics.t_interval(d, "v", ["g"]).collect()}
    assert r["a"].ci_lower == r["a"].ci_upper == 0.6
    half = 12.7062047 * math.sqrt(0.02) / math.sqrt(2)
    assert r["b"].ci_lower == pytest.approx(0.6 - half, abs=1e-5)


def test_univariate_auc_rules(spark):
    rows = [(float(i), None if i % 7 == 0 else "c" + str(i % 3), int(i % 4 == 0)) for i in range(60)]
    d = spark.createDataFrame(rows, "x double, cat string, y int")
    out = {r.feature: r for r in metrics.univariate_auc(d, "y", ["x"], ["cat"], min_n=55, min_pos=5).collect()}
    assert "x" in out and "cat" not in out  # cat has 51 complete rows < 55
    assert out["x"].auc_folded >= 0.5


def test_weighted_confusion_equals_replicated_rows(spark):
    rows = [(1, 1, 2), (0, 1, 1), (1, 0, 3), (0, 0, 1)]
    d = spark.createDataFrame(rows, "p int, y int, w int")
    weighted = metrics.holdout_metrics(d, "p", "y", weight_col="w").first()
    rep = spark.createDataFrame([(p, y) for p, y, w in rows for _ in range(w)], "p int, y int")
    plain = metrics.holdout_metrics(rep, "p", "y").first()
    for c in ("precision", "recall", "f1", "accuracy", "specificity", "npv", "ppv"):
        assert weighted[c] == pytest.approx(plain[c])


def test_weighted_auc_equals_replicated_rows(spark):
    rows = [(0.1, 0, 2), (0.4, 1, 1), (0.4, 0, 3), (0.9, 1, 2)]
    d = spark.createDataFrame(rows, "s double, y int, w int")
    rep = spark.createDataFrame([(s, y) for s, y, w in rows for _ in range(w)], "s double, y int")
    a = metrics.roc_auc(d, "s", "y", weight_col="w").first().auc
    assert a == pytest.approx(metrics.roc_auc(rep, "s", "y").first().auc)
