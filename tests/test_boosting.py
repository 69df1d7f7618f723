"""Second-order boosting against a plain exhaustive version, and its behaviour on a signal that needs two features."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlens.plans import boosting
from cohortlens.plans.learners import make_learner

LAMBDA = 1.0


def brute_force(x, y, w, rounds, step, max_depth, max_leaves):
    """Margins by exhaustive search on the raw values, one leaf split at a time."""
    m = np.full(len(y), np.log((w * y).sum() / (w * (1 - y)).sum()))
    roots = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m))
        g, h = w * (p - y), w * p * (1 - p)
        part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + LAMBDA)

        def best(rows):
            found = (0.0, None, None)
            for j in range(x.shape[1]):
                for t in np.unique(x[rows, j][~np.isnan(x[rows, j])]):
                    for missing_left in (True, False):
                        left = np.where(np.isnan(x[rows, j]), missing_left, x[rows, j] <= t)
                        a, b = rows[left], rows[~left]
                        if len(a) and len(b) and 0.5 * (part(a) + part(b) - part(rows)) > found[0] + 1e-12:
                            found = (0.5 * (part(a) + part(b) - part(rows)), a, b)
            return found

        leaves = [(np.arange(len(y)), 0)]
        while len(leaves) < max_leaves:
            options = [(best(rows) if d < max_depth else (0.0, None, None), i) for i, (rows, d) in enumerate(leaves)]
            (gain, a, b), i = max(options, key=lambda o: o[0][0])
            if gain <= 0:
                break
            if len(leaves) == 1:
                roots.append(gain)
            d = leaves.pop(i)[1] + 1
            leaves += [(a, d), (b, d)]
        for rows, _ in leaves:
            m[rows] -= step * g[rows].sum() / (h[rows].sum() + LAMBDA)
    return m, roots


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, size=(300, 3)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 3) | (rng.random(300) < 0.1)).astype(float)
    x[rng.random(300) < 0.15, 0] = np.nan
    x[:, 2] = np.where(rng.random(300) < 0.1, np.nan, x[:, 2])
    return x, y, np.where(y == 1, 3.0, 1.0)


def frame(spark, x, y, w):
    rows = [(i, [float(v) for v in r], int(c), float(u)) for i, (r, c, u) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "id long, x array<double>, label int, weight double").withColumn("features", array_to_vector("x"))


@pytest.mark.parametrize("max_depth,max_leaves,rounds", [(3, 4, 12), (2, 4, 3)])
def test_equals_exhaustive_search(spark, small, monkeypatch, max_depth, max_leaves, rounds):
    x, y, w = small
    monkeypatch.setattr(boosting, "REWRITE", 5)
    df = frame(spark, x, y, w).repartition(4, "id")
    model = boosting.HistogramBooster(weightCol="weight", maxIter=rounds, stepSize=0.3, maxDepth=max_depth, max_leaves=max_leaves,
                                      reg_lambda=LAMBDA).fit(df)
    got = np.array([r.score for r in model.transform(df).orderBy("id").collect()])
    margins, roots = brute_force(x, y, w, rounds, 0.3, max_depth, max_leaves)
    assert np.allclose([t.splits[0].gain for t in model.trees], roots, rtol=1e-9)
    assert np.allclose(got, 1 / (1 + np.exp(-margins)), atol=1e-9)
    assert all(len(t.values) <= max_leaves for t in model.trees)


@pytest.fixture(scope="module")
def smooth():
    """Continuous features; the label follows an interaction of two and a third one's slope."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 4))
    return x, (rng.random(2000) < 1 / (1 + np.exp(2 - 4 * ((x[:, 0] > 0) & (x[:, 1] > 0)) - x[:, 2]))).astype(float)


def test_at_least_as_good_as_first_order_trees(spark, smooth):
    df = frame(spark, *smooth, np.ones(2000)).cache()
    train, test = df.where("id % 3 <> 0"), df.where("id % 3 = 0")
    auc = lambda scored, col: BinaryClassificationEvaluator(rawPredictionCol=col, numBins=0).evaluate(scored)
    ours = make_learner("weighted_boosting", {"maxIter": 15, "stepSize": 0.2}, weight=None).fit(train).transform(test)
    theirs = GBTClassifier(maxIter=15, stepSize=0.2, maxDepth=3, seed=1).fit(train).transform(test)
    assert auc(ours, "score") >= auc(theirs, "rawPrediction") - 0.005


def test_binned_root_is_nearly_the_best_of_all_thresholds(spark, smooth):
    x, y = smooth
    model = boosting.HistogramBooster(maxIter=1, maxDepth=1, reg_lambda=LAMBDA).fit(frame(spark, x, y, np.ones(2000)))
    (best,) = brute_force(x, y, np.ones(2000), 1, 0.1, 1, 2)[1]
    assert 0.95 * best <= model.trees[0].splits[0].gain <= best + 1e-9


def test_weights_count_as_rows(spark, small):
    x, y, _ = small
    w = 1.0 + (np.arange(len(y)) % 2)
    one = boosting.HistogramBooster(weightCol="weight", maxIter=2).fit(frame(spark, x, y, w))
    again = np.repeat(np.arange(len(y)), w.astype(int))
    two = boosting.HistogramBooster(maxIter=2).fit(frame(spark, x[again], y[again], w[again]))
    df = frame(spark, x, y, w)
    score = lambda m: [r.score for r in m.transform(df).orderBy("id").collect()]
    assert np.allclose(score(one), score(two), atol=1e-9)


def test_odd_tables(spark, small):
    x, y, w = small
    df = frame(spark, x, y, w)
    for rows in (df.where("label = 1"), df.where("false"), df.withColumn("label", F.lit(None).cast("int"))):
        with pytest.raises(ValueError):
            boosting.HistogramBooster().fit(rows)
    flat = frame(spark, np.ones((20, 2)), np.arange(20) % 2, np.ones(20))
    model = boosting.HistogramBooster(maxIter=3).fit(flat)  # nothing to split by: the share of label 1
    assert model.trees == [] and {round(r.score, 9) for r in model.transform(flat).collect()} == {0.5}
    lost = frame(spark, np.full((20, 1), np.nan), np.arange(20) % 4 == 0, np.ones(20))
    assert {round(r.score, 9) for r in boosting.HistogramBooster(maxIter=3).fit(lost).transform(lost).collect()} == {0.25}
    with pytest.raises(ValueError):
        boosting.HistogramBooster(bins=300)


def test_plan_splits_the_best_leaf_first():
    s = lambda gain: boosting.Split(gain, 0, 1, True, (0.0, 1.0), (0.0, 1.0))
    evaluated, children, depth = {0: s(5.0)}, {}, {0: 0}
    assert boosting.plan_leaves(evaluated, children, depth, 9, 4, 0.0) == ([0], [0])
    evaluated.update({1: s(1.0), 2: s(4.0)}), children.update({0: (1, 2)}), depth.update({1: 1, 2: 1})
    # node 2's children may gain more than node 1: its place is not sure before they are known
    assert boosting.plan_leaves(evaluated, children, depth, 9, 4, 0.0) == ([0, 2, 1], [2])
    evaluated.update({3: s(2.0), 4: None}), children.update({2: (3, 4)}), depth.update({3: 2, 4: 2})
    assert boosting.plan_leaves(evaluated, children, depth, 9, 4, 0.0) == ([0, 2, 3], [])
