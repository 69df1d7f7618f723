"""Exact quantiles by rank brackets and fold fits by subtraction, against numpy."""

import math
import random

import numpy as np
import pytest

from cohortlens.operators import impute, metrics, neighbors, profile, ranking


def table(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, float("nan"), rng.gauss(0, 1), 7.0]), float(rng.randrange(4)), None, rng.random() ** 9, i % 5) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, x double, few double, none double, skew double, fold int")


def values(rows, i, keep=lambda r: True):
    return np.array([r[i] for r in rows if keep(r) and r[i] is not None and not math.isnan(r[i])])


@pytest.mark.parametrize("accuracy,limit", [(2000, 1_000_000), (10, 20), (3, 1)])
def test_brackets_match_numpy(spark, accuracy, limit):
    rows, df = table(spark)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(f, p): q for f, p, q in ranking.bracket_quantiles(df, ["x", "few", "none", "skew"], probs, accuracy, limit)}
    want = {(c, p): np.quantile(values(rows, i), p) for i, c in ((1, "x"), (2, "few"), (4, "skew")) for p in probs}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-12) for k in want)


def test_brackets_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, math.inf), (2.0, -math.inf), (None, 0.0)], "a double, b double")
    assert dict((f, q) for f, _, q in ranking.bracket_quantiles(df, ["a", "b"], [0.5])) == {"a": 1.5, "b": 0.0}
    assert ranking.bracket_quantiles(df.limit(0), ["a", "b"], [0.5]) == []
    assert ranking.bracket_quantiles(df, [], [0.5]) == []


def test_brackets_shuffle_few_values(spark, monkeypatch):
    """Of a million distinct values at most 1 % are counted by value."""
    df, seen = spark.range(1_000_000).selectExpr("cast(xxhash64(id) as double) as v"), []
    inside = ranking._ranked_inside
    monkeypatch.setattr(ranking, "_ranked_inside", lambda d, b, v: seen.append(sum(s["inside"] for s in b)) or inside(d, b, v))
    got = ranking.bracket_quantiles(df, ["v"], [0.25, 0.5, 0.75])
    x = np.array([r[0] for r in df.collect()])
    assert [q for *_, q in sorted(got)] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.75]).tolist())
    assert seen and seen[0] <= 10_000


@pytest.mark.parametrize("large", [False, True])
def test_fold_fits_match_fits_of_each_training_part(spark, monkeypatch, large):
    rows, df = table(spark, 1500)
    if large:
        monkeypatch.setattr(ranking, "SMALL_DISTINCT", 0)
    got = impute.fold_fits(df, ["x", "few", "none", "skew"], ["x", "none"], "fold", range(5))
    for k in range(5):
        part = lambda r: r[5] != k
        med = np.median(values(rows, 1, part))
        filled = [r[1] if r[1] is not None and not math.isnan(r[1]) else med for r in rows if part(r)]
        for c, x in (("x", filled), ("few", values(rows, 2, part)), ("skew", values(rows, 4, part))):
            q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
            assert got[k]["scale"][c] == pytest.approx((q2, (q3 - q1) or 1.0))
        assert got[k]["fills"] == {"x": pytest.approx(med), "none": None} and got[k]["scale"]["none"] == (0.0, 1.0)


def test_cross_impute_fills_every_row_once(spark):
    rows, df = table(spark, 500)
    out = impute.cross_impute(df, "fold", range(5), ["x"]).collect()
    assert len(out) == 500 and all(r.x is not None for r in out)


def test_defined_results_instead_of_crashes(spark):
    empty = spark.createDataFrame([], "v double, w double, label int, g string, vec array<double>, id long")
    odd = spark.createDataFrame([(None, 3.0, 1, "a", [1.0], 1), (None, 3.0, 0, "a", None, 2), (None, 3.0, 1, "b", [2.0], 3)], empty.schema)
    two = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert metrics.mann_whitney(empty, "w", "label", ["g"]).count() == 0
    got = {r.g: r for r in metrics.mann_whitney(odd, "w", "label", ["g"]).collect()}
    assert got["a"].p_value is None and got["a"].u == 0.5 and (got["b"].n1, got["b"].n0, got["b"].p_value) == (1, 0, None)
    for df in (empty, odd):
        r = profile.iqr_outliers(df, "v").first()
        assert (r.feature, r.n_outliers, r.q1, r.pct_outliers) == ("v", 0, None, None)
        assert {r["feature"]: r["count"] for r in profile.numeric_profile(df, ["v", "w"]).collect()} == {"v": 0, "w": df.count()}
        assert {r.feature: r.n_missing for r in profile.missing_profile(df, ["v", "w"]).collect()} == {"v": df.count(), "w": 0}
        assert profile.skewness_check(df, ["v", "w"]).where("skewness is not null").count() == 0
    assert [(r.skewness, r.band) for r in profile.skewness_check(two, ["v"]).collect()] == [(None, "low")]
    parts = spark.createDataFrame([("a", "train"), ("b", "train")], "c string, s string")
    assert [(r.pct_train, r.pct_test, r.status) for r in profile.proportion_drift(parts, "c", "s").collect()] == [(50.0, None, "DRIFT")] * 2


def test_knn_leaves_out_rows_without_a_vector(spark):
    schema = "id long, vec array<double>, label int"
    train = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, None, 1), (3, [5.0, 5.0], 1), (4, [0.0, None], 1)], schema)
    test = spark.createDataFrame([(10, [0.1, 0.0], 0), (11, None, 0), (12, [9.0, 9.0], 1)], schema)
    got = {r["id"]: r["pred"] for r in neighbors.knn_classify(train, test, 1, "id", "vec", "label").select("id", "pred").collect()}
    assert got == {10: 0, 12: 1}
