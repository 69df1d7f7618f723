"""Replicates as weight matrices against draws spelt out row by row."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import replicates as rp
from cohortlens.plans import many_models

B = 40


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 3000
    x = rng.normal(size=n)
    label = (rng.random(n) < 1 / (1 + np.exp(1.5 - x))).astype(int)
    hot = np.where(rng.random(n) < 0.4, 1.0, np.round(rng.normal(size=n), 2))  # a third and more of one value
    gaps = np.where(rng.random(n) < 0.3, None, 3 * x + rng.normal(size=n))
    p = pd.DataFrame({"id": range(n), "x": x, "hot": hot, "gaps": gaps.astype(object), "label": label})
    return spark.createDataFrame(p, "id long, x double, hot double, gaps double, label int").repartition(7).cache()


@pytest.fixture(scope="module")
def exact(table):
    return rp.exact_draws(table, "id", B, seed=9)


@pytest.fixture(scope="module")
def spelt(exact):
    """The rows with their whole weight matrix."""
    rows = exact.rows.orderBy("id").toPandas()
    weights = np.vstack([w for _, w in exact.plan.blocks([rows])])
    return rows, weights


def _drawn(spelt, b, col):
    rows, w = spelt
    v = np.repeat(rows[col].to_numpy(dtype=float), w[:, b].astype(int))
    return v[~np.isnan(v)]


def _auc(score, y):
    s = pd.Series(score).rank().to_numpy()
    n1 = y.sum()
    return (s[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_exact_draws_have_exactly_n_rows_and_poisson_like_counts(spelt):
    rows, w = spelt
    assert (w.sum(axis=0) == len(rows)).all()
    share = [(w == k).mean() for k in range(4)]
    assert np.allclose(share, np.exp(-1) / np.array([1, 1, 2, 6]), atol=0.01)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08  # replicates are drawn apart


def test_spread_of_replicate_means_is_the_standard_error(spelt):
    means = [_drawn(spelt, b, "x").mean() for b in range(B)]
    x = spelt[0]["x"].to_numpy()
    assert 0.6 < np.std(means) / (x.std() / np.sqrt(len(x))) < 1.5


def test_sums(exact, spelt):
    got = rp.replicate_sums(exact, {"n": F.lit(1), "gaps": F.col("gaps")}).orderBy("replicate").toPandas()
    assert got["replicate"].tolist() == list(range(1, B + 1))
    assert np.allclose(got["gaps"], [_drawn(spelt, b, "gaps").sum() for b in range(B)])


@pytest.mark.parametrize("score", ["x", "hot", "gaps"])
def test_auc(exact, spelt, score):
    got = rp.replicate_auc(exact, score, "label").orderBy("replicate").toPandas()["auc"]
    rows, w = spelt
    known = rows[score].notna().to_numpy()
    for b in range(B):
        n = np.where(known, w[:, b], 0).astype(int)
        assert got[b] == pytest.approx(_auc(np.repeat(rows[score].to_numpy(dtype=float), n), np.repeat(rows["label"].to_numpy(), n)), abs=1e-12)


def test_auc_by_key_with_original(table):
    long = table.select("id", "label", F.explode(F.create_map(F.lit("x"), F.col("x"), F.lit("hot"), F.col("hot"))).alias("feature", "score"))
    got = rp.replicate_auc(rp.poisson_draws(long, "id", 3).with_original(), "score", "label", "feature")
    own = {r["feature"]: r["auc"] for r in got.where("replicate = 0").collect()}
    p = table.toPandas()
    assert own == {f: pytest.approx(_auc(p[f].to_numpy(), p["label"].to_numpy()), abs=1e-12) for f in ("x", "hot")}
    assert got.count() == 8


def test_one_class_and_empty_tables(spark, table):
    one = table.where("label = 1").limit(50)
    assert rp.replicate_auc(rp.exact_draws(one, "id", 4), "x", "label").where("auc IS NULL").count() == 4
    assert rp.replicate_auc(rp.exact_draws(one.limit(0), "id", 4), "x", "label").count() == 0
    single = rp.replicate_sums(rp.exact_draws(one.limit(1), "id", 4), {"n": F.lit(1)}).toPandas()
    assert single["n"].tolist() == [1.0] * 4


def test_quantiles(exact, spelt):
    draws = exact.with_original()
    wanted, want = {}, {}
    for i, col in enumerate(("x", "hot", "gaps")):
        drawn = [spelt[0][col].dropna().astype(float).to_numpy()] + [_drawn(spelt, b, col) for b in range(B)]
        ranks = np.array([[0.25 * (len(v) - 1) // 1, len(v) - 1, -1, len(v)] for v in drawn]).T
        wanted[i] = (col, ranks)
        want[i] = np.array([[np.sort(v)[int(r[0])], v.max(), -np.inf, np.inf] for v, r in zip(drawn, ranks.T)]).T
    got = rp.values_at_ranks(draws, wanted)
    for i in want:
        assert (got[i] == want[i]).all()


def test_filled_quartiles(exact, spelt):
    cols = ["x", "hot", "gaps"]
    med, iqr = rp.filled_quartiles(exact, cols, np.full(B, float(len(spelt[0]))))
    for i, col in enumerate(cols):
        for b in range(B):
            v = _drawn(spelt, b, col)
            m = np.median(v)
            full = np.r_[v, np.full(len(spelt[0]) - len(v), m)]
            q = np.quantile(full, 0.75) - np.quantile(full, 0.25)
            assert med[i, b] == pytest.approx(m, abs=1e-12) and iqr[i, b] == pytest.approx(q or 1.0, abs=1e-12)


def test_gradient_of_every_fit_is_zero(exact, spelt):
    cols = ["x", "hot", "gaps"]
    fits = many_models.fit_replicates(exact, cols, "label", C=0.5)
    rows, w = spelt
    y = rows["label"].to_numpy()
    assert fits.fitted.all()
    for b in range(B + 1):
        own = np.ones(len(y)) if b == 0 else w[:, b - 1]
        x = rows[cols].to_numpy(dtype=float)
        z = (np.where(np.isnan(x), fits.medians[b], x) - fits.medians[b]) / fits.scales[b]
        n, n1 = own.sum(), own @ y
        weight = own * np.where(y == 1, n / (2 * n1), n / (2 * (n - n1)))
        p = 1 / (1 + np.exp(-(z @ fits.coef[b] + fits.intercept[b])))
        g = np.r_[0.5 * weight @ (p - y), 0.5 * (weight * (p - y)) @ z + fits.coef[b]]
        assert np.abs(g).max() < 1e-5


def test_one_class_replicates_keep_the_table_s_coefficients(spark):
    from cohortlens.plans import workflow as wf

    rows = [(i, float(i), 1 if i == 0 else 0) for i in range(20)]
    got = wf.bootstrap_coefficients(spark.createDataFrame(rows, "id long, x double, label int"), ["x"], id_col="id", n_boot=30).collect()
    assert 0 < got[0]["n_failed"] < 30 and got[0]["ci_lower"] <= got[0]["coef"] <= got[0]["ci_upper"]


def test_counts_equal_the_polynomial_in_whole_numbers():
    plan = rp.Plan(7, 3, 0.9)
    a, cuts = plan.coefficients(), plan.cuts()
    keys = np.array([0, 1, 2, 12345, rp.PRIME - 2, rp.PRIME - 1], dtype=np.uint64)
    for h, row in zip(keys.tolist(), rp._counts(keys, a, cuts)):
        x = [(((int(a[3][b]) * h + int(a[2][b])) * h + int(a[1][b])) * h + int(a[0][b])) % rp.PRIME for b in range(7)]
        assert row.tolist() == [sum(v >= c for c in cuts) for v in x]


def test_replicates_start_from_the_table_s_fit(exact, monkeypatch):
    """Few scans weigh the rows by all replicates, and few of them sum Hessians."""
    scans, sums = [], many_models._sums
    monkeypatch.setattr(many_models, "_sums", lambda rows, plan, n, theta, cw, curved=True: scans.append((len(theta), curved)) or sums(
        rows, plan, n, theta, cw, curved))
    many_models.fit_replicates(exact, ["x", "gaps"], "label", 1.0)
    whole = [curved for n, curved in scans if n > 1]
    assert len(whole) <= 12 and sum(whole) <= 4, whole


def test_features_of_few_values_are_weighed_once(spark, monkeypatch):
    """The intervals are those of the sorted rows; only features of many values are sorted."""
    from cohortlens.operators import metrics

    k = F.col("id")
    rows = spark.range(700).select(
        k.alias("i"), F.when(k % 9 != 0, k % 5 - 2.0).alias("few"), F.when(k % 4 == 0, F.lit(float("nan"))).otherwise(k % 3 * -0.0).alias("odd"),
        (F.xxhash64("id") % 1000).cast("double").alias("many"), F.when(k % 11 != 0, F.concat(F.lit("c"), (k % 6).cast("string"))).alias("cat"),
        F.when(k % 13 != 0, (F.xxhash64("id", F.lit(2)) % 3 == 0).cast("int")).alias("y")).cache()
    sorted_rows, real = [], rp.replicate_auc

    def watched(draws, score, label, key):
        sorted_rows.append({r[0] for r in draws.rows.select(key).distinct().collect()})
        return real(draws, score, label, key)

    monkeypatch.setattr(rp, "replicate_auc", watched)
    run = lambda: metrics.univariate_auc(rows, "y", ["few", "odd", "many"], ["cat"], n_boot=40, id_col="i").orderBy("feature").collect()
    got = run()
    monkeypatch.setattr(metrics, "FEW_SCORES", 0)
    assert got == run() and len(got) == 4 and all(r.ci_lower is not None for r in got)
    assert sorted_rows == [{"many"}, {"few", "odd", "many", "cat"}]
