"""Distributed exact quantiles / running totals / hash ranks against pandas (both code paths)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators import ranking


def _frame(spark):
    rng = np.random.default_rng(3)
    n = 3000
    x = rng.normal(size=n)
    x[: n // 3] = 1.5  # one value holds a third of all rows
    x[10:20] = np.nan
    y = rng.integers(0, 40, size=n).astype(float)
    y[30:60] = None
    pdf = pd.DataFrame({"id": np.arange(n), "x": x, "y": y, "g": rng.integers(0, 3, size=n)})
    return spark.createDataFrame(pdf).repartition(7), pdf


@pytest.mark.parametrize("large", [False, True])
def test_exact_quantiles_match_pandas(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(ranking, "SMALL_DISTINCT", 0)
    df, pdf = _frame(spark)
    probs = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]
    got = {(r.feature, r.p): r.q for r in ranking.exact_quantiles(df, ["x", "y"], probs).collect()}
    for c in ["x", "y"]:
        s = pdf[c].dropna()
        for p in probs:
            assert got[(c, p)] == pytest.approx(float(s.quantile(p, interpolation="linear")), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("large", [False, True])
def test_grouped_quantiles(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(ranking, "SMALL_DISTINCT", 0)
    df, pdf = _frame(spark)
    got = {(r.g, r.p): r.q for r in ranking.exact_quantiles(df, ["y"], [0.5], by=["g"]).collect()}
    for g, part in pdf.groupby("g"):
        assert got[(g, 0.5)] == pytest.approx(float(part["y"].dropna().median()))


@pytest.mark.parametrize("large", [False, True])
def test_running_totals(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(ranking, "SMALL_DISTINCT", 0)
    df, pdf = _frame(spark)
    counts = df.where(F.col("y").isNotNull()).groupBy("g", "y").agg(F.count(F.lit(1)).alias("c"))
    rt = ranking.running_totals(counts, ["g"], "y", ["c"], n_buckets=8).toPandas()
    exp = (pdf.dropna(subset=["y"]).groupby(["g", "y"]).size().rename("c").reset_index()
           .sort_values(["g", "y"]))
    exp["cum"] = exp.groupby("g")["c"].cumsum()
    m = rt.merge(exp, on=["g", "y"])
    assert len(m) == len(exp)
    assert (m["_cum_c"] == m["cum"]).all()


def test_rank_by_hash_equals_window(spark):
    from cohortlens.functions.hashing import portable_hash

    df, _ = _frame(spark)
    h = df.withColumn("h", portable_hash(42, "id"))
    a = ranking.rank_by_hash(h, ["g"], "h", "id", rows_per_bucket=16).select("id", "_pos")
    w = Window.partitionBy("g").orderBy("h", "id")
    b = h.select("id", (F.row_number().over(w) - 1).alias("_pos"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_ordered_positions_strings(spark):
    words = ["pear", "apple", "fig", "kiwi", "date", "banana", "cherry", "lime", "plum", "grape"] * 1
    d = spark.createDataFrame([(w,) for w in words], "w string").repartition(4)
    got = {r.w: r._pos for r in ranking.ordered_positions(d, "w", n_parts=3).collect()}
    assert got == {w: i for i, w in enumerate(sorted(words))}


def test_top_k_others_ties(spark):
    from cohortlens.operators.profile import top_k_others

    d = spark.createDataFrame([(c,) for c in "aabbccddde"], "c string")
    got = {r.category: (r.n, r.rank) for r in top_k_others(d, "c", 2).collect()}
    assert got == {"d": (3, 1), "a": (2, 2), "others": (5, 3)}


def test_count_below_matches_linear(spark):
    import random

    rnd = random.Random(4)
    rows = []
    for n in (0, 1, 5, 37, 200):
        bounds = sorted(rnd.uniform(-5, 5) for _ in range(n))
        bounds[n // 2: n // 2] = [bounds[n // 2]] * 3 if n else []  # repeated bounds
        for v in [-6.0, 6.0] + [rnd.uniform(-5, 5) for _ in range(20)] + bounds[:3]:
            rows.append((bounds, v, sum(1 for b in bounds if b < v), len(bounds)))
    d = spark.createDataFrame(rows, "b array<double>, v double, exp int, n int")
    for n in sorted({r[3] for r in rows}):
        sub = d.where(F.col("n") == n)
        got = sub.select((ranking.count_below(F.col("b"), F.col("v"), n) == F.col("exp")).alias("ok")).collect()
        assert all(r.ok for r in got), n


@pytest.mark.parametrize("large", [False, True])
def test_partition_count_invariance(spark, monkeypatch, large):
    from cohortlens.operators import metrics

    if large:
        monkeypatch.setattr(ranking, "SMALL_DISTINCT", 0)
    df, _ = _frame(spark)
    df = df.withColumn("y01", (F.col("g") == 1).cast("int"))
    outs = []
    for n in (2, 13):
        d = df.repartition(n)
        q = sorted((r.feature, r.p, r.q) for r in ranking.exact_quantiles(d, ["x", "y"], [0.1, 0.5, 0.9]).collect())
        a = metrics.roc_auc(d, "x", "y01").first().auc
        outs.append((q, a))
    assert outs[0] == outs[1]


@pytest.mark.parametrize("small", [True, False])
def test_null_groups_and_nan_scores_on_both_paths(spark, monkeypatch, small):
    """The bucketed path keeps NULL groups and leaves NaN scores out, as the windowed one does."""
    from cohortlens.operators import metrics

    if not small:
        monkeypatch.setattr(ranking, "SMALL_DISTINCT", 0)
    df = spark.range(600).selectExpr(
        "CASE WHEN id % 3 < 2 THEN id % 3 END AS g", "CASE WHEN id % 50 = 0 THEN double('NaN') ELSE double(id * 37 % 101) END AS s",
        "CAST(id % 7 = 0 AS INT) AS y")
    q = {(r.g, r.p): r.q for r in ranking.exact_quantiles(df, ["s"], [0.25, 0.5], by=["g"]).collect()}
    pdf = df.toPandas()
    for g in (0, 1, None):
        part = pdf[pdf.g.isna() if g is None else pdf.g == g].s.dropna()
        assert q[(g, 0.25)] == pytest.approx(part.quantile(0.25)) and q[(g, 0.5)] == pytest.approx(part.quantile(0.5))
    for keys in ([], ["g"]):
        rows = metrics.roc_auc(df, "s", "y", keys).collect()
        assert len(rows) == (3 if keys else 1)
        for r in rows:
            part = pdf if not keys else pdf[pdf.g.isna() if r.g is None else pdf.g == r.g]
            part = part[part.s.notna()]
            pos, neg = part[part.y == 1].s.to_numpy(), part[part.y == 0].s.to_numpy()
            wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
            assert r.auc == pytest.approx(wins / (len(pos) * len(neg)))
    iv = metrics.percentile_interval(df.where("not isnan(s)"), "s", ["g"]).collect()
    assert {r.g for r in iv} == {0, 1, None}
