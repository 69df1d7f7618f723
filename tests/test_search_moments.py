"""Naive Bayes jobs of the search: one count of moments gives the fits of all parts and points."""

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from cohortlens.plans import learners, search


def test_fits_from_shared_moments_equal_fits_on_filled_and_scaled_rows(spark, monkeypatch):
    rng, n = np.random.default_rng(3), 500
    d = pd.DataFrame({"id_anon": np.arange(n), "a": rng.normal(5, 3, n), "b": rng.random(n), "label": rng.integers(0, 2, n), "inner_fold": rng.integers(0, 3, n)})
    rows = spark.createDataFrame(d).withColumn("b", F.when(F.col("id_anon") % 4 > 0, F.col("b"))).withColumn("c", F.lit(2.0)).cache()
    calls, whole = [], learners.nb_moments
    monkeypatch.setattr(search, "nb_moments", lambda *a: calls.append(1) or whole(*a))
    parts = search._Parts(rows, ["a", "b", "c"], ["b"], "label", "inner_fold", range(3))
    for k in range(3):
        for smoothing in (1e-9, 1e-2):
            got = parts.naive_bayes(k, smoothing)
            want = learners.fit_gaussian_nb(parts.ready(k).where(F.col("inner_fold") != k), ["a", "b", "c"], "label", smoothing)
            for cls, w in want["classes"].items():
                g = got["classes"][cls]
                assert np.isclose(g["prior"], w["prior"])
                for c in "abc":
                    assert np.isclose(g["mean"][c], w["mean"][c], atol=1e-12) and np.isclose(g["var"][c], w["var"][c])
    assert len(calls) == 1
