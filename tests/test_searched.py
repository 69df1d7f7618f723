"""Search over inner folds with shared preparations; passes of linear fits over small tables; the RBF features."""

import threading

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortlens.plans import catalog_models, learners
from cohortlens.plans import workflow as wf
from tests.conftest import SF0001


@pytest.fixture(scope="module")
def rows(spark):
    k = F.col("id")
    noise = (F.xxhash64("id") % 1000) / 1000.0
    return spark.range(900).select(
        k.alias("id_anon"), F.when(k % 7 != 0, noise + k % 5).alias("a"), (k % 11 + noise).alias("b"),
        (k % 5 + noise > 3.2).cast("int").alias("label"), (k % 3).cast("int").alias("inner_fold")).cache()


@pytest.mark.parametrize("smote_k", [None, 5])
def test_search_fits_all_parts_preparations_from_one_count(spark, rows, monkeypatch, smote_k):
    if smote_k is None:
        weighted = wf._with_weights(rows, "logreg_ridge", "label")
        direct = wf.build_pipeline("logreg_ridge", ["a", "b"], {"C": 100.0}, n_rows=900, impute=["a"]).fit(weighted)
    calls, fits = [], wf.fold_fits

    def fail(*args):
        raise AssertionError("a training part was counted by itself")

    monkeypatch.setattr(wf, "fit_median", fail)
    monkeypatch.setattr(learners, "fit_robust_scale", fail)
    monkeypatch.setattr(wf, "fold_fits", lambda *a: calls.append(a) or fits(*a))
    best = wf.searched(rows, "logreg_ridge", ["a", "b"], {"C": [100.0, 100.0]}, k_inner=3, impute=["a"], smote_k=smote_k)
    assert len(calls) == 1
    if smote_k is None:  # the model is a fit on all rows, with their own medians, scales and weights
        assert best.stages[0].fills == direct.stages[0].fills and best.stages[1].fitted == direct.stages[1].fitted
        assert np.allclose(best.stages[-1].coefficients.toArray(), direct.stages[-1].coefficients.toArray(), rtol=1e-4)


def test_search_wants_whole_inner_folds(rows):
    with pytest.raises(ValueError):
        wf.searched(rows.where("inner_fold < 2"), "logreg_ridge", ["a", "b"], {"C": [1.0]}, k_inner=3)


def test_small_training_parts_of_linear_fits_take_few_tasks(rows):
    spread = rows.repartition(16)
    assert wf.dealt(spread, "linear_svm", 900).rdd.getNumPartitions() == 1
    assert wf.dealt(spread, "linear_svm", 16 * wf.PASS_ROWS).rdd.getNumPartitions() == 16
    assert wf.dealt(spread, "random_forest", 900).rdd.getNumPartitions() == 16  # its draws depend on the partitions


def test_random_features_are_computed_by_blocks_of_rows(spark):
    x = np.random.default_rng(3).normal(size=(40, 3))
    rff = learners.RandomFourierFeatures("features", "rff", 6, 0.1, 3)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")
    out = rff.transform(df.select("i", array_to_vector("v").alias("features")))
    got = np.array([r.y for r in out.select(vector_to_array("rff").alias("y")).orderBy("i").collect()])
    assert np.allclose(got, np.sqrt(2 / 6) * np.cos(x @ rff.W.T + rff.b), atol=1e-12)
    assert "lambdafunction" not in out._jdf.queryExecution().toString()


def test_baseline_and_extended_fits_run_at_the_same_time(spark, monkeypatch):
    meet, fitted = threading.Barrier(4, timeout=60), wf.fold_predictions

    def met(*args, **options):
        meet.wait()  # broken if the four cases come one after another
        return fitted(*args, **options)

    monkeypatch.setattr(wf, "fold_predictions", met)
    assert catalog_models.q_baseline_vs_extended(spark, SF0001).count() == 4


def test_large_folds_are_fitted_one_after_another(rows, monkeypatch):
    assert wf.at_once(54_000_000, 5) == 1 and wf.at_once(120_000, 5) == 5
    workers, run = [], wf.concurrently
    monkeypatch.setattr(wf, "concurrently", lambda fn, items, n: workers.append(n) or run(fn, items, n))
    monkeypatch.setattr(wf, "ROWS_AT_ONCE", 1300)  # two training parts of 600 rows
    wf.fold_predictions(rows.withColumnRenamed("inner_fold", "fold"), "logreg_ridge", ["a", "b"], k=3, impute=["a"])
    assert workers == [2]
