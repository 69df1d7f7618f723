"""Learners: rows check plus planted-signal and shuffled-label behaviour."""

import pytest
from pyspark.sql import functions as F

from cohortlens.plans import fixtures as fx
from cohortlens.plans import workflow as wf
from tests.conftest import SF001


@pytest.fixture(scope="module")
def table(spark):
    f = fx.folds(spark, SF001).select("id_anon", "zimc", "x1", "label", "fold")
    # a shuffled label: hash-chosen, unrelated to the features
    return f.withColumn("noise", (F.xxhash64("id_anon") % 5 == 0).cast("int")).cache()


def _auc(res):
    return {r.metric: r.mean for r in res.collect()}["auc"]


@pytest.mark.parametrize("learner", ["logreg_ridge", "gaussian_nb", "decision_tree"])
def test_planted_signal(table, learner):
    res = wf.simple_cv(table, learner, ["zimc", "x1"], {"C": 1.0, "maxDepth": 3})
    assert _auc(res) > 0.9


def test_shuffled_label_near_chance(table):
    res = wf.simple_cv(table.withColumn("label", F.col("noise")), "logreg_ridge", ["x1"], {"C": 1.0})
    assert abs(_auc(res) - 0.5) < 0.06


def test_scaler_fitted_on_train_only(spark, table):
    m = wf.RobustScaleIQR(["x1"]).fit(table.where("fold != 0"))
    m_all = wf.RobustScaleIQR(["x1"]).fit(table)
    assert m.fitted != m_all.fitted  # validation rows do not reach the fit


@pytest.mark.parametrize("resampling", ["exact", "poisson"])
def test_holdout_validate_both_bootstrap_paths(spark, resampling):
    s = fx.split(spark, SF001).select("id_anon", "zimc", "x1", "label", "split")
    res = {r.metric: r for r in wf.holdout_validate(s, "logreg_ridge", ["zimc", "x1"], {"C": 1.0}, n_boot=10,
                                                       resampling=resampling).collect()}
    assert res["auc"].mean > 0.9 and res["auc"].ci_lower <= res["auc"].mean <= res["auc"].ci_upper
    assert res["auc"].n_boot_effective == 10 and res["auc"].resampling == resampling


def test_workflows_release_their_caches(spark, table):
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    wf.simple_cv(table, "logreg_ridge", ["zimc"], {"C": 1.0}).collect()
    after = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    assert after <= before


def test_synthetic_rows_stay_inside_their_training_part(spark, table, monkeypatch):
    from cohortlens.operators import neighbors
    from cohortlens.operators.resample import stratified_kfold

    seen, smote = [], neighbors.smote

    def watched(minority, *args, **options):
        out = smote(minority, *args, **options)
        seen.append(({r.id_anon for r in minority.select("id_anon").collect()},
                     {v for r in out.select("base_id", "neighbor_id").collect() for v in r}, out.count()))
        return out

    monkeypatch.setattr(neighbors, "smote", watched)
    rows = stratified_kfold(table.where("id_anon % 10 = 0").drop("fold"), "label", "id_anon", 3, seed=7, out="inner_fold").cache()
    best = wf.searched(rows, "logreg_ridge", ["zimc", "x1"], {"C": [0.1, 10.0]}, k_inner=3, smote_k=5)
    ids = {f: {r.id_anon for r in rows.where((F.col("label") == 1) & (F.col("inner_fold") != f)).collect()} for f in range(3)}
    whole = {r.id_anon for r in rows.where("label = 1").collect()}
    # one SMOTE for each inner training part, shared by both parameter maps, and one for the refit
    assert sorted(map(sorted, [s[0] for s in seen])) == sorted(map(sorted, [*ids.values(), whole]))
    assert all(parents <= own and n > 0 for own, parents, n in seen)
    assert best.transform(rows).count() == rows.count()  # scoring adds none


def test_smote_pipeline_without_a_minority_adds_nothing(spark, table):
    pipe = wf.SmotePipeline(None, ["zimc", "x1"])
    _, rows = pipe.resampled(table.where("label = 0"))
    assert rows.where("id_anon < 0").count() == 0 and rows.count() == table.where("label = 0").count()


def test_boosting_query_fits_the_reference_rounds(monkeypatch):
    from cohortlens.plans import catalog_models

    seen, make = [], wf.make_learner
    monkeypatch.setattr(wf, "make_learner", lambda *a, **o: seen.append(make(*a, **o)) or seen[-1])
    wf.build_pipeline("gradient_boosting", ["x1"], catalog_models.LEARNER_PARAMS["gradient_boosting"])
    assert seen[0].getMaxIter() == 100 and seen[0].getStepSize() == 0.1 and seen[0].getMaxDepth() == 3
    assert wf.make_learner("gradient_boosting").getMaxIter() == 100


def test_network_query_fits_the_reference_layers_and_passes(monkeypatch):
    from cohortlens.plans import catalog_models, search

    seen, make = [], wf.make_learner
    monkeypatch.setattr(wf, "make_learner", lambda *a, **o: seen.append(make(*a, **o)) or seen[-1])
    wf.build_pipeline("mlp", ["x1", "x2"], catalog_models.LEARNER_PARAMS["mlp"])
    seen.append(make("mlp", n_features=2))
    assert [(list(m.getLayers()), m.getMaxIter()) for m in seen] == 2 * [([2, 64, 2], 500)]
    assert catalog_models.LEARNER_PARAMS["mlp"]["hidden"] in search.GRIDS["mlp"]["hidden"]


def test_holdout_rows_are_read_once(spark, table, monkeypatch):
    """Medians, scales, weights and the fit's passes read the kept rows, and all of them come from the train part."""
    reads, one = spark.sparkContext.accumulator(0), F.udf(lambda x: (reads.add(1), x)[1], "double")
    s = fx.split(spark, SF001).select("id_anon", "zimc", "x1", "label", "split").cache()
    s.count()
    fitted, real = [], wf.fold_fits
    monkeypatch.setattr(wf, "fold_fits", lambda *a: fitted.append(real(*a)) or fitted[-1])
    wf.holdout_validate(s.withColumn("x1", one("x1")), "logreg_ridge", ["zimc", "x1"], n_boot=5, impute=["x1"]).collect()
    assert reads.value == s.count()
    train = wf.MedianImputeExact(["x1"]).fit(s.where("split = 'train'"))
    scale = wf.RobustScaleIQR(["zimc", "x1"]).fit(train.transform(s.where("split = 'train'")))
    assert [(f[0]["fills"], f[0]["scale"]) for f in fitted] == [(train.fills, scale.fitted)]


def test_nested_cv_repeats_no_rows(spark, table, monkeypatch):
    """The outer folds' training parts are the rows themselves; with repeated ids they are joined as before."""
    from cohortlens.operators import resample

    seen, real = [], wf.searched
    monkeypatch.setattr(wf, "searched", lambda train, *a, **o: seen.append((train, o["kept"])) or real(train, *a, **o))
    rows = table.where("id_anon % 8 = 0").cache()
    inner = resample.nested_folds(rows, "label", "id_anon")
    wf.nested_cv(rows, "logreg_ridge", ["zimc", "x1"], {"C": [1.0]}).collect()
    assert len(seen) == 5 and all(kept for _, kept in seen)
    got = {tuple(sorted((r.id_anon, r.inner_fold) for r in train.select("id_anon", "inner_fold").collect())) for train, _ in seen}
    assert got == {tuple(sorted((r.id_anon, r.inner_fold) for r in inner.where(F.col("outer_fold") == f).collect())) for f in range(5)}
    seen.clear()
    wf.nested_cv(rows.unionByName(rows.limit(20)), "logreg_ridge", ["zimc", "x1"], {"C": [1.0]}).collect()
    assert len(seen) == 5 and not any(kept for _, kept in seen)
