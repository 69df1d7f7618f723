"""The search as a table of jobs: a stopped run goes on, failed points lose, the best point is refitted."""

import pytest
from pyspark.sql import functions as F

from cohortlens.plans import search
from cohortlens.session import fresh_path

GRID = {"decision_tree": {"maxDepth": [1, 2]}}


@pytest.fixture(scope="module")
def rows(spark):
    # the label needs two splits: depth 2 beats depth 1
    r = spark.range(240).select(F.col("id").alias("id_anon"), (F.col("id") % 12).cast("double").alias("a"),
                                (F.floor(F.col("id") / 12) % 10).cast("double").alias("b"), F.floor(F.col("id") / 120).cast("int").alias("fold"))
    return r.withColumn("label", ((F.col("a") > 5) & (F.col("b") > 4)).cast("int")).cache()


def _run(rows, path, **options):
    return search.search_cv(rows, GRID, ["a", "b"], path, k_outer=2, k_inner=2, **options)


def test_stopped_run_goes_on(spark, rows, monkeypatch):
    path, fits, real = fresh_path(spark, "search"), [], search.part_scores

    def watched(train, valid, algorithm, params, *rest):
        if len(fits) == 4:
            raise RuntimeError("driver lost")
        fits.append(params["maxDepth"])
        return real(train, valid, algorithm, params, *rest)

    monkeypatch.setattr(search, "part_scores", watched)
    with pytest.raises(RuntimeError):
        _run(rows, path, together=2, parallelism=1)
    kept = search.stored(spark, f"{path}/jobs", search.JOB_SCHEMA)
    assert kept.count() == 4 and search.stored(spark, f"{path}/folds", search.FOLD_SCHEMA).count() == 0

    again = []
    monkeypatch.setattr(search, "part_scores", lambda *args: again.append(args[3]) or real(*args))
    out = {r.outer: r for r in _run(rows, path, together=2).collect()}
    assert len(again) == 4 + 2  # the other half of 2 x 2 x 2 jobs, and one refit for each outer fold
    assert all(r.params == '{"maxDepth": 2}' and r.auc > 0.95 and r.failed == 0 for r in out.values()) and set(out) == {0, 1}

    monkeypatch.setattr(search, "part_scores", lambda *args: pytest.fail("nothing is left to fit"))
    assert {r.outer: r for r in _run(rows, path).collect()} == out
    (auc,) = search.summarize_search(spark.createDataFrame(list(out.values()), search.FOLD_SCHEMA)).where("metric = 'auc'").collect()
    assert auc.n == 2 and auc.n_failed == 0


def test_failed_points_and_folds(spark, rows, monkeypatch):
    real = search.part_scores

    def partly(train, valid, algorithm, params, *rest):
        if params["maxDepth"] == 2:
            raise ValueError("no fit")
        return real(train, valid, algorithm, params, *rest)

    monkeypatch.setattr(search, "part_scores", partly)
    assert {r.params for r in _run(rows, fresh_path(spark, "search")).collect()} == {'{"maxDepth": 1}'}
    one_class = _run(rows.withColumn("label", F.lit(0)), fresh_path(spark, "search")).collect()
    assert [(r.auc, r.precision, r.recall, r.f1, r.failed) for r in one_class] == [(0.5, 0.0, 0.0, 0.0, 1)] * 2
    empty = _run(rows.where("false"), fresh_path(spark, "search")).collect()
    assert [r.failed for r in empty] == [1, 1]


def test_best_points_ties_and_failures(spark):
    job = lambda point, position, inner, auc: ("M", "a", 0, inner, point, position, point, auc, int(auc is None))
    jobs = [job("p", 0, 0, 0.9), job("p", 0, 1, None), job("q", 1, 0, 0.7), job("q", 1, 1, 0.5), job("r", 2, 0, 0.5), job("r", 2, 1, 0.7)]
    (best,) = search.best_points(spark.createDataFrame(jobs, search.JOB_SCHEMA)).collect()
    assert (best.params, round(best.inner_auc, 9)) == ("q", 0.6)


def test_knn_and_named_gamma(spark, rows):
    ready = rows.withColumn("_vector", F.array("a", "b"))
    train, valid = ready.where("fold = 0"), ready.where("fold = 1")
    scored = search.part_scores(train, valid, "knn_classify", {"k": 3, "weights": "distance", "metric": "manhattan"}, ["a", "b"], "label",
                                "id_anon", 120, None)
    assert scored.count() == 120 and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert search._resolved({"gamma": "auto"}, train, 2)["gamma"] == 0.5
    values = [v for r in train.collect() for v in (r.a, r.b)]
    mean = sum(values) / len(values)
    want = 1.0 / (2 * sum((v - mean) ** 2 for v in values) / len(values))
    assert abs(search._resolved({"gamma": "scale"}, train, 2)["gamma"] - want) < 1e-9
