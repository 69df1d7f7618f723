"""Splits, folds and bootstrap: exactness and partition-count invariance."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import resample
from cohortlens.plans import fixtures as fx
from tests.conftest import SF0001


@pytest.fixture(scope="module")
def lab(spark):
    return fx.labelled(spark, SF0001).select("id_anon", "classe", "label").cache()


def test_folds_partition_rows_and_balance(lab):
    f = resample.stratified_kfold(lab, "classe", "id_anon", k=5)
    assert f.count() == lab.count() and f.select("id_anon").distinct().count() == lab.count()
    sizes = f.groupBy("classe", "fold").count().groupBy("classe").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r.spread <= 1 for r in sizes)


def test_split_exact_per_class(lab):
    s = resample.stratified_split(lab, "classe", "id_anon", 0.2)
    per = s.groupBy("classe").agg(F.count(F.lit(1)).alias("n"),
                                  F.sum((F.col("split") == "test").cast("int")).alias("t")).collect()
    for r in per:
        assert r.t == int(r.n * 0.2 + 0.5)


def test_partition_count_invariance(lab):
    a = resample.stratified_kfold(lab.repartition(3), "label", "id_anon").select("id_anon", "fold")
    b = resample.stratified_kfold(lab.repartition(11), "label", "id_anon").select("id_anon", "fold")
    assert a.exceptAll(b).count() == 0


def test_nested_folds_exclude_outer(lab):
    f = resample.stratified_kfold(lab, "label", "id_anon")
    nf = resample.nested_folds(f, "label", "id_anon")
    j = nf.join(f.select("id_anon", "fold"), "id_anon")
    assert j.where(F.col("fold") == F.col("outer_fold")).count() == 0
    assert nf.count() == 4 * lab.count()


def test_bootstrap_rows_sizes(lab):
    b = resample.bootstrap_rows(lab, "id_anon", 7, seed=1)
    sizes = {r.replicate: r["count"] for r in b.groupBy("replicate").count().collect()}
    n = lab.count()
    assert sizes == {i: n for i in range(1, 8)}


def test_poisson_weights_mean_one(lab):
    w = resample.poisson_bootstrap_weights(lab, "id_anon", 20, seed=3)
    total = w.agg(F.sum("weight")).first()[0]
    assert abs(total / (20 * lab.count()) - 1) < 0.05


def test_balanced_and_pos_weights(spark):
    d = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    w = {r.y: r.weight for r in resample.balanced_weights(d, "y").collect()}
    assert w == {1: 2.0, 0: 4 / 6}
    r = {x.y: x.weight for x in resample.pos_weight(d, "y", None).collect()}
    assert r == {1: 3.0, 0: 1.0}


def test_null_classes_and_labels_keep_their_rows(spark):
    """NULL classes are a class of their own in splits, folds, nested folds and weights."""
    df = spark.range(1000).selectExpr("id AS id_anon", "CASE WHEN id % 4 > 0 THEN CAST(id % 4 AS STRING) END AS c")
    s = resample.stratified_split(df, "c", "id_anon")
    assert s.count() == 1000 and s.where("c IS NULL AND split = 'test'").count() == 50
    f = resample.stratified_kfold(df, "c", "id_anon")
    assert sorted(r["count"] for r in f.where("c IS NULL").groupBy("fold").count().collect()) == [50] * 5
    assert resample.nested_folds(f, "c", "id_anon").count() == 4000
    assert {r.weight for r in resample.balanced_weights(df, "c").collect()} == {1.0}
    many = spark.range(300).selectExpr("id", "id % 150 AS c")
    w = resample.balanced_weights(many, "c")
    assert w.where("weight IS NULL").count() == 0 and w.count() == 300


def test_large_groups_take_more_hash_bits(spark, monkeypatch):
    from cohortlens.operators import ranking

    df = spark.range(3000).selectExpr("id AS id_anon", "CASE WHEN id % 30 = 0 THEN 'b' ELSE 'a' END AS c")
    want = {r.id_anon: r.fold for r in resample.stratified_kfold(df, "c", "id_anon").collect()}
    monkeypatch.setattr(ranking, "HASH_BUCKET_BITS", 0)
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 10)
    assert want == {r.id_anon: r.fold for r in resample.stratified_kfold(df, "c", "id_anon").collect()}


def test_inner_folds_without_repeated_rows(spark):
    """One array a row holds the inner folds that the exploded rows have; null classes and folds, and folds beyond the outer ones."""
    k = F.col("id")
    f = spark.range(900).select(k.alias("id_anon"), F.when(k % 17 != 0, (k % 4 == 0).cast("int")).alias("label"),
                                F.when(k % 23 != 0, (F.xxhash64("id") % 3 + 2).cast("int")).alias("fold"))
    want = {(r.outer_fold, r.id_anon): r.inner_fold for r in resample.nested_folds(f, "label", "id_anon", k_outer=4, k_inner=3).collect()}
    rows = resample.inner_folds(f, "label", "id_anon", k_outer=4, k_inner=3).collect()
    assert len(rows) == 900
    assert {(o, r.id_anon): i for r in rows for o, i in enumerate(r.inner) if i is not None} == want
