"""Hand-made edge rows for selection, recoding and imputation."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.expr import round_half_even
from cohortlens.operators import impute, profile, recode, select

SCHEMA = "id long, s string, v double, k string, u string, c string, a double, b double"
ROWS = [
    (1, "Sim", 1.0, "Sim", "Dias", "x", 0.0, 10.0),
    (2, "  ", 99.0, None, "Horas", "x", 5.0, None),
    (3, "", None, "Nao", None, "x", None, None),
    (4, "\t", 3.0, "Nao sabe", "Dias", "x", 4.0, 6.0),
    (5, "Não", float("nan"), "Sim", "Horas", None, 2.0, 0.0),
    (6, "1ª série", 99.0, "Sim", "Dias", "x", 8.0, 8.0),
]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_blank_to_null(df):
    out = {r.id: r.s for r in select.blank_to_null(df).collect()}
    assert out[2] is None and out[3] is None and out[4] is None
    assert out[5] == "Não" and out[6] == "1ª série"


def test_drop_high_missing_is_strict(spark):
    d = spark.createDataFrame([(1, None), (2, None), (3, 1.0), (4, 1.0), (5, 1.0)], "id long, m double")
    assert select.drop_high_missing(d, 0.40)[1] == []          # 40% missing is not > 40%
    assert select.drop_high_missing(d, 0.39)[1] == ["m"]


def test_drop_constant_and_all_null(spark):
    d = spark.createDataFrame([(1, None, "a", 1), (2, None, "a", 2)], "id long, n double, c string, v int")
    assert sorted(select.drop_constant(d)[1]) == ["c", "n"]


def test_dedupe_keeps_first(spark, df):
    d = df.select("id", F.col("v").alias("x"), F.col("a").alias("x"))
    out = select.dedupe_columns(d)
    assert out.columns == ["id", "x"]
    assert {r.id: r.x for r in out.collect()}[1] == 1.0


def test_select_available_report(df):
    out, status = select.select_available(df, ["id", "nope", "v"])
    assert out.columns == ["id", "v"]
    assert ("nope", "missing") in status and ("s", "excluded") in status


def test_flags_missing_rules(df):
    o = {r.id: r for r in recode.not_contains_flag(df, "k", "Nao", "f").collect()}
    assert o[2].f == 1  # missing counts as "absent"
    assert o[3].f == 0 and o[1].f == 1
    e = {r.id: r.f for r in recode.equality_flag(df, "k", "Sim", "f").collect()}
    assert e[2] == 0 and e[1] == 1


def test_recode_map_unmapped_null(df):
    o = {r.id: r.kb for r in recode.recode_map(df, "k", {"Sim": 1, "Nao": 0}, "kb").collect()}
    assert o[1] == 1 and o[3] == 0 and o[4] is None and o[2] is None


def test_ordinal_rules_first_match(spark):
    d = spark.createDataFrame([("  1ª Série do médio ",), ("2ª série",), ("outro",), (None,)], "t string")
    rules = [("1ª série", 1), ("2ª série", 2), ("médio", 3)]
    o = [r.code for r in recode.ordinal_rules(d, "t", rules, "code").collect()]
    assert o == [1, 2, None, None]
    rep = recode.unmapped_report(recode.ordinal_rules(d, "t", rules, "code"), "t", "code").collect()
    assert [(r.value, r.n) for r in rep] == [("outro", 1)]


def test_any_of_flags_all_null_guard(spark):
    d = spark.createDataFrame([(1, "Sim", None), (2, "Nao", None), (3, None, None)], "id long, a string, b string")
    o = {r.id: r.f for r in recode.any_of_flags(d, ["a", "b"], "Sim", "f").collect()}
    assert o == {1: 1, 2: 0, 3: None}


def test_consolidate_measures(df):
    o = {r.id: r.m for r in recode.consolidate_measures(df, "a", "b", "m").collect()}
    assert o[1] == 10.0 and o[2] == 5.0 and o[3] is None and o[4] == 5.0 and o[5] == 2.0 and o[6] == 8.0
    c = recode.consolidation_counts(df, "a", "b").first()
    assert (c.n_both, c.n_only_first, c.n_only_second, c.n_zero_removed, c.n_missing) == (2, 2, 1, 2, 1)


def test_sentinel_to_median(spark):
    d = spark.createDataFrame([(1, 10.0, "Sim"), (2, 20.0, "Sim"), (3, 99.0, "Sim"), (4, 40.0, "Nao"),
                               (5, None, "Sim")], "id long, v double, ok string")
    out = recode.sentinel_to_median(d, "v", 99.0, F.col("ok") == "Sim")
    o = {r.id: r.v for r in out.collect()}
    assert o[3] == 15.0 and o[5] is None and o[4] == 40.0


def test_unit_convert_and_range(df):
    o = {r.id: r.h for r in recode.unit_convert(df, "a", "u", {"Dias": 24}, "h").collect()}
    assert o[1] == 0.0 and o[4] == 96.0 and o[2] == 5.0
    o2 = {r.id: r.h for r in recode.unit_convert(df, "a", "u", {"Dias": 24}, "h", unknown_to_null=True).collect()}
    assert o2[2] is None


def test_round_half_even(spark):
    d = spark.createDataFrame([(2.675,), (0.125,), (0.135,), (-0.125,)], "x double")
    got = [r.r for r in d.select(round_half_even("x", 2).alias("r")).collect()]
    import numpy as np

    assert got == [float(np.round(v, 2)) for v in (2.675, 0.125, 0.135, -0.125)]  # NumPy semantics
    assert got[1] == 0.12 and got[3] == -0.12


def test_mode_ties_smallest(spark):
    d = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "s string")
    assert impute.fit_mode(d, ["s"]) == {"s": "a"}
    e = spark.createDataFrame([(None,)], "s string")
    assert impute.fit_mode(e, ["s"]) == {"s": "missing"}


def test_median_impute_interpolated(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (None,), (10.0,), (4.0,)], "v double")
    assert impute.fit_median(d, ["v"]) == {"v": 3.0}


def test_robust_scale_iqr_zero(spark):
    d = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (0.0,), (1.0,)], "v double")
    fitted = impute.fit_robust_scale(d, ["v"])
    assert fitted["v"] == (0.0, 1.0)
    vals = sorted(r.v for r in impute.apply_robust_scale(d, fitted).collect())
    assert vals == [0.0, 0.0, 0.0, 0.0, 1.0]  # the rare flag survives


def test_robust_scale_train_only(spark):
    train = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    fitted = impute.fit_robust_scale(train, ["v"])
    scaled = impute.apply_robust_scale(train, fitted)
    q = impute.fit_robust_scale(scaled, ["v"])["v"]
    assert q[0] == pytest.approx(0.0) and q[1] == pytest.approx(1.0)


def test_one_hot_capped_unseen_and_infrequent(spark):
    train = spark.createDataFrame([(c,) for c in "aaaabbbccdde"], "s string")
    fitted = recode.fit_one_hot_capped(train, "s", max_categories=3)
    assert fitted["kept"] == ["a", "b"]
    test = spark.createDataFrame([("a",), ("d",), ("z",), (None,)], "s string")
    out = recode.apply_one_hot_capped(test, fitted).collect()
    rows = sorted((r.s_a, r.s_b, r.s_infrequent) for r in out)
    assert rows == [(0, 0, 0), (0, 0, 0), (0, 0, 1), (1, 0, 0)]


def test_one_hot_full_missing_all_zero(spark):
    d = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    out = recode.one_hot_full(d, "c").collect()
    assert sorted((r.c_x, r.c_y) for r in out) == [(0, 0), (0, 1), (1, 0)]


@pytest.mark.parametrize("drop_first", [False, True])
def test_one_hot_above_the_limit_is_a_sparse_vector(spark, drop_first):
    d = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c"), (5, "a")], "id int, c string")
    encode = recode.one_hot_drop_first if drop_first else recode.one_hot_full
    got = {r.id: r.c_onehot for r in encode(d, "c", limit=2).collect()}
    wide = {r.id: r for r in encode(d, "c").collect()}
    names = ["c_b", "c_c"] if drop_first else ["c_a", "c_b", "c_c"]
    for i, v in got.items():
        assert list(v.toArray()) == [float(wide[i][n]) for n in names] and len(v.indices) <= 1


def test_one_hot_sparse_of_100_000_categories_and_of_none(spark):
    wide = spark.range(200_000).select("id", (F.col("id") % 100_000).alias("c"))
    got = recode.one_hot_full(wide, "c").where("id IN (7, 100007, 99999)").collect()
    assert {(r.id, r.c_onehot.size, int(r.c_onehot.indices[0])) for r in got} == {(7, 100_000, 7), (100007, 100_000, 7), (99999, 100_000, 99999)}
    none = spark.createDataFrame([(1, None), (2, None)], "id int, c string")
    assert [list(r.c_onehot.toArray()) for r in recode.one_hot_sparse(none, "c").collect()] == [[0.0], [0.0]]
    assert recode.one_hot_sparse(none.limit(0), "c").count() == 0


def test_missing_profile_nan_and_distinct(df):
    p = {r.feature: r for r in profile.missing_profile(df).collect()}
    assert p["v"].n_missing == 2  # null and NaN
    assert p["v"].n_distinct == 3
    assert p["c"].has_missing == 1


def test_skewness_corrected(spark):
    import numpy as np

    xs = [1.0, 2.0, 2.0, 3.0, 10.0, 4.0]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    got = profile.skewness_check(d, ["x"]).first().skewness
    a = np.array(xs)
    n = len(a)
    m2, m3 = ((a - a.mean()) ** 2).mean(), ((a - a.mean()) ** 3).mean()
    g1 = m3 / m2 ** 1.5
    assert got == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2), abs=1e-6)


def test_name_rules_python_matches_column_rules(spark):
    names = ["b04_idade", "id_anon", "s01_x", "peso_mae", "k_sexo", "abc_id", "idade"]
    rules = {"exact": ["id_anon"], "prefix": ["s01"], "suffix": ["_mae"], "contains": ["sex"], "token": ["id"]}
    d = spark.createDataFrame([(n,) for n in names], "variavel string")
    via_cols = sorted(r.variavel for r in select.candidate_columns(d, rules).collect())
    via_py = sorted(n for n in names if not select.name_excluded(n, rules))
    assert via_cols == via_py == ["b04_idade", "idade"]


def test_whitelist_rules(spark):
    from cohortlens.operators import select

    names = spark.createDataFrame([(n,) for n in ("q1", "q1_30m", "Q2", "vd_x", "q3", "id")], "variavel string")
    dic = spark.createDataFrame([("q1", "A", 1), ("q1_30m", "A", 2), ("q2", "A", 3), ("vd_x", "A", 4), ("q3", "A", 5), ("q3", "Z", 6), ("id", "A", 7)],
                                "variavel string, bloco string, ordem long")
    got = select.block_whitelist(names, dic, ["A"], out_of_window=["_30m"], exclude_exact=["id"], exclude_prefix=["vd_"])
    assert [r.variavel for r in got.collect()] == ["q1"]  # exact names, the last entry wins


def test_text_nan_is_a_value(spark):
    from cohortlens.operators import profile

    df = spark.createDataFrame([("NaN", float("nan")), ("a", 1.0), ("NaN", 1.0)], "s string, x double")
    assert {r.feature: r.n_distinct for r in profile.distinct_counts_df(df).collect()} == {"s": 2, "x": 1}


def test_work_folder_must_be_shared_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    import pytest

    from cohortlens import session

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.work_dir(fake)


def test_upsert_leaves_the_session_setting(spark, tmp_path):
    from cohortlens.sources import io

    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    path = str(tmp_path / "results")
    layout = "model string, algorithm string, auc double"
    io.result_upsert(spark.createDataFrame([("m", "a", 0.5), ("m", "b", 0.6)], layout), path)
    io.result_upsert(spark.createDataFrame([("m", "b", 0.7)], layout), path)
    assert {(r.algorithm, r.auc) for r in io.read_results(spark, path).collect()} == {("a", 0.5), ("b", 0.7)}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static") == before


def test_nb_of_one_class_or_constant_features(spark):
    from cohortlens.plans.learners import apply_gaussian_nb, fit_gaussian_nb

    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0), (None, 9.0)], "label int, x double")
    assert {r.score for r in apply_gaussian_nb(df, fit_gaussian_nb(df, ["x"], "label")).where("x < 5").collect()} == {1 / 3}
    assert {r.score for r in apply_gaussian_nb(df, fit_gaussian_nb(df.where("label = 0"), ["x"], "label")).collect()} == {0.0}


def test_written_tables_can_be_removed(spark, monkeypatch):
    import os

    from cohortlens import session

    monkeypatch.setattr(session, "_WRITTEN", [])
    path = session.fresh_path(spark, "gone")
    spark.range(3).write.parquet(path)
    session.fresh_path(spark, "never-written")
    local = path.removeprefix("file:")
    assert os.path.isdir(local) and session.remove_written(spark) == 1 and not os.path.exists(local)
    assert session.remove_written(spark) == 0
