"""Steps that read their input once, whatever the number of groups, columns and folds."""

import numpy as np
import pandas as pd
import pytest

from cohortlens.operators import impute, metrics, ranking


@pytest.fixture
def table(spark):
    """(rows, reads): a table with nulls, NaN, ties and rows without a fold; ``reads`` counts the rows that jobs took from it."""
    rng, n = np.random.default_rng(5), 6000
    d = pd.DataFrame({"a": rng.normal(size=n).round(2), "b": rng.integers(0, 9, n).astype(float), "c": rng.choice([1.5, 2.5], n),
                      "e": rng.random(n), "y": rng.integers(0, 2, n), "fold": rng.integers(0, 5, n), "s": rng.choice(["p", "q", "r"], n)})
    reads = spark.sparkContext.accumulator(0)

    def nulls(batches):
        for b in batches:
            reads.add(len(b))
            b = b.astype({"fold": "Int64", "b": "Float64"})
            at = np.arange(len(b))
            b.loc[at % 3 == 0, "b"] = pd.NA
            b.loc[at % 2 == 0, "e"] = np.nan
            b.loc[at % 41 == 0, "fold"] = pd.NA
            b.loc[at % 7 == 0, "s"] = None
            yield b

    return spark.createDataFrame(d).repartition(4).mapInPandas(nulls, "a double, b double, c double, e double, y long, fold long, s string"), reads, n


def test_auc_reads_its_input_once_and_runs_agree_with_one_window(table, force_large_paths, monkeypatch):
    rows, reads, n = table
    by = lambda df, *keys: df.toPandas().sort_values(list(keys)).reset_index(drop=True)
    calls = {"auc": lambda: by(metrics.roc_auc(rows, "a", "y", ["s", "fold"]), "s", "fold"), "u": lambda: by(metrics.mann_whitney(rows, "a", "y", ["s"]), "s"),
             "one": lambda: metrics.roc_auc(rows, "a", "y").toPandas()}
    large = {}
    for name, call in calls.items():
        before = reads.value
        large[name] = call()
        assert reads.value - before == n
    monkeypatch.setattr(ranking, "SMALL_DISTINCT", 1_000_000)
    for name, call in calls.items():
        pd.testing.assert_frame_equal(large[name], call())


def test_univariate_auc_counts_categories_without_reading_the_rows_again(table):
    rows, reads, n = table
    before = reads.value
    got = metrics.univariate_auc(rows, "y", ["a", "b"], ["s"]).toPandas().set_index("feature")
    assert reads.value - before <= 2 * n  # numbers and categories
    assert set(got.index) == {"a", "b", "s"} and (got["auc_folded"] >= 0.5).all()


def test_fold_fits_of_a_large_table_take_four_reads(table, force_large_paths, monkeypatch):
    rows, reads, n = table
    want = lambda: impute.fold_fits(rows, ["a", "b", "c", "e"], ["b", "e"], "fold", range(4))
    before = reads.value
    large = want()
    assert reads.value - before <= 4 * n
    monkeypatch.setattr(ranking, "SMALL_DISTINCT", 1_000_000)
    assert large == want()


def test_cross_impute_reads_its_input_once(table):
    rows, reads, n = table
    stored = rows.toPandas()
    before = reads.value
    impute.cross_impute(rows, "fold", range(5), ["b", "e"], ["s"]).count()
    assert reads.value - before == n
    modes = impute.fold_modes(rows, ["s"], "fold", range(5))
    for k in range(5):
        counts = stored[stored["fold"].notna() & (stored["fold"] != k)]["s"].value_counts()
        assert modes[k]["s"] == min(counts.index, key=lambda v: (-counts[v], v))
