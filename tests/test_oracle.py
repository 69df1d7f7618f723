"""Every registered key with an oracle: Spark result == DuckDB result at sf0.01."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF001

SQL_KEYS = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    from tools.oracle_check import duck as make

    return make(SF001)


@pytest.mark.parametrize("key", SQL_KEYS)
def test_matches_oracle(spark, duck, key):
    from tools.oracle_check import compare

    status, msg = compare(spark, duck, key, entry.queries()[key], entry.oracle_sql()[key], SF001)
    assert status == "ok", msg


def test_every_oracle_key_is_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"class", "n", "pct", "n_source", "retention_pct"}


LARGE_PATH_KEYS = ["numeric_profile", "median_impute", "iqr_outliers", "roc_auc_lineitem", "univariate_auc",
                   "mann_whitney", "robust_scale", "percentile_interval", "leaderboard"]


@pytest.mark.parametrize("key", LARGE_PATH_KEYS)
def test_matches_oracle_on_large_data_paths(spark, duck, key, force_large_paths):
    """The bucketed (large-data) code paths give the oracle's answer too."""
    from tools.oracle_check import compare

    status, msg = compare(spark, duck, key, entry.queries()[key], entry.oracle_sql()[key], SF001)
    assert status == "ok", msg
