"""Physical plans of representative queries contain no cartesian / nested-loop joins."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF0001

KEYS = ["class_distribution", "univariate_auc", "stratified_split", "knn_classify", "smote", "bootstrap_rows", "top_k_others", "distinct_values", "missing_profile", "leaderboard"]


@pytest.mark.parametrize("key", KEYS)
def test_no_cross_join(spark, key):
    plan = entry.queries()[key](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
