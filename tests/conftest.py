import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cohortlens.session import local_session

    s = local_session(cores="*", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture
def force_large_paths(monkeypatch):
    """Make the size checks pick the bucketed (large-data) code paths."""
    from cohortlens.operators import ranking

    monkeypatch.setattr(ranking, "SMALL_DISTINCT", 0)
    return ranking
