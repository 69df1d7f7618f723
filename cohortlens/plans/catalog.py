"""All registered queries (importing the catalog modules fills the registry)."""

from __future__ import annotations

from cohortlens.plans import catalog_analysis, catalog_models, catalog_prep  # noqa: F401
from cohortlens.plans.registry import REGISTRY


def registry():
    return dict(REGISTRY)
