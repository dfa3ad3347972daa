"""All registered queries and their SQL twins."""

from __future__ import annotations

from lodestrata.plans import adapters, annotations, contracts, curated, evaluations, formats, gates, records, samples, supply, targets, versions  # noqa: F401  each registers its queries
from lodestrata.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
