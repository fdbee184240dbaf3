"""Queries of the catalogue jobs on the test tables, with their SQL oracles."""

from __future__ import annotations

from topicloom.plans import catalog_queries, job_queries
from topicloom.plans.registration import ORACLES, QUERIES, Query

flagship = catalog_queries.flagship
MODULES = (catalog_queries, job_queries)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
