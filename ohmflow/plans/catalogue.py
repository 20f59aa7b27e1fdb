"""Every registered query of the meter analytics, with its SQL oracle."""

from __future__ import annotations

from ohmflow.plans import analytics, exact, features, files, reports, strata, streams, tables, trees  # noqa: F401  they register their queries
from ohmflow.plans.registry import QUERIES, SQL

FLAGSHIP = "value_change_by_side"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
