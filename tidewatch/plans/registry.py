"""All queries on tables and the SQL that each is held against."""

from __future__ import annotations

from tidewatch.plans import governance, operations, profiling  # noqa: F401  (importing registers)
from tidewatch.plans.support import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
