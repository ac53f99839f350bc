"""All registered queries of the library's own operators."""

from __future__ import annotations

from . import clock_queries, evidence_queries, guard_queries, join_queries, kernel_queries, repair_queries, selection_queries, signal_queries  # noqa: F401  they register themselves
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
