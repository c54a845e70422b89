"""Every registered query with its SQL counterpart."""

from __future__ import annotations

from tidewake.plans import cohort_queries, event_queries, guard_queries, monitor_queries, planning_queries, resample_queries, score_queries, temporal_queries  # noqa: F401  (they register their queries)
from tidewake.plans.inputs import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
