"""All queries: importing this module registers them."""

from tideline.plans import flow_queries, group_queries, log_queries, scalar_queries  # noqa: F401
from tideline.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
