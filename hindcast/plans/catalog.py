"""Import every query module so that its queries are registered."""

from hindcast.plans import experiment_queries, explore_queries, panel_queries, run_queries, stats_queries, storage_queries, utility_queries  # noqa: F401
from hindcast.plans.registry import CHECKS, IDS, QUERIES

__all__ = ["CHECKS", "IDS", "QUERIES"]
