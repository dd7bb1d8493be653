"""Imports every module of queries, so that the registry is full."""

from tesselith.plans import flow_queries, imaging_queries, kernel_queries, match_queries, rank_queries, scalar_queries, stack_queries, temporal_queries, tree_queries  # noqa: F401
from tesselith.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
