"""Registry of queries by name and the equivalent SQL."""

from __future__ import annotations

from quantloom.plans import indicator_queries, event_queries, report_queries, streak_queries, study_queries  # noqa: F401
from quantloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
