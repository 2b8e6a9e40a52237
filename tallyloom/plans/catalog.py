"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from tallyloom.plans import analytics, evaluation, governance, review_queries, span_queries, structure_queries, text_queries  # noqa: F401  they register themselves
from tallyloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
