"""Whole plans and the registered queries."""

from .registry import ORACLE, QUERIES
from . import queries_extract, queries_policy, queries_view  # noqa: F401  (they register queries)

__all__ = ["ORACLE", "QUERIES"]
