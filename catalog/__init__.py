"""Registered queries, each with the SQL that states the same result."""

from catalog import cells, expression, scoring, sets, tests_ranks, transfer  # noqa: F401
from catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
