"""All queries of the library, by inventory id; the first is the flagship."""

from __future__ import annotations

from riskloom.plans import brand_queries, content, detectors, results  # noqa: F401
from riskloom.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Queries that SQL can't express, held against plain versions in the tests.
WITHOUT_SQL = content.WITHOUT_SQL | brand_queries.WITHOUT_SQL | results.WITHOUT_SQL
