"""Registered queries: each binds an operator to the given tables, with the same result in SQL."""

from . import content, crawl, jobs, urls  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
