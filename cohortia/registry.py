"""Queries of the statistical operators and the SQL that checks them."""

from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
