"""Registered queries by area; importing this module registers all of them."""

from . import profile_queries, repair_queries, rule_queries, stream_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
