"""Registered queries, each with the SQL that gives the same rows where SQL can express it."""

from . import flagship, ordered, rollup, scoring, texts
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "ordered", "rollup", "scoring", "texts"]
