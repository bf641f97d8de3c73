"""Queries over the driver's tables and the SQL that must give the same rows."""

from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
