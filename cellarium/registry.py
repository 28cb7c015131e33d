"""Queries of the spatial library, by name, and the SQL that each must equal."""

from __future__ import annotations

from .plans.spatial import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
