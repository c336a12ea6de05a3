"""Imports every module that registers queries; QUERIES and ORACLE_SQL are then complete."""

from __future__ import annotations

from trendloom.plans import discovery, ingest, market, pages, silver, streams, text_sql, texts, upkeep  # noqa: F401
from trendloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
