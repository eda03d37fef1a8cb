"""Queries over the driver's tables, each with SQL of the same meaning."""

from . import books, maps, market, more, regions, serving, truths
from .registry import ORACLE_SQL as SQL
from .registry import QUERIES

__all__ = ["QUERIES", "SQL", "books", "maps", "market", "more", "regions", "serving", "truths"]
