"""All queries of the library by name, with the SQL they are held against."""

from __future__ import annotations

from . import archive, cases, kept, quality, questions, retrieval, upkeep  # noqa: F401  they register their queries
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
