"""Queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import coding, patterns, rasters, vectors, workflows

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _area in (rasters, patterns, vectors, coding, workflows):
    QUERIES |= _area.QUERIES
    SQL |= _area.SQL
