"""All registered queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

from .plans import curation_queries, distance_queries, monitor_queries, raster_queries, search_queries, training_queries, transform_queries
from .streaming import progress

MODULES = (raster_queries, distance_queries, curation_queries, search_queries, monitor_queries, transform_queries, training_queries, progress)


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.ORACLE
    return out
