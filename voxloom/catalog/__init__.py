"""Registered queries and their DuckDB twins."""

from __future__ import annotations

from functools import wraps

from voxloom.catalog import audio_queries, frame_queries, schedule_queries, source_queries, text_queries
from voxloom.session import ship_package

_PARTS = (text_queries, source_queries, audio_queries, schedule_queries, frame_queries)


def _shipped(run):
    @wraps(run)
    def with_package(spark, sf):
        ship_package(spark)
        return run(spark, sf)

    return with_package


def all_queries():
    """Name to ``(spark, sf_dir) -> DataFrame``; workers get this package before a query is built."""
    return {name: _shipped(run) for part in _PARTS for name, run in part.QUERIES.items()}


def all_oracles():
    """Name to SQL over the same tables."""
    return {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
