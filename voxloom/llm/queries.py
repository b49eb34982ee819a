"""Registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from functools import wraps

from voxloom.llm import alignment, bpe, html, jaccard, language, merkle, quality, records, secrets, substrings, suffixes, warc, winnow
from voxloom.session import ship_package

_PARTS = (html, jaccard, substrings, quality, secrets, warc, winnow, language, records, bpe, alignment, suffixes, merkle)


def _shipped(run):
    @wraps(run)
    def with_package(spark, sf_dir):
        ship_package(spark)
        return run(spark, sf_dir)

    return with_package


QUERIES = {name: _shipped(run) for part in _PARTS for name, run in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
