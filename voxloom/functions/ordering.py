"""Repeatable pseudo-random order keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hex digits of the digest that select a cell: 65,536 cells of evenly spread keys.
CELL_DIGITS = 4


def shuffle_key(seed: int, *parts: Column) -> Column:
    """A digest of the seed and the parts: same input, same place, on any cluster."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def key_cell(key: Column) -> Column:
    """Leading digits of a digest as a number; it orders like the digest itself.

    Declared free of nulls, so that a join on it does not compute the digest a second time to test it.
    """
    return F.coalesce(F.conv(F.substring(key, 1, CELL_DIGITS), 16, 10).cast("int"), F.lit(0))
