"""Small helpers over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body``.

    A plain reference inside a higher-order function would be evaluated again for every element.
    """
    return F.transform(F.array(value), body)[0]


def index_range(n: Column) -> Column:
    """``[0, 1, .., n-1]``, empty for ``n <= 0`` (``sequence(0, -1)`` would count downwards)."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def int_div(value: Column, by: int | Column) -> Column:
    """Integer quotient as a bigint; never goes through floating point."""
    return F.call_function("div", value, F.lit(by))
