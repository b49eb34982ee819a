"""Dense global positions without a global sort in one task.

``row_number() over (order by ..)`` with no partition sends every row to one task. Here the order
is cut into *cells*: leading key columns whose combination bounds the number of rows it can hold
(a length plus a block of sample numbers, a file plus a block of row numbers, the leading digits
of a digest). Counting rows per cell is an ordinary aggregation with map-side combine; running
sums over the counts give each cell its first position; a window inside the cell does the rest.

A third of all rows may share one length or one file: the block column splits them, so no task
ever sorts more than ``cfg.position_block`` rows of one cell. Nothing is cached and no partition
id is used, so a lost executor changes nothing.

Running sums are taken in two levels: over the blocks of one leading value, spread by that value,
and then over the leading values. Only the second has no key. It sees one row per distinct length
(``k`` different lengths need ``k * k / 2`` frames, so ten trillion frames have at most 4.5
million), per file (a list the driver holds to plan the scan), or per digest cell (65,536).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions.arrays import int_div

_N = "__cell_rows"
_BEFORE = "__rows_before"


def cell_counts(df: DataFrame, cell: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Rows per cell."""
    return df.groupBy(*group, *cell).agg(F.count(F.lit(1)).alias(_N))


def exclusive_sums(
    counts: DataFrame, value: str, order: Sequence[str], out: str, group: Sequence[str] = ()
) -> DataFrame:
    """Running start of every row of a count table, ordered by ``order`` within ``group``."""
    lead, rest = order[0], list(order[1:])
    before = (W.unboundedPreceding, -1)
    lead_order = W.partitionBy(*group).orderBy(lead).rowsBetween(*before)
    running = F.coalesce(F.sum(value).over(lead_order), F.lit(0)).cast("bigint")
    if not rest:
        return counts.withColumn(out, running)
    one_lead = W.partitionBy(*group, lead)
    inside = F.coalesce(F.sum(value).over(one_lead.orderBy(*rest).rowsBetween(*before)), F.lit(0))
    parts = counts.withColumn("__inside", inside)
    totals = (
        counts.withColumn("__total", F.sum(value).over(one_lead))
        .withColumn("__first", F.min(rest[0]).over(one_lead))
        .where(F.col(rest[0]) == F.col("__first"))
        .select(*group, lead, "__total")
    )
    running = F.coalesce(F.sum("__total").over(lead_order), F.lit(0))
    leads = totals.select(*group, lead, running.alias("__lead_before"))
    return (
        parts.join(leads, [*group, lead])
        .withColumn(out, (F.col("__lead_before") + F.col("__inside")).cast("bigint"))
        .drop("__lead_before", "__inside")
    )


def dense_position(
    df: DataFrame,
    cell: Sequence[str],
    within: Sequence[str],
    out: str = "position",
    group: Sequence[str] = (),
    counts: DataFrame | None = None,
) -> DataFrame:
    """Add the 0-based rank of every row in the order ``cell`` then ``within``, per ``group``.

    ``cell`` must be a prefix of the order and bound the rows it holds. The window and the join
    with the offsets share one shuffle on the cell columns. ``counts`` may pass cell counts that
    are cheaper to get another way (see ``cell_counts``).
    """
    keys = [*group, *cell]
    counts = cell_counts(df, cell, group) if counts is None else counts
    offsets = exclusive_sums(counts, _N, cell, _BEFORE, group).select(*keys, _BEFORE)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*within))
    return (
        df.withColumn("__rank", rank)
        .join(offsets, keys)
        .withColumn(out, (F.col(_BEFORE) + F.col("__rank") - 1).cast("bigint"))
        .drop("__rank", _BEFORE)
    )


def position_by_number(
    df: DataFrame,
    lead: str,
    number: str,
    out: str = "position",
    group: Sequence[str] = (),
    block: int = 1 << 20,
) -> DataFrame:
    """Rank by ``lead`` then by ``number``, a non-negative bigint that is unique per group and lead.

    A block of ``block`` consecutive numbers holds at most that many rows. Use numbers that count
    something (rows of a file, samples of an index): random identifiers would make a cell per row.
    """
    keyed = df.withColumn("__block", int_div(F.col(number), block))
    return dense_position(keyed, [lead, "__block"], [number], out, group).drop("__block")
