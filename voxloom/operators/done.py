"""Which rows of which input files were handled, as bitmaps.

A file's rows are cut into blocks of 32,768 numbers, and a block's done rows are one bitmap of 4 kB: a
corpus of ten billion rows is some 1.3 GB of them, however long its names are. Bitmaps of several runs are
or-ed; a row is looked up by a bit test, so nothing is compared with every done row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.session import broadcast_if_small

SCHEMA = "dataset string, file_name string, block bigint, bits binary"
#: Rows of ``broadcast_rows`` that one bitmap counts for.
BITMAP_ROWS = 100


def _number(row_index: Column) -> Column:
    """Row numbers from 1: the built-in buckets start there."""
    return row_index + 1


def block_of(row_index: Column) -> Column:
    return F.bitmap_bucket_number(_number(row_index))


def is_marked(bits: Column, row_index: Column) -> Column:
    """Whether a row's bit is set in the bitmap of its block; a null bitmap marks nothing."""
    place = F.bitmap_bit_position(_number(row_index)).cast("int")
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1))
    return F.coalesce(bit == 1, F.lit(False))


def done_bits(rows: DataFrame, dataset: str | Column) -> DataFrame:
    """Bitmaps of rows with ``file_name`` and ``row_index``; a row that comes twice is marked once."""
    name = F.lit(dataset) if isinstance(dataset, str) else dataset
    keyed = rows.select(name.alias("dataset"), "file_name", block_of(F.col("row_index")).alias("block"), F.bitmap_bit_position(_number(F.col("row_index"))).alias("__bit"))
    return keyed.groupBy("dataset", "file_name", "block").agg(F.bitmap_construct_agg("__bit").alias("bits"))


def merged(bits: DataFrame) -> DataFrame:
    """One bitmap for each block, from those of several runs."""
    return bits.groupBy("dataset", "file_name", "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def done_per_file(bits: DataFrame) -> DataFrame:
    """``(file_name, n_done, n_blocks)`` of merged bitmaps of one data set."""
    return bits.groupBy("file_name").agg(
        F.sum(F.bitmap_count("bits")).cast("bigint").alias("n_done"), F.count(F.lit(1)).alias("n_blocks")
    )


def without_marked(rows: DataFrame, bits: DataFrame, n_bitmaps: int, limit: int) -> DataFrame:
    """Rows with ``file_name`` and ``row_index`` whose bit is not set.

    Bitmaps are broadcast only below ``limit`` rows' worth of them, otherwise both sides meet by file and block.
    """
    few = broadcast_if_small(bits.select("file_name", "block", "bits"), n_bitmaps * BITMAP_ROWS, limit)
    keyed = rows.withColumn("block", block_of(F.col("row_index")))
    found = keyed.join(few, ["file_name", "block"], "left")
    return found.where(~is_marked(F.col("bits"), F.col("row_index"))).select(*rows.columns)
