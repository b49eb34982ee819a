"""Dense positions: equal to one global sort, whatever the skew, the blocks and the partitions."""

import random

import pytest
from pyspark.sql import functions as F

from voxloom.config import PipelineConfig
from voxloom.operators import schedule as B
from voxloom.operators.position import dense_position, exclusive_sums, position_by_number


def skewed_lengths(n, seed):
    """Numbers 0..n-1 with lengths of which every third is the same."""
    rng = random.Random(seed)
    return [(i, 7 if i % 3 == 0 else rng.randint(1, 40)) for i in range(n)]


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
@pytest.mark.parametrize("partitions", [1, 5])
def test_rank_by_length_equals_a_global_sort(spark, block, partitions):
    rows = skewed_lengths(500, block)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "idx bigint, length int").repartition(3)
        got = position_by_number(df, "length", "idx", "r", block=block).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    want = {idx: r for r, (idx, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])))}
    assert {g["idx"]: g["r"] for g in got} == want
    assert "__block" not in got[0].asDict()


def test_positions_restart_per_group(spark):
    rows = [(g, f"f{i % 4}", i) for g in ("a", "b") for i in range(60)]
    df = spark.createDataFrame(rows, "g string, file string, row bigint")
    got = position_by_number(df, "file", "row", "p", ("g",), block=4).collect()
    for g in ("a", "b"):
        ordered = sorted((r for r in got if r["g"] == g), key=lambda r: (r["file"], r["row"]))
        assert [r["p"] for r in ordered] == list(range(60))


def test_numbers_far_beyond_double_precision(spark):
    base = 2**60
    df = spark.createDataFrame([(1, base + i) for i in range(50)], "length int, idx bigint")
    got = position_by_number(df, "length", "idx", "r", block=7).collect()
    assert sorted((r["idx"] - base, r["r"]) for r in got) == [(i, i) for i in range(50)]


def test_no_rows(spark):
    df = spark.createDataFrame([], "length int, idx bigint")
    assert position_by_number(df, "length", "idx", "r").collect() == []


def test_exclusive_sums_over_two_levels(spark):
    counts = spark.createDataFrame([("a", 0, 5), ("a", 3, 2), ("b", 1, 4), ("c", 0, 1)], "f string, b int, n bigint")
    got = {(r["f"], r["b"]): r["s"] for r in exclusive_sums(counts, "n", ["f", "b"], "s").collect()}
    assert got == {("a", 0): 0, ("a", 3): 5, ("b", 1): 7, ("c", 0): 11}


def test_counts_from_elsewhere(spark):
    df = spark.createDataFrame([(i % 4, i) for i in range(20)], "c int, v int")
    counts = spark.range(4).select(F.col("id").cast("int").alias("c"), F.lit(5).cast("bigint").alias("__cell_rows"))
    got = dense_position(df, ["c"], ["v"], "p", counts=counts).collect()
    assert {r["v"]: r["p"] for r in got} == {i: (i % 4) * 5 + i // 4 for i in range(20)}


def test_hot_length_is_spread_over_tasks(spark):
    """A window partition never exceeds the block, though one length holds a third of all rows."""
    cfg = PipelineConfig(position_block=32)
    df = spark.createDataFrame(skewed_lengths(3000, 1), "idx bigint, length int")
    cells = df.groupBy("length", (F.col("idx") / cfg.position_block).cast("int").alias("b")).count()
    assert cells.agg(F.max("count")).first()[0] <= cfg.position_block
    bins = B.length_bins(df, cfg)
    assert bins.select("bin", "slot_in_bin").distinct().count() == 3000
