"""Batches, epochs and replicas."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from voxloom.config import PipelineConfig
from voxloom.operators import schedule as B

CFG = PipelineConfig(batch_size=8, position_block=50)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(i, rng.choice([5, 5, 5, *range(1, 60)])) for i in range(203)]


@pytest.fixture(scope="module")
def bins(spark, rows):
    return B.length_bins(spark.createDataFrame(rows, "idx bigint, length int"), CFG).cache()


def as_schedule(df):
    return [tuple(r) for r in df.orderBy("epoch", "pos", "slot_in_bin").collect()]


def test_bins_are_cuts_of_a_stable_sort(bins, rows):
    ordered = [i for i, _ in sorted(rows, key=lambda x: x[1])]
    want = [ordered[i : i + 8] for i in range(0, len(ordered), 8)]
    got = {}
    for r in bins.orderBy("bin", "slot_in_bin").collect():
        got.setdefault(r["bin"], []).append(r["idx"])
    assert [got[b] for b in sorted(got)] == want
    assert B.bin_count(203, CFG) == len(want) == 26


def test_every_sample_once_per_epoch_over_all_replicas(bins):
    plan = B.schedule(bins, 26, 3, 4, CFG).collect()
    for epoch in range(3):
        seen = [r["idx"] for r in plan if r["epoch"] == epoch]
        assert sorted(seen) == list(range(203))
    by_rank = {r: len({(x["epoch"], x["bin"]) for x in plan if x["rank"] == r}) for r in range(4)}
    assert by_rank == {0: 21, 1: 21, 2: 18, 3: 18}


def test_order_follows_the_digest(bins):
    plan = B.schedule(bins, 26, 1, 1, CFG, first=5).collect()
    order = sorted(range(26), key=lambda b: (hashlib.md5(f"42:5:{b}".encode()).hexdigest(), b))
    assert [b for _, b in sorted({(r["pos"], r["bin"]) for r in plan})] == order
    one = [r["idx"] for r in sorted((r for r in plan if r["bin"] == 3), key=lambda r: r["slot_in_bin"])]
    assert one == sorted(one, key=lambda i: hashlib.md5(f"42:5:{i}".encode()).hexdigest())


def test_same_seed_same_order_other_epoch_other_order(spark, bins):
    first = as_schedule(B.schedule(bins, 26, 2, 2, CFG))
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    try:
        assert as_schedule(B.schedule(bins.repartition(7), 26, 2, 2, CFG)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    epochs = [[r[3] for r in first if r[0] == e and r[4] == 0] for e in (0, 1)]
    assert epochs[0] != epochs[1] and sorted(epochs[0]) == sorted(epochs[1])
    later = as_schedule(B.schedule(bins, 26, 1, 2, CFG, first=1))
    assert later == [r for r in first if r[0] == 1]
    other = PipelineConfig(batch_size=8, position_block=50, seed=43)
    assert as_schedule(B.schedule(bins, 26, 2, 2, other)) != first


def test_uneven_bins_kept_or_dropped(bins):
    kept = B.schedule(bins, 26, 1, 4, CFG).select("rank", "bin").distinct().groupBy("rank").count().collect()
    assert sorted(r["count"] for r in kept) == [6, 6, 7, 7]
    even = B.schedule(bins, 26, 1, 4, CFG, uneven="drop").select("rank", "bin").distinct().groupBy("rank").count()
    assert [r["count"] for r in even.collect()] == [6] * 4
    with pytest.raises(ValueError):
        B.schedule(bins, 26, 1, 4, CFG, uneven="some")


def test_fewer_bins_than_replicas(bins):
    few = bins.where(F.col("bin") < 2)
    placed = B.shuffle_bins(few.select("bin").distinct(), 2, 1, CFG).withColumn("rank", B.rank_of(F.col("pos"), 5))
    got = B.bins_per_rank(placed, 2, 5).collect()
    assert sorted((r["rank"], r["actual_bins"], r["planned_bins"]) for r in got) == [(0, 1, 0), (1, 1, 0)]


def test_no_epochs(bins):
    assert B.schedule(bins, 26, 0, 2, CFG).count() == 0


def test_evaluation_runs_from_short_to_long(bins):
    plan = B.schedule(bins, 26, 1, 2, CFG, shuffle=False).orderBy("pos", "slot_in_bin").collect()
    lengths = [r["length"] for r in plan]
    assert lengths == sorted(lengths)


def test_step_plan(bins):
    placed = B.shuffle_bins(bins.select("bin").distinct(), 26, 3, CFG).withColumn("rank", B.rank_of(F.col("pos"), 4))
    plan = B.step_plan(B.bins_per_rank(placed, 26, 4), 3, 4, PipelineConfig(batch_size=8, grad_acc_steps=2)).collect()
    assert sorted((r["rank"], r["actual_steps"], r["planned_steps"], r["effective_batch"]) for r in plan) == [
        (0, 21, 18, 64),
        (1, 21, 18, 64),
        (2, 18, 18, 64),
        (3, 18, 18, 64),
    ]


def test_validation_falls_back_to_test(spark):
    val = spark.createDataFrame([(1,), (2,)], "idx int")
    test = spark.createDataFrame([(7,)], "idx int")
    assert sorted(r[0] for r in B.validation_or_test(val, test).collect()) == [1, 2]
    assert [r[0] for r in B.validation_or_test(val.where("idx > 5"), test).collect()] == [7]
