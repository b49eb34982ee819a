"""The keyed permutation: bijective, invertible, the same in Python, Spark and SQL; schedules made of it."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_plans import plan

from voxloom.config import PipelineConfig
from voxloom.operators import permutation as P
from voxloom.operators import schedule as B
from voxloom.streaming.schedule import read_places, read_schedule, write_schedule

CFG = PipelineConfig(batch_size=4)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 500), st.integers(0, 10**6), st.integers(0, 2**40))
def test_a_bijection_with_its_inverse(n, epoch, seed):
    places = [P.place_of(i, n, epoch, seed) for i in range(n)]
    assert sorted(places) == list(range(n))
    assert [P.number_at(p, n, epoch, seed) for p in places] == list(range(n))


@given(st.integers(1, 2**40), st.data())
def test_large_ranges(n, data):
    i, epoch = data.draw(st.integers(0, n - 1)), data.draw(st.integers(0, 1000))
    assert 0 <= P.place_of(i, n, epoch, 42) < n and P.number_at(P.place_of(i, n, epoch, 42), n, epoch, 42) == i


@given(st.integers(0, 2**62))
def test_bases_cover_the_range(n):
    a, b = P.bases(n)
    assert n <= a * b < max(1, n) + a


def test_orders_differ_and_mix():
    n = 1000
    orders = [[P.place_of(i, n, e, s) for i in range(n)] for e, s in ((0, 42), (1, 42), (0, 43))]
    assert len({tuple(o) for o in orders}) == 3
    for o in orders:
        assert sum(p == i for i, p in enumerate(o)) < 8
        near = sum(abs(x - y) < n // 10 for x, y in zip(o, o[1:], strict=False)) / n
        assert 0.13 < near < 0.25  # 0.19 for independent places


@pytest.mark.parametrize("n", [1, 2, 3, 100, 4097])
def test_columns_and_sql_agree_with_python(spark, n):
    rows = spark.range(n).select(F.explode(F.array(F.lit(0), F.lit(7))).alias("epoch"), F.col("id").alias("bin"), F.lit("x").alias("other"))
    placed = P.permuted(rows, "bin", n, 42, "pos")
    assert placed.columns == ["epoch", "bin", "other", "pos"]
    want = {(e, i): P.place_of(i, n, e, 42) for e in (0, 7) for i in range(n)}
    back = P.permuted(placed, "pos", n, 42, "again", back=True).collect()
    assert {(r["epoch"], r["bin"]): r["pos"] for r in back} == want and all(r["again"] == r["bin"] for r in back)
    asked = f"(select e as epoch, i as number from range({n}) t(i), (select unnest([0, 7]) as e))"
    assert {(e, i): p for e, i, p in duckdb.sql(f"with {P.sql_twin(asked, str(n), 42)} select * from placed").fetchall()} == want


def test_numbers_that_leave_the_range_come_back(spark, monkeypatch):
    """The fold that takes them up again, for every number: with bases of twice the range half of them need it."""
    monkeypatch.setattr(P, "bases", lambda n: (n, 2))
    n = 300
    rows = spark.range(n).select(F.lit(3).alias("epoch"), F.col("id").alias("bin"))
    got = P.permuted(P.permuted(rows, "bin", n, 5, "pos"), "pos", n, 5, "again", back=True).collect()
    assert {r["bin"]: r["pos"] for r in got} == {i: P.place_of(i, n, 3, 5) for i in range(n)}
    assert all(r["again"] == r["bin"] for r in got)


def test_places_cost_no_exchange(spark):
    bins = spark.range(1000).withColumnRenamed("id", "bin")
    assert "Exchange" not in plan(B.permute_bins(bins, 1000, 25, CFG))
    members = bins.withColumn("members", F.array(F.struct(F.lit(0).alias("slot_in_bin"), F.col("bin").alias("idx"), F.lit(3).alias("length"))))
    assert "Exchange" not in plan(B.in_order(B.permute_bins(members, 1000, 25, CFG), B.shuffle_members(42), 4))


def test_results_can_be_joined_and_filtered(spark):
    """The optimiser must not take the formula apart (it grows with a power of the rounds)."""
    bins = spark.range(50).withColumnRenamed("id", "bin")
    placed = B.permute_bins(bins, 50, 2, CFG)
    joined = placed.join(spark.range(50).withColumnRenamed("id", "pos"), "pos").where("pos < 10 and pos % 2 = 0")
    assert joined.count() == 10


def index(spark, n):
    return spark.range(n).select(F.col("id").alias("idx"), (F.col("id") * 7 % 30).cast("int").alias("length"))


@pytest.mark.parametrize("uneven", ["keep", "drop"])
def test_schedule_by_formula(spark, uneven):
    bins = B.length_bins(index(spark, 90), CFG)
    rows = B.schedule(bins, 23, 3, 4, CFG, "formula", uneven).collect()
    for e in range(3):
        own = [r for r in rows if r["epoch"] == e]
        kept = {r["bin"]: r["pos"] for r in own}
        assert kept == {b: p for b in range(23) if (p := P.place_of(b, 23, e, 42)) < (20 if uneven == "drop" else 23)}
        assert all(r["rank"] == r["pos"] % 4 for r in own)
    md5 = {(r["epoch"], r["bin"], r["slot_in_bin"]): r["idx"] for r in B.schedule(bins, 23, 3, 4, CFG).collect()}
    assert all(md5[r["epoch"], r["bin"], r["slot_in_bin"]] == r["idx"] for r in rows)
    with pytest.raises(ValueError, match="shuffle"):
        B.schedule(bins, 23, 3, 4, CFG, "sorted")


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    bins = B.length_bins(index(spark, 90), CFG)
    B.bin_members(bins).write.parquet(f"{tmp_path}/members")
    members = spark.read.parquet(f"{tmp_path}/members")
    for k in range(1, 5):
        write_schedule(read_schedule(spark, members, 23, 4, CFG, bins_per_batch=17), str(tmp_path)).awaitTermination()
        rows = spark.read.parquet(f"{tmp_path}/places")
        steps = sorted({(r["epoch"], r["pos"]) for r in rows.select("epoch", "pos").collect()})
        assert steps == [divmod(i, 23) for i in range(17 * k)]
    want = B.schedule(bins, 23, 3, 4, CFG, "formula")
    columns = ["epoch", "pos", "bin", "slot_in_bin", "idx", "length"]
    full = rows.where("epoch < 2").select(*columns)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, want.where("epoch < 2").select(*columns).collect()))
    with pytest.raises(ValueError, match="no bin"):
        read_places(spark, 0, 5)
