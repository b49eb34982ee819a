"""File table, sample numbers, look-ups."""

import bisect
import random

from pyspark.sql import functions as F

from voxloom.config import PipelineConfig
from voxloom.operators import index as I

CFG = PipelineConfig(chunk_rows=10, position_block=16)


def file_rows(spark, sizes):
    counts = [(f"f{i:03d}", n) for i, n in enumerate(sizes)]
    return I.file_table(spark.createDataFrame(counts, "path string, len bigint")), counts


def test_locate_equals_bisection(spark):
    """Files far smaller and far larger than a block, repeated and unknown numbers."""
    rng = random.Random(5)
    sizes = [rng.choice([0, 1, 1, 2, 9, 10, 11, 250]) for _ in range(60)]
    files, counts = file_rows(spark, sizes)
    starts, total = [], 0
    for _, n in counts:
        starts.append(total)
        total += n
    asked = [rng.randrange(-5, total + 20) for _ in range(400)] + [3] * 200 + list(range(total))
    found = I.locate(spark.createDataFrame([(a,) for a in asked], "idx bigint"), files, CFG).collect()
    want = {}
    for a in set(asked):
        if 0 <= a < total:
            at = bisect.bisect_right(starts, a) - 1
            want[a] = (counts[at][0], a - starts[at])
    assert {r["idx"]: (r["path"], r["row_index"]) for r in found} == want
    assert len(found) == len(want)


def test_one_file_holds_most_rows(spark):
    files, _ = file_rows(spark, [3, 1000, 2])
    rows = spark.createDataFrame(
        [("f000", i, 1) for i in range(3)] + [("f001", i, 1) for i in range(1000)] + [("f002", i, 1) for i in range(2)],
        "path string, row_index bigint, length int",
    )
    got = I.global_index(rows, files, CFG)
    assert sorted(r["idx"] for r in got.collect()) == list(range(1005))
    spread = got.select(F.floor(F.col("row_index") / 16).alias("b"), "path").groupBy("path", "b").count()
    assert spread.agg(F.max("count")).first()[0] <= 16


def test_fetch_from_files_opens_only_what_is_needed(spark):
    files, _ = file_rows(spark, [5, 5, 5])
    opened = []

    def scan(paths):
        opened.extend(paths)
        return spark.createDataFrame([(p, i, f"{p}/{i}") for p in paths for i in range(5)], "path string, row_index bigint, v string")

    asked = spark.createDataFrame([(0,), (12,), (12,)], "idx bigint")
    got = {r["idx"]: r["v"] for r in I.fetch_from_files(asked, files, scan, CFG).collect()}
    assert got == {0: "f000/0", 12: "f002/2"}
    assert opened == ["f000", "f002"]


def test_fetch_has_no_limit(spark):
    files, _ = file_rows(spark, [200_000, 150_000])
    scan = lambda paths: spark.range(200_000).selectExpr(f"explode(array({', '.join(repr(p) for p in paths)})) as path", "id as row_index")
    asked = spark.range(300_000).withColumnRenamed("id", "idx")
    got = I.fetch_from_files(asked, files, scan, CFG)
    assert tuple(got.selectExpr("count(*)", "count(distinct idx)", "max(idx)").first()) == (300_000, 300_000, 299_999)


def test_duplicates(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "sample_id string")
    assert [tuple(r) for r in I.duplicate_ids(rows).collect()] == [("a", 2)]


def test_totals_of_nothing(spark):
    empty = I.file_table(spark.createDataFrame([], "path string, len bigint"))
    assert tuple(I.index_totals(empty).first()) == (0, 0)
