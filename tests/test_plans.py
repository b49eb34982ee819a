"""Plans that must hold at scale: no cross joins, no row table in one task, pruned scans."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from voxloom.config import PipelineConfig
from voxloom.operators import frames as R
from voxloom.operators import index as I
from voxloom.operators import schedule as B
from voxloom.sources import chunks as H


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def static(spark):
    """Plans as Spark would build them for tables too large to broadcast."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.maxMetadataStringLength"):
        spark.conf.unset(key)


def single_tasks(text: str) -> list[str]:
    """What is sent to one task: the operator line below each single-partition exchange."""
    lines = text.splitlines()
    return [lines[i + 1] for i, line in enumerate(lines) if "Exchange SinglePartition" in line]


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cross_join(spark, sf, name):
    text = plan(queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.fixture
def index(spark):
    return spark.range(1000).select(F.col("id").alias("idx"), (F.col("id") % 50).cast("int").alias("length"))


def test_bins_and_schedule_rank_without_a_global_sort(static, index):
    cfg = PipelineConfig()
    bins = B.length_bins(index, cfg)
    for df in (bins, B.schedule(bins, 125, 2, 4, cfg)):
        text = plan(df)
        # The one exchange without a key carries a row per distinct length, never a sample.
        for line in single_tasks(text):
            assert "idx" not in line and "__total" in line, line
        assert "hashpartitioning(length" in text


def test_window_and_offset_join_share_one_shuffle(static, index):
    text = plan(B.length_bins(index, PipelineConfig()))
    with_rows = [x for x in re.findall(r"Exchange hashpartitioning\(length#\d+, __block#\d+L, \d+\)", text)]
    # Once for the counts, once for the rows; none between the window and the join.
    assert len(with_rows) <= 4
    join = text.index("SortMergeJoin [length")
    below = text[join:].splitlines()[1]
    assert "Window [row_number()" in below, below


def test_schedule_moves_bins_not_samples(static, index):
    """Samples are gathered into bins once; epochs multiply bins only."""
    text = plan(B.schedule(B.length_bins(index, PipelineConfig()), 125, 5, 4, PipelineConfig()))
    assert len(re.findall(r"Exchange hashpartitioning\(bin#\d+L", text)) == 1
    assert "Exchange hashpartitioning(epoch" in text


def test_frames_need_no_shuffle(static, sf):
    samples = static.createDataFrame([], "idx bigint, audio array<int>, text array<int>, length int")
    for df in (R.sparse_frames(samples, ["idx"]), R.frame_mask(samples, ["idx"]), R.context_pairs(samples, ["idx"])):
        assert "Exchange" not in plan(df)
    text = plan(R.sparse_frames(samples, ["idx"]))
    assert text.count("Generate posexplode") == 1


def test_index_reads_one_column(static, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"audio": [[1]], "text": [[1]], "length": [3]}), f"{tmp_path}/train_part_1.parquet")
    found = H.discover_datasets(static, str(tmp_path), "train")
    lengths = H.scan_lengths(static, found)
    assert re.search(r"ReadSchema: struct<length:bigint(,_tmp_metadata_row_index:bigint)?>", plan(lengths))
    assert "ReadSchema: struct<>" in plan(I.file_counts(lengths))
    files = I.file_table(I.file_counts(lengths))
    joined = plan(I.global_index(lengths, files))
    assert re.search(r"hashpartitioning\(path#\d+, __block#\d+L", joined)


def test_filters_reach_the_scan(static, sf):
    text = plan(queries()["duration_estimate"](static, sf))
    assert "ReadSchema: struct<source:string,n_chars:bigint>" in text
    docs = static.read.parquet(f"{sf}/documents.parquet").where("source = 'src1'").select("doc_id")
    assert "EqualTo(source,src1)" in plan(docs)


def test_lookup_compares_no_pairs(static):
    files = static.createDataFrame([("a", 0, 5)], "path string, start bigint, len bigint")
    text = plan(I.locate(static.range(3).withColumnRenamed("id", "idx"), files))
    assert "Join" not in text and "SinglePartition" not in text
