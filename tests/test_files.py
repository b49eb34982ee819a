"""Corpora and chunk tables on disk, also as other tools write them."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voxloom.catalog import tables
from voxloom.config import PipelineConfig
from voxloom.operators import index as I
from voxloom.operators.frames import dense_batches
from voxloom.plans import serve
from voxloom.sources import chunks as H
from voxloom.sources import corpus as S
from voxloom.sources.files import glob_paths

CORPUS = "text string, speaker string"


def put(path, **columns):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    pq.write_table(pa.table(columns), path)


def chunk(path, lengths, first=0):
    """A chunk as other tools write it: 64-bit lists and lengths."""
    put(
        path,
        audio=pa.array([[first + i] * 32 for i in range(len(lengths))], pa.list_(pa.int64())),
        text=pa.array([[1] * (n - 2) for n in lengths], pa.list_(pa.int64())),
        length=pa.array(lengths, pa.int64()),
    )


@pytest.fixture
def corpus(tmp_path):
    for split, files in (("train", 5), ("validation", 2)):
        for i in range(files):
            put(f"{tmp_path}/{split}-{i:05d}-of-{files:05d}.parquet", text=[f"{split} {i} {j}" for j in range(3)], speaker=["a", None, "b"])
    put(f"{tmp_path}/other-00000.parquet", text=["no"], speaker=["x"])
    return str(tmp_path)


def test_scan_split(spark, corpus):
    assert S.scan_split(spark, corpus, "train").count() == 15
    assert S.scan_split(spark, corpus, "val").count() == S.scan_split(spark, corpus, "validation").count() == 6
    assert S.scan_split(spark, corpus, "test") is None
    schema = spark.createDataFrame([], CORPUS).schema
    empty = S.scan_split(spark, corpus, "test", schema)
    assert empty.count() == 0 and empty.columns == ["text", "speaker", "file_name", "row_index"]
    with pytest.raises(ValueError):
        S.scan_split(spark, corpus, "dev")


def test_unreadable_corpus_raises(spark, tmp_path):
    (tmp_path / "train-00000.parquet").write_bytes(b"junk")
    schema = spark.createDataFrame([], CORPUS).schema
    with pytest.raises(Exception):
        S.scan_split(spark, str(tmp_path), "train", schema).count()


def test_divisions_share_the_files(spark, corpus):
    parts = [S.scan_division(spark, corpus, "train", d, 2) for d in (0, 1)]
    files = [sorted({r[0] for r in p.select("file_name").collect()}) for p in parts]
    assert [[f[6:11] for f in fs] for fs in files] == [["00000", "00002", "00004"], ["00001", "00003"]]
    assert S.scan_division(spark, corpus, "train", 6, 7) is None
    with pytest.raises(ValueError):
        S.scan_division(spark, corpus, "train", 2, 2)
    assert S.division_plan(4, 0) == [("train", 0, 4), ("validation", 0, 1), ("test", 0, 1)]
    assert S.division_plan(4, 3) == [("train", 3, 4)]


def test_next_number_of_foreign_chunks(spark, tmp_path):
    root = str(tmp_path)
    assert H.next_chunk_number(spark, root, "train") == 1
    for name in ("train_part_002", "train_part_1003", "train_part_final", "train_div2_part_050", "test_part_7"):
        chunk(f"{root}/{name}.parquet", [3, 4])
    assert H.next_chunk_number(spark, root, "train") == 1004
    assert H.next_chunk_number(spark, root, "train", 2) == 51
    assert H.next_chunk_number(spark, root, "train", 0) == 1
    assert H.existing_count(spark, root, "train") == 6
    assert H.existing_count(spark, root, "train", 2) == 2
    assert H.chunk_name("train", 7) == "train_part_007.parquet"
    assert H.chunk_name("train", 1234, 3) == "train_div3_part_1234.parquet"


@pytest.mark.parametrize("name", ["plain", "with blank", "50%25"])
def test_index_of_a_flat_directory(spark, tmp_path, name):
    root = str(tmp_path / name)
    for no, lengths in ((1, [5, 6]), (2, [7]), (10, [8, 9, 3])):
        chunk(f"{root}/train_part_{no:03d}.parquet", lengths, first=10 * no)
    chunk(f"{root}/train_div1_part_001.parquet", [4])
    chunk(f"{root}/validation_part_001.parquet", [4])
    index = serve.build_index(spark, root, "train")
    rows = index.index.orderBy("idx").collect()
    assert [r["length"] for r in rows] == [4, 5, 6, 7, 8, 9, 3]
    assert [r["idx"] for r in rows] == list(range(7))
    full = index.samples(spark).orderBy("idx").collect()
    assert [r["audio"][0] for r in full] == [0, 10, 11, 20, 100, 101, 102]
    assert dict(index.samples(spark).dtypes)["audio"] == "array<int>"
    assert tuple(I.index_totals(index.files).first()) == (4, 7)


def test_subdirectories_are_datasets(spark, tmp_path):
    root = str(tmp_path)
    chunk(f"{root}/b/train_part_001.parquet", [5])
    chunk(f"{root}/a/train_part_001.parquet", [6, 7])
    chunk(f"{root}/c/test_part_001.parquet", [9])
    chunk(f"{root}/c/deep/train_part_001.parquet", [9])
    chunk(f"{root}/train_part_001.parquet", [9])
    found = H.discover_datasets(spark, root, "train")
    assert [d for d, _ in found] == ["a", "b"]
    assert [r["length"] for r in serve.build_index(spark, root, "train").index.orderBy("idx").collect()] == [6, 7, 5]


def test_corrupt_files_are_left_out_and_reported(spark, tmp_path):
    root = str(tmp_path)
    for i in range(3):
        chunk(f"{root}/train_part_{i}.parquet", [5 + i, 6])
    with open(f"{root}/train_part_1.parquet", "r+b") as f:
        f.truncate(20)
    (tmp_path / "train_part_9.parquet").write_bytes(b"")
    found = H.discover_datasets(spark, root, "train")
    report = H.corrupt_files(spark, found)
    assert sorted(r["path"].rsplit("/")[-1] for r in report.collect()) == ["train_part_1.parquet", "train_part_9.parquet"]
    index = serve.build_index(spark, root, "train")
    assert [r["length"] for r in index.index.orderBy("idx").collect()] == [5, 6, 7, 6]
    kept = H.drop_corrupt(H.scan_lengths(spark, found, skip_corrupt=True), report)
    assert kept.count() == 4


def test_damage_inside_a_file_drops_the_whole_file(spark, tmp_path):
    root = str(tmp_path)
    path = f"{root}/train_part_1.parquet"
    lengths = pa.array(range(100_000), pa.int64())
    pq.write_table(pa.table({"length": lengths}), path, row_group_size=20_000, use_dictionary=False, compression="gzip")
    size = os.path.getsize(path)
    with open(path, "r+b") as f:
        f.seek(size * 2 // 3)
        f.write(b"\xff" * 400)
    chunk(f"{root}/train_part_2.parquet", [5])
    found = H.discover_datasets(spark, root, "train")
    report = H.corrupt_files(spark, found).collect()
    assert [(r["path"].rsplit("/")[-1], r["footer_rows"]) for r in report] == [("train_part_1.parquet", 100_000)]
    assert report[0]["read_rows"] < 100_000
    assert serve.build_index(spark, root, "train").n_samples == 1


def test_damage_in_the_arrays_drops_the_whole_file_or_raises(spark, tmp_path):
    root = str(tmp_path)
    n = 4000
    for k in range(2):
        audio = pa.array([[(i * 7 + j) % 2048 for j in range(32)] for i in range(n)], pa.list_(pa.int64()))
        rows = {"audio": audio, "text": pa.array([[i % 250] for i in range(n)], pa.list_(pa.int64())), "length": pa.array([3] * n, pa.int64())}
        pq.write_table(pa.table(rows), f"{root}/train_part_{k}.parquet", row_group_size=1000, use_dictionary=False, compression="zstd")
    meta = pq.ParquetFile(f"{root}/train_part_1.parquet").metadata.row_group(2).column(0)
    with open(f"{root}/train_part_1.parquet", "r+b") as f:
        f.seek(meta.data_page_offset + meta.total_compressed_size // 2)
        f.write(b"\xff" * 200)
    index = serve.build_index(spark, root, "train")
    assert index.n_samples == n
    assert serve.batches(spark, index).count() == n
    assert serve.batch_schedule(index).count() == n
    with pytest.raises(Exception, match="(?i)corrupt|decompress|cannot read|FAILED_READ_FILE"):
        unchecked = serve.build_index(spark, root, "train", check=False)
        serve.batches(spark, unchecked).write.format("noop").mode("overwrite").save()


def test_a_wrong_stored_length_raises(spark, tmp_path):
    rows = {"audio": pa.array([list(range(32))] * 2, pa.list_(pa.int64())), "text": pa.array([[1, 2]] * 2, pa.list_(pa.int64())), "length": pa.array([4, 3], pa.int64())}
    pq.write_table(pa.table(rows), f"{tmp_path}/train_part_1.parquet")
    with pytest.raises(Exception, match="stored length does not fit the arrays of sample 1"):
        serve.export_batches(spark, str(tmp_path), "train", str(tmp_path / "out"), PipelineConfig(batch_size=2))
    short = spark.createDataFrame([(0, 0, 7, 3, list(range(32)), [1, 2])], "bin int, slot_in_bin int, idx bigint, pad_length int, audio array<int>, text array<int>")
    with pytest.raises(Exception, match="sample 7 needs 4 rows and is padded to 3"):
        dense_batches(short).collect()


def test_runs_that_share_a_folder_keep_their_files(spark, tmp_path):
    """Writers that overlap in time."""
    from threading import Thread

    cfg = PipelineConfig(chunk_rows=100, chunks_per_task=2)
    out = str(tmp_path / "out")

    def write(division, n):
        rows = spark.range(n).select(F.lit("f").alias("f"), F.col("id").alias("row"), F.lit(division).alias("division"))
        placed = H.assign_chunks(rows, "f", "row", (), 1, cfg)
        H.write_chunks(placed, n, out, "train", division, 1, cfg)

    threads = [Thread(target=write, args=a) for a in ((0, 3000), (1, 9000), (0, 700))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = {r["division"]: r["count"] for r in spark.read.parquet(out).groupBy("division").count().collect()}
    assert got == {0: 3700, 1: 9000}
    assert not [p for p in os.listdir(out) if p.startswith("_run")]


def test_one_replicas_share(spark, tmp_path):
    root = str(tmp_path)
    chunk(f"{root}/train_part_1.parquet", [5, 6, 7, 8, 9])
    chunk(f"{root}/validation_part_1.parquet", [5])
    cfg = PipelineConfig(batch_size=1)
    whole, _ = serve.create_batches(spark, root, 1, 2, cfg)
    for rank in (0, 1):
        share, _ = serve.create_batches(spark, root, 1, 2, cfg, rank=rank)
        assert sorted(map(tuple, share.collect())) == sorted(tuple(r) for r in whole.collect() if r["rank"] == rank)
    even, _ = serve.create_batches(spark, root, 1, 2, cfg, uneven="drop")
    assert even.count() == 4
    with pytest.raises(ValueError, match="rank 2 of 2"):
        serve.create_batches(spark, root, 1, 2, cfg, rank=2)


def test_chunk_files_hold_one_chunk_each(spark, tmp_path):
    cfg = PipelineConfig(chunk_rows=10, chunks_per_task=3, position_block=7)
    rows = spark.range(95).select((F.col("id") % 3).cast("string").alias("f"), F.col("id").alias("row"), F.lit(4).alias("length"))
    placed = H.assign_chunks(rows, "f", "row", (), 4, cfg)
    out = str(tmp_path / "out")
    H.write_chunks(placed, 95, out, "train", 2, 4, cfg)
    files = glob_paths(spark, f"{out}/train_div2_part_*.parquet")
    held = [pq.read_table(f.removeprefix("file:"))["chunk_no"].to_pylist() for f in files]
    assert [set(h) for h in held] == [{n} for n in range(4, 14)]
    assert [len(h) for h in held] == [10] * 9 + [5]
    assert H.next_chunk_number(spark, out, "train", 2) == 14
    positions = [p for f in files for p in pq.read_table(f.removeprefix("file:"))["position"].to_pylist()]
    assert positions == list(range(95))
    assert len(H.discover_datasets(spark, out, "train")) == 10


def test_no_validation_files_means_test(spark, tmp_path):
    root = str(tmp_path)
    chunk(f"{root}/train_part_1.parquet", [5, 6, 7])
    chunk(f"{root}/test_part_1.parquet", [8, 9])
    assert serve.build_validation_index(spark, root).n_samples == 2
    train, held_out = serve.create_batches(spark, root, cfg=PipelineConfig(batch_size=2))
    assert train.count() == 3
    assert [r["length"] for r in held_out.orderBy("pos", "slot_in_bin").collect()] == [8, 9]
    assert serve.build_index(spark, root, "validation").n_samples == 0
    assert serve.batch_schedule(serve.build_index(spark, root, "validation")).count() == 0


def test_export(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    chunk(f"{root}/train_part_1.parquet", [5, 9, 7, 4, 30])
    serve.export_batches(spark, root, "train", out, PipelineConfig(batch_size=2), bins_per_file=1)
    rows = spark.read.parquet(out).orderBy("bin", "slot_in_bin").collect()
    assert [(r["bin"], r["idx"], r["pad_length"]) for r in rows] == [(0, 3, 5), (0, 0, 5), (1, 2, 9), (1, 1, 9), (2, 4, 30)]
    per_file = spark.read.parquet(out).groupBy(F.input_file_name()).agg(F.collect_set("bin").alias("b")).collect()
    assert sorted(tuple(r["b"]) for r in per_file) == [(0,), (1,), (2,)]


def test_in_memory_samples(spark, tmp_path):
    root = str(tmp_path)
    chunk(f"{root}/train_part_1.parquet", [5, 9])
    kept = serve.build_index(spark, root, "train").samples(spark, in_memory=True)
    assert kept.storageLevel.useMemory and kept.storageLevel.useDisk and kept.count() == 2
    kept.unpersist()


def test_corpus_files_are_read_by_many_tasks(spark, tmp_path):
    """A corpus has four files however many rows it has: their row groups are what tasks share."""
    rows = spark.range(2400).select(
        F.col("id").alias("conv_id"),
        F.lit(0).cast("bigint").alias("turn"),
        F.lit("user").alias("role"),
        F.concat(F.repeat(F.lit("word of a turn "), 400), F.col("id").cast("string")).alias("text"),
    )
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    root = tables.corpus_dir(spark, str(tmp_path))
    for path in S.split_files(spark, root, "train"):
        footer = pq.read_metadata(path.removeprefix("file:"))
        assert footer.num_row_groups > 1
    scanned = S.scan_split(spark, root, "train", tables.corpus_schema(spark, str(tmp_path)))
    found = {(r[0], r[1]): r[2] for r in scanned.select("file_no", "row_index", "sid").collect()}
    want = {}
    for file_no in range(4):
        own = sorted(c * 100 for c in range(2400) if c % 4 == file_no and c % 10 < 8)
        want |= {(file_no, i): sid for i, sid in enumerate(own)}
    assert found == want


def test_driver_calls_do_not_grow_with_files(spark, tmp_path, monkeypatch):
    """The driver asks the JVM as often for 5 chunk files as for 105."""
    cfg = PipelineConfig(chunk_rows=10, chunks_per_task=30, position_block=1000)
    client, calls = spark.sparkContext._gateway._gateway_client, []
    send = client.send_command
    monkeypatch.setattr(client, "send_command", lambda *a, **k: calls.append(1) or send(*a, **k))
    spent = {}
    for n in (44, 1044):
        rows = spark.range(n).select(F.lit("a").alias("f"), F.col("id").alias("row"), F.lit(4).alias("length"))
        placed = H.assign_chunks(rows, "f", "row", (), 1, cfg)
        calls.clear()
        H.write_chunks(placed, n, str(tmp_path / f"out {n}"), "train", None, 1, cfg)
        spent[n] = len(calls)
        files = glob_paths(spark, f"{tmp_path}/out {n}/train_part_*.parquet")
        held = [pq.read_table(f.removeprefix("file:"))["position"].to_pylist() for f in files]
        assert [len(h) for h in held] == [10] * (n // 10) + [4] and sum(held, []) == list(range(n))
        names = [f.rsplit("/", 1)[-1] for f in files]
        assert sorted(os.listdir(tmp_path / f"out {n}")) == sorted(["_commits", *names, *(f".{x}.crc" for x in names)])
    assert spent[1044] < spent[44] + 100
    assert spark.read.parquet(*files).agg(F.sum("position")).first()[0] == 1044 * 1043 // 2
    with open(files[7].removeprefix("file:"), "r+b") as f:
        f.seek(4)
        f.write(b"\xff" * 20)
    with pytest.raises(Exception, match="Checksum"):
        spark.read.parquet(files[7]).collect()


def test_cut_batches():
    batches = [pa.record_batch({"x": list(range(a, b))}) for a, b in ((0, 3), (3, 3), (3, 14), (14, 20), (20, 21))]
    assert [t["x"].to_pylist() for t in H._cut(iter(batches), 5)] == [list(range(k, min(k + 5, 21))) for k in range(0, 21, 5)]
    assert list(H._cut(iter([]), 5)) == []
