"""Runs appear whole or not at all; catalogue; bitmaps of done rows; content sums."""

import os
import re
from threading import Thread

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_files import chunk
from test_plans import plan

from voxloom.config import PipelineConfig
from voxloom.operators import done as D
from voxloom.plans import serve
from voxloom.sources import catalogue as C
from voxloom.sources import chunks as H
from voxloom.sources import commits as M
from voxloom.sources.files import create_if_absent, get_text

CFG = PipelineConfig(chunk_rows=10, chunks_per_task=2)


def run_threads(*calls):
    threads = [Thread(target=c) for c in calls]
    for t in threads:
        t.start()
    for t in threads:
        t.join()


def test_only_one_creates(spark, tmp_path):
    path, made = f"{tmp_path}/deep/er/x y.json", []
    run_threads(*[lambda i=i: made.append((i, create_if_absent(spark, path, f"text é {i}" * 1000))) for i in range(8)])
    winners = [i for i, ok in made if ok]
    assert len(made) == 8 and len(winners) == 1
    assert get_text(spark, path) == f"text é {winners[0]}" * 1000
    assert [n for n in os.listdir(f"{tmp_path}/deep/er") if "json" not in n] == []


def rows_of(spark, n, tag="a"):
    audio = F.array_repeat((F.col("id") % 100).cast("int"), 32)
    text = F.array(F.lit(1), F.lit(2))
    rows = spark.range(n).select(F.lit(tag).alias("f"), F.col("id").alias("row"), audio.alias("audio"), text.alias("text"), F.lit(4).alias("length"))
    return rows.withColumn("cells", H.content_sum())


def write(spark, out, n, tag="a", first=1, division=None, moved=None, cfg=CFG):
    placed = H.assign_chunks(rows_of(spark, n, tag), "f", "row", (), first, cfg)
    return H.write_chunks(placed, n, out, "train", division, first, cfg, moved=moved)


def numbers(spark, out):
    rows = H.committed_samples(spark, out, "f string, row bigint").groupBy("f", "chunk_no").count().collect()
    return {(r["f"], r["chunk_no"]): r["count"] for r in rows}


def test_runs_that_race_get_numbers_of_their_own(spark, tmp_path):
    """Both start from chunk 1; whoever is listed second is moved behind the first."""
    out = str(tmp_path / "out")
    run_threads(*[lambda t=t, n=n: write(spark, out, n, t) for t, n in (("a", 35), ("b", 52), ("c", 7))])
    found = numbers(spark, out)
    assert sorted(no for _, no in found) == list(range(1, 12))
    for tag, n in (("a", 35), ("b", 52), ("c", 7)):
        own = sorted((no, c) for (f, no), c in found.items() if f == tag)
        assert [no for no, _ in own] == list(range(own[0][0], own[0][0] + len(own)))
        assert sum(c for _, c in own) == n and all(c == 10 for _, c in own[:-1])
    assert H.next_chunk_number(spark, out, "train") == 12 and H.next_chunk_number(spark, out, "train", 0) == 1
    assert H.existing_count(spark, out, "train") == 94


def test_a_killed_run_is_not_there(spark, tmp_path):
    out = str(tmp_path / "out")
    write(spark, out, 25, "a")
    seen = []

    def die(name):
        seen.append(name)
        if len(seen) == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        write(spark, out, 60, "b", first=4, moved=die)
    left = [p.rsplit("/", 1)[-1] for p in M.left_over(spark, out, H.CHUNKS)]
    assert sorted(left) == sorted(seen) and set(left) <= set(os.listdir(out))
    assert len(H.discover_datasets(spark, out, "train")) == 3 and H.existing_count(spark, out, "train") == 25
    assert serve.build_index(spark, out, "train").n_samples == 25
    assert H.next_chunk_number(spark, out, "train") == 4
    write(spark, out, 12, "b", first=4)
    assert numbers(spark, out) == {("a", 1): 10, ("a", 2): 10, ("a", 3): 5, ("b", 4): 10, ("b", 5): 2}


def test_files_of_other_tools_are_kept(spark, tmp_path):
    """Those that were there before the first run count; later ones are nobody's."""
    out = str(tmp_path / "out")
    chunk(f"{out}/train_part_003.parquet", [5, 6])
    chunk(f"{out}/test_part_001.parquet", [7])
    first = H.next_chunk_number(spark, out, "train")
    assert first == 4
    write(spark, out, 15, first=first)
    chunk(f"{out}/train_part_900.parquet", [8])
    index = serve.build_index(spark, out, "train")
    assert sorted(r["length"] for r in index.index.collect()) == [4] * 15 + [5, 6]
    assert serve.build_index(spark, out, "test").n_samples == 1
    assert H.next_chunk_number(spark, out, "train") == 6
    assert [c.run for c in M.read_commits(spark, out)][0] == "adopted" and len(M.read_commits(spark, out)) == 2


def test_commit_gives_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "create_if_absent", lambda *a: False)
    with pytest.raises(M.CommitConflict):
        M.commit(spark, str(tmp_path), M.Commit("x"), attempts=3)


@pytest.mark.parametrize("name", ["plain", "with blank", "50%25"])
def test_catalogue(spark, tmp_path, name):
    root = str(tmp_path / name)
    chunk(f"{root}/b/train_part_002.parquet", [5, 6])
    chunk(f"{root}/b/train_div3_part_010.parquet", [5])
    chunk(f"{root}/a/validation_part_final.parquet", [5])
    chunk(f"{root}/a/notes.parquet", [5])
    os.makedirs(f"{root}/_hidden")
    with open(f"{root}/a/train_part_7.parquet", "wb") as f:
        f.write(b"junk")
    write(spark, f"{root}/c", 15, first=5)
    columns = ["dataset", "split", "division", "chunk_no", "n_rows", "has_sums", "max_chunk"]
    rows = sorted((tuple(r) for r in C.catalogue(spark, root).select(*columns).collect()), key=repr)
    assert rows == sorted(
        [
            ("a", "train", None, 7, None, None, 7), ("a", "validation", None, None, 1, False, None), ("b", "train", None, 2, 2, False, 2),
            ("b", "train", 3, 10, 1, False, 10), ("c", "train", None, 5, 10, True, 5), ("c", "train", None, 6, 5, True, 6),
        ],
        key=repr,
    )
    assert C.catalogue(spark, root, "validation").count() == 1 and C.catalogue(spark, root, dataset="b").count() == 2
    listed = {(r["dataset"], r["path"]) for r in C.catalogue(spark, root, "train").collect()}
    assert listed == set(H.discover_datasets(spark, root, "train"))
    assert {tuple(r) for r in C.next_chunks(C.catalogue(spark, root)).collect()} == {
        ("a", "train", None, 8), ("a", "validation", None, 1), ("b", "train", None, 3), ("b", "train", 3, 11), ("c", "train", None, 7)
    }
    assert {tuple(r) for r in H.sample_counts(spark, root).collect()} == {("a", "validation", 1), ("b", "train", 3), ("c", "train", 15)}
    uris = {r["uri"] for r in C.readable(C.catalogue(spark, root, "train")).collect()}
    read = spark.read.parquet(*[p for d, p in listed if d != "a"]).select("_metadata.file_path").distinct().collect()
    assert {r[0] for r in read} == uris


def test_catalogue_of_nothing(spark, tmp_path):
    assert C.catalogue(spark, str(tmp_path / "none")).count() == 0
    assert H.existing_count(spark, str(tmp_path / "none"), "train") == 0


def test_filters_settle_what_is_opened(spark, tmp_path):
    root = str(tmp_path)
    for d in "abc":
        for split in ("train", "test"):
            chunk(f"{root}/{d}/{split}_part_1.parquet", [3])
    reader = C._PushedFooters(root, None, None)
    left = list(reader.pushFilters([C.EqualTo(("split",), "train"), C.In(("dataset",), ("a", "c", "x")), C.EqualTo(("path",), "p")]))
    assert [f.attribute for f in left] == [("path",)]
    assert [(d, s) for d, s, *_ in reader.listed()] == [("a", "train"), ("c", "train")]
    spark.conf.set(C.PUSHDOWN, "true")
    try:
        found = C.catalogue(spark, root).where("split = 'test' and dataset in ('a', 'b') and n_rows = 1")
        assert {(r["dataset"], r["split"]) for r in found.collect()} == {("a", "test"), ("b", "test")}
    finally:
        spark.conf.unset(C.PUSHDOWN)


# done rows


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sets(st.integers(0, 100_000) | st.sampled_from([0, 1, 7, 8, 32766, 32767, 32768, 65535, 65536]), max_size=30), min_size=1, max_size=3))
def test_bitmaps_say_what_is_done(spark, runs):
    rows = "file_name string, row_index bigint"
    parts = [D.done_bits(spark.createDataFrame([("f", i) for i in s] * 2, rows), "d") for s in runs]
    bits = D.merged(H.union_datasets(parts))
    every = set().union(*runs)
    asked = sorted(every | {i + 1 for i in every} | {0, 32767, 32768})
    left = D.without_marked(spark.createDataFrame([(f, i) for f in "fg" for i in asked], rows), bits, 1, 10**9)
    assert left.columns == ["file_name", "row_index"]
    assert {tuple(r) for r in left.collect()} == {("f", i) for i in asked if i not in every} | {("g", i) for i in asked}
    counts = {r["file_name"]: (r["n_done"], r["n_blocks"]) for r in D.done_per_file(bits).collect()}
    assert counts == ({"f": (len(every), len({i // 32768 for i in every}))} if every else {})


def test_bitmaps_meet_rows_by_file_and_block(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([], "file_name string, row_index bigint, audio array<int>")
        bits = spark.createDataFrame([], D.SCHEMA)
        assert "Broadcast" in plan(D.without_marked(rows, bits, 10, 10_000))
        text = plan(D.without_marked(rows, bits, 1000, 10_000))
        assert "Broadcast" not in text and re.search(r"hashpartitioning\(file_name#\d+, block#\d+L", text)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# content sums


def bend(path):
    """Change one code of a sound file and leave the sums as they are."""
    table = pq.read_table(path)
    audio = table.column("audio").to_pylist()
    audio[3][5] += 1
    pq.write_table(table.set_column(table.schema.get_field_index("audio"), "audio", pa.array(audio, pa.list_(pa.int32()))), path)
    folder, name = os.path.split(path)
    os.remove(f"{folder}/.{name}.crc")  # what the local file system keeps beside a file; object stores have none


def test_damage_is_found_by_the_scan_that_serves(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    write(spark, out, 35)
    path = H.discover_datasets(spark, out, "train")[1][1].removeprefix("file:")
    assert serve.batches(spark, serve.build_index(spark, out, "train")).count() == 35
    bend(path)
    with monkeypatch.context() as m:
        m.setattr(H, "damaged_files", lambda *a: pytest.fail("arrays are read before they are served"))
        index = serve.build_index(spark, out, "train")
    assert index.n_samples == 35
    with pytest.raises(Exception, match="damaged arrays in row 3 of"):
        serve.batches(spark, index, CFG).write.format("noop").mode("overwrite").save()
    with pytest.raises(Exception, match="damaged arrays in row 3 of"):
        serve.export_batches(spark, out, "train", str(tmp_path / "dense"), CFG)
    whole = serve.build_index(spark, out, "train", check="full")
    assert whole.n_samples == 25 and serve.batches(spark, whole, CFG).count() == 25
    report = H.damaged_files(spark, C.catalogue(spark, out)).collect()
    assert [(r["path"].removeprefix("file:"), r["footer_rows"], r["read_rows"]) for r in report] == [(path, 10, 9)]


def test_index_of_own_files_reads_lengths_only(spark, tmp_path):
    out = str(tmp_path / "out")
    write(spark, out, 12)
    found = H.sound_files(spark, out, "train")
    assert re.search(r"ReadSchema: struct<length:bigint(,_tmp_metadata_row_index:bigint)?>", plan(H.scan_lengths(spark, found)))
    scan = plan(H.scan_chunks(spark, found))
    assert scan.count("FileScan") == 1 and "cells:bigint" in scan and "Exchange" not in scan


# samples by row group


def test_samples_are_read_by_row_groups(spark, tmp_path):
    """Only the groups that hold a requested sample are read: the others are rubbish here."""
    root = str(tmp_path / "with blank")
    os.makedirs(root)
    lists = pa.list_(pa.int64())
    for k, n in ((0, 500), (1, 7)):
        rows = {"audio": pa.array([[k * 1000 + i] * 32 for i in range(n)], lists), "text": pa.array([[i] for i in range(n)], lists), "length": pa.array([3] * n, pa.int64())}
        pq.write_table(pa.table(rows), f"{root}/train_part_{k}.parquet", row_group_size=100, use_dictionary=False, compression="zstd")
    path = f"{root}/train_part_0.parquet"
    meta = pq.read_metadata(path)
    with open(path, "r+b") as f:
        for g in (0, 1, 4):
            for c in range(3):
                column = meta.row_group(g).column(c)
                f.seek(column.data_page_offset)
                f.write(b"\xff" * column.total_compressed_size)
    asked = spark.createDataFrame([(i,) for i in (200, 399, 250, 250, 500, 506, -1, 507)], "idx bigint")
    got = {r["idx"]: (r["audio"], r["text"], r["length"], r["row_index"]) for r in serve.fetch_samples(spark, root, "train", asked).collect()}
    first = {200: 0, 250: 50, 399: 99}
    want = {i: ([i] * 32, [i], 3, r) for i, r in first.items()} | {i: ([500 + i] * 32, [i - 500], 3, i - 500) for i in (500, 506)}
    assert got == want
    with pytest.raises(Exception):
        serve.fetch_samples(spark, root, "train", spark.createDataFrame([(5,)], "idx bigint")).collect()


def test_fetched_samples_are_checked(spark, tmp_path):
    out = str(tmp_path / "out")
    write(spark, out, 35)
    asked = spark.range(35).withColumnRenamed("id", "idx")
    rows = serve.fetch_samples(spark, out, "train", asked)
    assert "collect" not in plan(rows) and rows.count() == 35
    assert {r["idx"]: r["audio"] for r in rows.collect()} == {i: [i] * 32 for i in range(35)}
    bend(H.discover_datasets(spark, out, "train")[2][1].removeprefix("file:"))
    assert serve.fetch_samples(spark, out, "train", asked.where("idx < 20")).collect()
    with pytest.raises(Exception, match="damaged arrays in row 3 of"):
        serve.fetch_samples(spark, out, "train", asked).collect()


def test_arrays_are_moved_once_for_an_export(spark, tmp_path):
    out = str(tmp_path / "out")
    write(spark, out, 57)
    index = serve.build_index(spark, out, "train")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = serve.placed_samples(index, CFG, bins_per_file=2, groups_per_task=2)
        lines = plan(rows).splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    reading = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    assert sum("Exchange" in line for line in lines[:reading]) == 1
    assert all("audio" not in line for line in lines[reading + 1 :])
    found = {r["idx"]: (r["bin"], r["slot_in_bin"], r["pad_length"], r["audio"], r["text"]) for r in rows.collect()}
    want = {r["idx"]: (r["bin"], r["slot_in_bin"], r["pad_length"], r["audio"], r["text"]) for r in serve.batches(spark, index, CFG).collect()}
    assert found == want and len(want) == 57
