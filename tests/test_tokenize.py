"""Whole runs: resuming, divisions, quarantine, streaming."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voxloom.config import PipelineConfig
from voxloom.plans import tokenize as P
from voxloom.schemas import AUDIO_CELL
from voxloom.sources import chunks as H
from voxloom.streaming.tokenize import dense_chunk_numbers, tokenize_stream

CFG = PipelineConfig(chunk_rows=4, position_block=5)
CELL = pa.struct([("bytes", pa.binary()), ("array", pa.list_(pa.float32())), ("channels", pa.int32()), ("sampling_rate", pa.int32())])


def write_file(root, name, start, n):
    """``n`` rows; every 5th has junk audio, every 7th a short text."""
    texts, cells = [], []
    for i in range(start, start + n):
        texts.append("short" if i % 7 == 3 else f"  this is row number {i} ")
        wave = {"bytes": None, "array": [0.01 * (i % 50)] * 2000, "channels": 1, "sampling_rate": 24000}
        cells.append({"bytes": b"junk", "array": None, "channels": None, "sampling_rate": None} if i % 5 == 2 else wave)
    os.makedirs(root, exist_ok=True)
    pq.write_table(pa.table({"text": texts, "audio": pa.array(cells, CELL)}), f"{root}/{name}.parquet")


def expected(n):
    short = {i for i in range(n) if i % 7 == 3}
    junk = {i for i in range(n) if i % 5 == 2} - short
    return set(range(n)) - short - junk, junk, short


def schema():
    from pyspark.sql import types as T

    return T.StructType([T.StructField("text", T.StringType()), T.StructField("audio", AUDIO_CELL)])


@pytest.fixture
def dirs(tmp_path):
    root = str(tmp_path / "corpus")
    for i in range(4):
        write_file(root, f"train-{i:05d}-of-00004", 10 * i, 10)
    write_file(root, "test-00000-of-00001", 0, 10)
    return root, str(tmp_path / "out")


def written(spark, out, split="train"):
    files = H.discover_datasets(spark, out, split)
    return spark.read.parquet(*[p for _, p in files])


def row_numbers(df):
    """Corpus row number of each sample, from its text."""
    rows = df.select("text", "position", "sample_id").collect()
    return [int(bytes(r["text"]).decode().rsplit(" ", 1)[-1]) for r in sorted(rows, key=lambda r: r["position"])]


def test_run_accounts_for_every_row(spark, dirs):
    root, out = dirs
    counts = P.tokenize_corpus(spark, root, out, schema(), CFG)
    good, junk, short = expected(40)
    assert counts["train"] == P.RunCounts(40, 0, len(good), len(junk), len(short))
    assert counts["validation"] == P.RunCounts()
    assert row_numbers(written(spark, out)) == sorted(good)
    aside = P.quarantine_rows(spark, out)
    assert {r["reason"] for r in aside.collect()} == {"unsupported_container", "short_text"}
    _, junk_of_test, short_of_test = expected(10)
    assert aside.count() == len(junk) + len(short) + len(junk_of_test) + len(short_of_test)
    sample = written(spark, out).where("position = 0").first()
    assert bytes(sample["text"]).decode() == "[999]this is row number 0"
    assert len(sample["audio"]) == 64 and sample["length"] == 2 + len(sample["text"]) + 1
    assert sample["sample_id"] == "corpus/train-00000-of-00004.parquet#0"


def test_second_run_does_nothing(spark, dirs):
    root, out = dirs
    P.tokenize_corpus(spark, root, out, schema(), CFG)
    before = sorted(os.listdir(out))
    again = P.tokenize_corpus(spark, root, out, schema(), CFG)
    assert again["train"] == P.RunCounts(40, 40) and sorted(os.listdir(out)) == before


def test_new_files_are_appended(spark, dirs):
    root, out = dirs
    P.tokenize_split(spark, root, out, "train", schema(), CFG)
    write_file(root, "train-00004-of-00005", 40, 10)
    counts = P.tokenize_split(spark, root, out, "train", schema(), CFG)
    assert counts.skipped == 40 and counts.seen == 50
    df = written(spark, out)
    assert df.count() == len(expected(50)[0]) == df.select("sample_id").distinct().count()
    sizes = {r["chunk_no"]: r["count"] for r in df.groupBy("chunk_no").count().collect()}
    assert sorted(sizes) == list(range(1, len(sizes) + 1)) and max(sizes.values()) <= 4


@pytest.mark.parametrize("limit", [200_000, 0])
def test_crash_between_chunks_and_quarantine(spark, dirs, limit):
    """Written rows are not written again; rows set aside are tried again, once."""
    root, out = dirs
    cfg = PipelineConfig(chunk_rows=4, position_block=5, broadcast_rows=limit)
    P.tokenize_split(spark, root, out, "train", schema(), cfg)
    os.rename(out + "_quarantine", out + "_lost")
    good, junk, short = expected(40)
    again = P.tokenize_split(spark, root, out, "train", schema(), cfg)
    assert again == P.RunCounts(40, len(good), 0, len(junk), len(short))
    df = written(spark, out)
    assert df.count() == len(good) and row_numbers(df) == sorted(good)
    assert P.tokenize_split(spark, root, out, "train", schema(), cfg).skipped == 40


def test_crash_before_the_chunks_are_committed(spark, dirs, monkeypatch):
    root, out = dirs

    def fail(*a, **k):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(H, "write_chunks", fail)
        with pytest.raises(RuntimeError):
            P.tokenize_split(spark, root, out, "train", schema(), CFG)
    assert P.tokenize_split(spark, root, out, "train", schema(), CFG).written == len(expected(40)[0])
    assert row_numbers(written(spark, out)) == sorted(expected(40)[0])


def test_retry_of_quarantined_rows(spark, dirs):
    import numpy as np

    root, out = dirs
    P.tokenize_split(spark, root, out, "train", schema(), CFG)
    decoder = P.Encoders(decode=lambda data: (np.zeros((1, 100)), 24000))
    counts = P.tokenize_split(spark, root, out, "train", schema(), CFG, decoder, retry_quarantine=True)
    good, junk, short = expected(40)
    assert counts.written == len(junk) and counts.skipped == len(good)
    df = written(spark, out)
    assert df.count() == df.select("sample_id").distinct().count() == len(good) + len(junk)


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_divisions_add_up_to_one_run(spark, dirs, n):
    root, out = dirs
    for d in range(n):
        P.tokenize_corpus(spark, root, out, schema(), CFG, division=d, n_divisions=n)
    good, _, _ = expected(40)
    df = written(spark, out)
    texts = sorted(int(bytes(r["text"]).decode().rsplit(" ", 1)[-1]) for r in df.select("text").collect())
    assert texts == sorted(good)
    assert written(spark, out, "test").count() == len(expected(10)[0])
    names = {f.rsplit("/")[-1].split("_part_")[0] for _, f in H.discover_datasets(spark, out, "train")}
    assert names == {f"train_div{d}" for d in range(min(n, 4))}


def test_changing_the_number_of_divisions_repeats_nothing(spark, dirs):
    root, out = dirs
    P.tokenize_corpus(spark, root, out, schema(), CFG, division=0, n_divisions=2)
    for d in range(3):
        P.tokenize_corpus(spark, root, out, schema(), CFG, division=d, n_divisions=3)
    df = written(spark, out)
    assert df.count() == df.select("sample_id").distinct().count() == len(expected(40)[0])


def test_two_corpora_with_the_same_file_names(spark, dirs, tmp_path):
    root, out = dirs
    other = str(tmp_path / "more")
    write_file(other, "train-00000-of-00004", 100, 10)
    first = P.tokenize_split(spark, root, out, "train", schema(), CFG)
    second = P.tokenize_split(spark, other, out, "train", schema(), CFG)
    assert second.skipped == 0 and second.seen == 10
    df = written(spark, out)
    assert df.count() == first.written + second.written == df.select("sample_id").distinct().count()
    assert P.tokenize_split(spark, other, out, "train", schema(), CFG).skipped == 10


def test_stream_equals_batch_and_goes_on(spark, dirs):
    root, out = dirs
    P.tokenize_split(spark, root, out, "train", schema(), CFG)
    live = out + "_live"
    tokenize_stream(spark, root, live, "train", schema(), CFG, files_per_batch=2).awaitTermination()
    columns = ["sample_id", "audio", "text", "length"]

    def rows(df):
        return sorted(map(str, df.select(*columns).collect()))

    assert rows(spark.read.parquet(f"{live}/samples")) == rows(written(spark, out))
    aside = spark.read.parquet(f"{live}/quarantine")
    good, junk, short = expected(40)
    assert aside.count() == len(junk) + len(short)

    write_file(root, "train-00004-of-00005", 40, 10)
    tokenize_stream(spark, root, live, "train", schema(), CFG, files_per_batch=2).awaitTermination()
    df = spark.read.parquet(f"{live}/samples")
    assert df.select("batch_id").distinct().count() == 3
    assert df.count() == len(expected(50)[0]) == df.select("sample_id").distinct().count()
    numbers = dense_chunk_numbers(df).groupBy("chunk_no").count().collect()
    assert sorted(r["chunk_no"] for r in numbers) == list(range(1, len(numbers) + 1))
    assert max(r["count"] for r in numbers) <= 4


def test_replayed_batch_overwrites_itself(spark, dirs):
    from voxloom.streaming.tokenize import KEYS, write_batch
    from voxloom.sources import corpus as S

    root, out = dirs
    rows = S.scan_split(spark, root, "train", schema())
    rows = rows.withColumn("sample_id", S.sample_id(F.col("file_name"), F.col("row_index"), "corpus"))
    for _ in range(2):
        write_batch(rows, 0, out, "train", CFG, P.Encoders())
    assert spark.read.parquet(f"{out}/samples").count() == len(expected(40)[0])
    assert set(KEYS) <= set(spark.read.parquet(f"{out}/samples").columns)


def test_batches_are_numbered_through_by_their_commits(spark, dirs):
    """Replays keep their numbers, batches that were not listed are not there."""
    from voxloom.sources import corpus as S
    from voxloom.sources.commits import CommitConflict
    from voxloom.streaming.tokenize import stream_samples, write_batch

    root, out = dirs
    rows = S.scan_split(spark, root, "train", schema())
    rows = rows.withColumn("sample_id", S.sample_id(F.col("file_name"), F.col("row_index"), "corpus"))
    parts = [rows.where(F.col("file_name").startswith(f"train-0000{i}")) for i in range(3)]

    def numbers():
        found = stream_samples(spark, out).groupBy("batch_id").agg(F.sort_array(F.collect_set("chunk_no")).alias("n"))
        return {r["batch_id"]: r["n"] for r in found.collect()}

    for i in (0, 1, 0, 2, 1):
        write_batch(parts[i], i, out, "train", CFG, P.Encoders())
    seen = numbers()
    assert sorted(n for own in seen.values() for n in own) == list(range(1, sum(map(len, seen.values())) + 1))
    assert seen[0][-1] < seen[1][0] and seen[1][-1] < seen[2][0]
    with pytest.raises(CommitConflict):
        write_batch(rows, 1, out, "train", CFG, P.Encoders())
    os.rename(f"{out}/samples/_commits/000000000002.json", f"{out}/samples/_commits/.lost")
    assert set(numbers()) == {0, 1}


def test_counts_come_from_the_writing_job(spark, dirs, monkeypatch):
    from voxloom.operators import stats as ST

    root, out = dirs
    good, junk, short = expected(40)
    from voxloom.sources import corpus as S

    rows = S.scan_split(spark, root, "train", schema())
    rows = rows.withColumn("sample_id", S.sample_id(F.col("file_name"), F.col("row_index"), "corpus"))
    watched, counted = ST.observed_outcomes(P.outcomes(rows, CFG))
    watched.write.parquet(out)
    assert counted.get == {"written": len(good), "quarantined": len(junk), "dropped_short": len(short)}
    nothing, counted = ST.observed_outcomes(P.outcomes(rows.where("false"), CFG))
    nothing.write.parquet(out + "2")
    assert counted.get == {"written": 0, "quarantined": 0, "dropped_short": 0}
