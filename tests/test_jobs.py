"""The command line runs a corpus through to exported batches."""

from types import SimpleNamespace

import pytest
from test_tokenize import write_file

from voxloom import jobs, session
from voxloom.operators import stats as ST


def test_corpus_to_batches(spark, tmp_path, capsys):
    corpus, tokens = str(tmp_path / "corpus"), str(tmp_path / "tokens")
    write_file(corpus, "train-00000-of-00001", 0, 20)
    write_file(corpus, "test-00000-of-00001", 0, 10)
    jobs.main(["tokenize", "--corpus", corpus, "--out", tokens])
    assert "train: RunCounts(seen=20" in capsys.readouterr().out
    jobs.main(["schedule", "--tokens", tokens, "--out", str(tmp_path / "plan"), "--epochs", "2", "--replicas", "2"])
    plan = spark.read.parquet(str(tmp_path / "plan/train"))
    n = spark.read.parquet(tokens + "/train*").count()
    assert plan.count() == 2 * n and plan.where("epoch = 1").select("idx").distinct().count() == n
    assert spark.read.parquet(str(tmp_path / "plan/eval")).count() == spark.read.parquet(tokens + "/test*").count()
    jobs.main(["export", "--tokens", tokens, "--out", str(tmp_path / "dense")])
    assert spark.read.parquet(str(tmp_path / "dense")).count() == n
    jobs.main(["stream", "--corpus", corpus, "--out", str(tmp_path / "live"), "--split", "train"])
    assert spark.read.parquet(str(tmp_path / "live/samples")).count() == n


def test_endless_schedule_and_listings(spark, tmp_path, capsys):
    corpus, tokens, out = (str(tmp_path / d) for d in ("corpus", "tokens", "endless"))
    write_file(corpus, "train-00000-of-00001", 0, 30)
    jobs.main(["tokenize", "--corpus", corpus, "--out", tokens])
    for _ in range(2):
        jobs.main(["endless", "--tokens", tokens, "--out", out, "--batch-size", "2", "--replicas", "2", "--bins-per-batch", "15"])
    jobs.main(["schedule", "--tokens", tokens, "--out", str(tmp_path / "plan"), "--epochs", "2", "--replicas", "2", "--batch-size", "2", "--order", "formula", "--full-check"])
    columns = ["epoch", "pos", "bin", "slot_in_bin", "idx"]
    streamed = spark.read.parquet(f"{out}/places").where("epoch < 2").select(*columns)
    planned = spark.read.parquet(str(tmp_path / "plan/train")).select(*columns)
    assert spark.read.parquet(f"{out}/places").select("epoch", "pos").distinct().count() == 30
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, planned.collect()))
    capsys.readouterr()
    jobs.main(["leftovers", "--tokens", tokens])
    assert capsys.readouterr().out == ""
    open(f"{tokens}/train_part_9.parquet", "wb").close()
    jobs.main(["leftovers", "--tokens", tokens])
    assert "train_part_9.parquet" in capsys.readouterr().out
    jobs.main(["files", "--tokens", tokens, "--split", "train"])
    listed = capsys.readouterr().out
    assert "train_part_0" in listed and "train_part_9" not in listed


def test_estimate(spark, capsys):
    jobs.main(["estimate"])
    out = capsys.readouterr().out
    assert "86.57 hours of audio per hour" in out and "TOTAL" in out
    rows = spark.createDataFrame([("a", 3600), ("a", 1800), (None, 7200)], "subset string, seconds bigint")
    got = {r["subset"]: r for r in ST.duration_estimate(rows, wall_hours=1.0, measured_audio_hours=10.0).collect()}
    assert got["a"]["audio_hours"] == 1.5 and got[None]["audio_hours"] == 2.0
    assert got["TOTAL"]["audio_hours"] == 3.5 and abs(got["TOTAL"]["est_days"] - 3.5 / 240) < 1e-12


def test_observed_count_comes_with_the_write(spark, tmp_path):
    df, seen = ST.observed(spark.range(37), "rows")
    df.write.parquet(str(tmp_path / "x"))
    assert seen.get["rows"] == 37


class FakeSession:
    """Just enough of a session to ask for its shared folder."""

    def __init__(self, master, folder):
        self.conf = {session.CHECKPOINT_DIR: folder} if folder else {}
        self.sparkContext = SimpleNamespace(master=master, applicationId=f"{master}-{folder}")


def test_scratch_folder_is_the_sessions(spark):
    assert session.scratch_root(FakeSession("yarn", "/shared/x/")) == "/shared/x"
    assert session.new_scratch(FakeSession("yarn", "/shared/x/"), "staged").startswith("/shared/x/staged-")
    named = spark.conf.get(session.CHECKPOINT_DIR, None)
    assert named is None or session.scratch_root(spark) == named


def test_only_a_local_master_may_use_a_temporary_folder():
    local = FakeSession("local[4]", None)
    assert session.scratch_root(local) == session.scratch_root(local)
    with pytest.raises(RuntimeError):
        session.scratch_root(FakeSession("yarn", None))
