"""Frame layout against a small dense computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.config import PipelineConfig
from voxloom.functions import codes as C
from voxloom.operators import frames as R
from voxloom.operators import schedule as B
from voxloom.operators.index import inconsistent_samples

CFG = PipelineConfig(batch_size=4)


def make(n, seed, texts=(1, 30), frames=(1, 9)):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = rng.randint(*frames)
        audio = [rng.randrange(2048) for _ in range(32 * t)]
        text = [rng.randrange(1, 256) for _ in range(rng.randint(*texts))]
        rows.append((i, audio, text, t + len(text) + 1))
    return rows


def dense(row):
    """Tokens and mask of one sample, unpadded."""
    _, audio, text, length = row
    tokens, mask = np.zeros((length, 33), int), np.zeros((length, 33), bool)
    n = len(text)
    tokens[:n, 32], mask[:n, 32] = text, True
    tokens[n:-1, :32] = np.array(audio).reshape(32, -1).T
    mask[n:, :32] = True
    return tokens, mask


@pytest.fixture(scope="module")
def rows():
    return make(23, 1)


@pytest.fixture(scope="module")
def samples(spark, rows):
    return spark.createDataFrame(rows, "idx bigint, audio array<int>, text array<int>, length int").repartition(3).cache()


def cells_of(rows, slots=range(33)):
    out = set()
    for row in rows:
        tokens, mask = dense(row)
        for p, s in zip(*np.nonzero(mask)):
            if s in slots:
                out.add((row[0], int(p), int(s), int(tokens[p, s])))
    return out


def test_sparse_cells_are_the_masked_dense_cells(samples, rows):
    frames = R.sparse_frames(samples, ["idx"])
    got = frames.drop("kind").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == cells_of(rows)
    targets = R.target_frames(frames).drop("kind").collect()
    assert {tuple(r) for r in targets} == cells_of(rows, range(32))
    kinds = {r["kind"]: r["count"] for r in frames.groupBy("kind").count().collect()}
    assert kinds["end"] == 32 * len(rows) and kinds["text"] == sum(len(r[2]) for r in rows)
    parts = R.split_targets(frames)
    assert parts.where("part = 'first' and slot <> 0").count() == 0
    assert parts.where("part = 'rest' and slot = 0").count() == 0


def test_masks_and_pairs(samples, rows):
    mask = {(r["idx"], r["pos"]): (r["audio_valid"], r["text_valid"]) for r in R.frame_mask(samples, ["idx"]).collect()}
    want, pairs, valid = {}, set(), set()
    for row in rows:
        _, m = dense(row)
        for p in range(row[3]):
            want[row[0], p] = (bool(m[p, 0]), bool(m[p, 32]))
            valid.add((row[0], p))
        predicts = np.roll(m[:, 0], -1)
        pairs |= {(row[0], int(p), int(p) + 1) for p in np.flatnonzero(predicts)}
    assert mask == want
    got = R.context_pairs(samples, ["idx"]).select("idx", "context_pos", "target_pos").collect()
    assert {tuple(r) for r in got} == pairs and len(got) == len(pairs)
    positions = R.valid_positions(R.sparse_frames(samples, ["idx"]), ["idx"]).collect()
    assert {tuple(r) for r in positions} == valid and len(positions) == len(valid)


def test_samples_without_text_are_reported(spark):
    df = spark.createDataFrame([(0, [1] * 32, [], 2), (1, [1] * 32, [5], 3)], "idx bigint, audio array<int>, text array<int>, length int")
    assert {r["idx"] for r in R.context_pairs(df, ["idx"]).collect()} == {1}
    assert [r["idx"] for r in R.without_context(df, ["idx"]).collect()] == [0]
    cells = R.sparse_frames(df.where("idx = 0"), ["idx"]).collect()
    assert len(cells) == 64 and {r["pos"] for r in cells} == {0, 1}


@pytest.mark.parametrize("budget", [4_000_000, 33 * 40, 1])
def test_dense_batches(spark, samples, rows, monkeypatch, budget):
    monkeypatch.setattr(R, "DENSE_CELLS", budget)
    bins = B.length_bins(samples.select("idx", "length"), CFG)
    batched = bins.drop("length").join(samples, "idx").join(R.pad_lengths(bins), "bin").coalesce(1)
    got = R.dense_batches(batched, CFG).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: r[3])
    for r in got:
        batch = order[r["bin"] * 4 : r["bin"] * 4 + 4]
        pad = max(b[3] for b in batch)
        tokens, mask = dense(batch[r["slot_in_bin"]])
        assert r["idx"] == batch[r["slot_in_bin"]][0] and r["pad_length"] == pad
        fill = ((0, pad - len(tokens)), (0, 0))
        np.testing.assert_array_equal(np.array(r["tokens"]), np.pad(tokens, fill))
        np.testing.assert_array_equal(np.array(r["mask"]), np.pad(mask, fill))


@pytest.mark.parametrize("budget", [4_000_000, 33 * 40, 1])
def test_dense_sums_read_every_cell(spark, samples, monkeypatch, budget):
    """The sums of a dense export equal those of its cells, however it is cut, and no lambda walks the cells."""
    monkeypatch.setattr(R, "DENSE_CELLS", budget)
    bins = B.length_bins(samples.select("idx", "length"), CFG)
    batched = bins.drop("length").join(samples, "idx").join(R.pad_lengths(bins), "bin").coalesce(1)
    exported = R.dense_batches(batched, CFG)
    want = set()
    for r in exported.collect():
        tokens, mask = np.array(r["tokens"]), np.array(r["mask"])
        place = np.arange(tokens.shape[0])[:, None] * 33 + np.arange(33) + 1
        want.add((r["bin"], r["slot_in_bin"], r["idx"], tokens.shape[0], tokens.size, int(mask.sum()), int((tokens * place).sum())))
    sums = R.dense_sums(exported, CFG)
    assert {tuple(r) for r in sums.collect()} == want
    assert "lambda" not in sums._jdf.queryExecution().optimizedPlan().toString()
    assert R.dense_sums(exported.where("idx < 0"), CFG).count() == 0


def test_subsample_takes_a_sixteenth_of_every_batch(spark):
    rows = make(30, 2, frames=(1, 40))
    samples = spark.createDataFrame(rows, "idx bigint, audio array<int>, text array<int>, length int")
    binned = samples.withColumn("bin", F.col("idx") % 4)
    got = R.subsample_frames(binned, 0, CFG).collect()
    totals = {b: sum(len(r[1]) // 32 + 1 for r in rows if r[0] % 4 == b) for b in range(4)}
    assert {b: sum(1 for g in got if g["bin"] == b) for b in range(4)} == {b: n // 16 for b, n in totals.items()}
    spans = {r[0]: (len(r[2]), r[3]) for r in rows}
    assert all(spans[g["idx"]][0] <= g["pos"] < spans[g["idx"]][1] for g in got)
    again = R.subsample_frames(binned.repartition(5), 0, CFG).collect()
    assert set(got) == set(again)
    assert set(got) != set(R.subsample_frames(binned, 1, CFG).collect())


def test_no_subsample_below_sixteen(spark):
    rows = make(1, 3, frames=(14, 14))
    samples = spark.createDataFrame(rows, "idx bigint, audio array<int>, text array<int>, length int")
    assert R.subsample_frames(samples.withColumn("bin", F.lit(0)), 0, CFG).count() == 0


def test_codes_round_trip(spark):
    df = spark.createDataFrame([(list(range(96)),), (list(range(33)),), ([],)], "audio array<int>")
    got = df.select(C.reshape_codes(F.col("audio")).alias("c"), F.col("audio")).collect()
    assert np.array_equal(np.array(got[0]["c"]), np.arange(96).reshape(32, 3))
    assert got[1]["c"] is None and got[2]["c"] is None
    back = df.where("size(audio) = 96").select(C.flatten_codes(C.reshape_codes(F.col("audio")))).first()[0]
    assert back == list(range(96))


@pytest.mark.parametrize("audio", [[1] * 33, []])
def test_broken_codes_stop_the_job(spark, audio):
    df = spark.createDataFrame([(0, audio, [5], 3)], "idx bigint, audio array<int>, text array<int>, length int")
    for frames in (R.sparse_frames(df, ["idx"]), R.frame_mask(df, ["idx"]), R.context_pairs(df, ["idx"])):
        with pytest.raises(Exception, match="whole frames"):
            frames.collect()
    assert inconsistent_samples(df).count() == 1


def test_stored_length_is_checked(spark):
    df = spark.createDataFrame([([0] * 64, [1, 2], 5), ([0] * 64, [1, 2], 4), ([0] * 65, [1], 4)], "audio array<int>, text array<int>, length int")
    got = [r[0] for r in df.select(C.is_consistent(F.col("audio"), F.col("text"), F.col("length"))).collect()]
    assert got == [True, False, False]
