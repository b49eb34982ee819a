"""Decoding, mixing, resampling and encoding against plain computations."""

import io
import math
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.config import PipelineConfig
from voxloom.functions import audio as A
from voxloom.operators import audio as O
from voxloom.schemas import AUDIO_CELL


def wav(channels, width, rate, frames: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(frames)
    return out.getvalue()


def direct_resample(x, orig, new):
    """The textbook sum, one output at a time."""
    g = math.gcd(orig, new)
    orig, new = orig // g, new // g
    cutoff = min(orig, new) * 0.99
    out = []
    for j in range(math.ceil(len(x) * new / orig)):
        total = 0.0
        for i, v in enumerate(x):
            d = (i / orig - j / new) * cutoff
            if abs(d) < 6:
                sinc = 1.0 if d == 0 else math.sin(math.pi * d) / (math.pi * d)
                total += v * sinc * math.cos(math.pi * d / 12) ** 2 * cutoff / orig
        out.append(total)
    return out


@pytest.mark.parametrize(("orig", "new", "n"), [(16000, 24000, 50), (48000, 24000, 101), (44100, 24000, 200), (24000, 16000, 7), (8000, 24000, 1)])
def test_resample_equals_the_direct_sum(orig, new, n):
    x = np.random.default_rng(n).normal(size=n)
    got = A.resample(x, orig, new)
    assert len(got) == math.ceil(n * new / orig)
    np.testing.assert_allclose(got, direct_resample(x, orig, new), atol=1e-12)


def test_resample_keeps_a_tone():
    t = np.arange(4800) / 16000
    got = A.resample(np.sin(2 * np.pi * 440 * t), 16000, 24000)
    want = np.sin(2 * np.pi * 440 * np.arange(7200) / 24000)
    assert np.abs(got - want)[200:-200].max() < 2e-2


def test_wav_widths():
    eight = A.decode_wav(wav(1, 1, 8000, bytes([0, 128, 255])))
    np.testing.assert_allclose(eight[0], [[-1.0, 0.0, 127 / 128]])
    sixteen, rate = A.decode_wav(wav(2, 2, 44100, struct.pack("<4h", 1, -2, 32767, -32768)))
    assert rate == 44100
    np.testing.assert_allclose(sixteen * 32768, [[1, 32767], [-2, -32768]])
    wide = A.decode_wav(wav(1, 3, 8000, b"\x01\x00\x00" + b"\xff\xff\xff" + b"\xff\xff\x7f"))[0]
    np.testing.assert_allclose(wide * (1 << 23), [[1, -1, (1 << 23) - 1]])
    full = A.decode_wav(wav(1, 4, 8000, struct.pack("<2i", -(2**31), 5)))[0]
    np.testing.assert_allclose(full * 2**31, [[-(2**31), 5]])


def encode_slowly(mono):
    """Nearest codeword by trying all 2,025 of them, residual by subtraction."""
    frames = math.ceil(len(mono) / 1920)
    padded = list(mono) + [0.0] * (frames * 1920 - len(mono))
    result = []
    for f in range(frames):
        left = [sum(padded[f * 1920 + b * 120 : f * 1920 + (b + 1) * 120]) / 120 for b in range(16)]
        codes, step = [], 2 / 45
        grid = None
        for _ in range(4):
            grid = [(g - 22) * step for g in range(45)]
            for pair in range(8):
                picked = [min(range(45), key=lambda g: abs(left[2 * pair + k] - grid[g])) for k in (0, 1)]
                codes.append(picked[0] * 45 + picked[1])
                for k in (0, 1):
                    left[2 * pair + k] -= grid[picked[k]]
            step /= 45
        result.append(codes)
    return np.array(result).T


def test_encoder_equals_an_exhaustive_search():
    x = np.random.default_rng(9).uniform(-0.9, 0.9, size=1920 * 2 + 300)
    got = A.LatticeEncoder().encode(x)
    assert got.shape == (32, 3) and got.max() < 2048
    np.testing.assert_array_equal(got[:24], encode_slowly(x)[:24])


def cells(spark, rows):
    return spark.createDataFrame(rows, "id int, audio struct<bytes:binary,array:array<float>,channels:int,sampling_rate:int>")


def test_stage_keeps_every_row(spark):
    tone = [0.5] * 4000
    junk = b"ID3 not a wave file"
    rows = [
        (0, (None, tone, 1, 24000)),
        (1, (wav(1, 2, 24000, struct.pack("<3h", 1, 2, 3)), None, None, None)),
        (2, (junk, None, None, None)),
        (3, (None, None, None, None)),
        (4, None),
        (5, (junk, tone, 1, 24000)),
        (6, (None, [1.0, 2.0, 3.0], 2, 24000)),
        (7, (None, [], 1, 24000)),
        (8, (None, tone, 1, 0)),
        (9, (None, [0.2, 0.4, 0.6, 0.8], 2, 24000)),
        (10, (None, tone, None, 48000)),
    ]
    got = {r["id"]: r for r in O.encode_audio(cells(spark, rows)).collect()}
    assert len(got) == len(rows)
    reasons = {i: r["reason"] for i, r in got.items() if r["reason"]}
    assert reasons == {
        2: "unsupported_container",
        3: "no_audio",
        4: "no_audio",
        6: "bad_channel_count",
        7: "empty_audio",
        8: "bad_sampling_rate",
    }
    assert all(len(r["codes"]) == 32 for i, r in got.items() if i not in reasons)
    assert len(got[0]["codes"][0]) == 3 and len(got[10]["codes"][0]) == 2
    assert got[5]["codes"] == got[0]["codes"]


def test_downmix_native_and_numpy_agree(spark):
    rows = [(0, (None, [0.25, 0.5, -1.0, 0.75], 2, 24000))]
    native = cells(spark, rows).select(O.downmix_planar(F.col("audio.array"), 2).alias("m")).first()[0]
    arrow = O.standardise_audio(cells(spark, rows)).first()["waveform"]
    assert native == arrow == [-0.375, 0.625]


def test_plug_ins(spark):
    class Constant:
        def encode(self, mono):
            return np.full((32, 2), len(mono) % 2000)

    class Broken:
        def encode(self, mono):
            return np.full((31, 2), 1)

    class Words:
        def encode(self, text):
            return [len(w) for w in text.split()]

    rows = cells(spark, [(0, (b"12345", None, None, None))])
    decoded = O.encode_audio(rows, make_encoder=Constant, decoder=lambda b: (np.zeros((1, len(b))), 24000)).first()
    assert decoded["codes"] == [[5, 5]] * 32
    assert O.encode_audio(rows, make_encoder=Broken, decoder=lambda b: (np.zeros((1, 9)), 24000)).first()["reason"] == "bad_codes"
    ids = spark.createDataFrame([("to be or",), (None,)], "t string").select(O.text_encoder_column(Words, F.col("t")).alias("i"))
    assert [r["i"] for r in ids.collect()] == [[2, 2, 2], None]


def test_local_tokenizer_definition(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = str(tmp_path / "tokenizer.json")
    made = Tokenizer(models.WordLevel({"a": 5, "b": 6, "?": 0}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    made.save(path)
    df = spark.createDataFrame([("a b c",)], "t string")
    ids = df.select(O.text_encoder_column(lambda: O.TokenizerJson(path), F.col("t")).alias("i"))
    assert ids.first()["i"] == [5, 6, 0]


def test_large_results_are_handed_back_in_parts(spark, monkeypatch):
    monkeypatch.setattr(O, "BATCH_VALUES", 10)
    rows = [(i, (None, [0.1] * (i + 1), 1, 24000)) for i in range(40)]
    got = O.standardise_audio(cells(spark, rows).coalesce(1)).collect()
    assert {r["id"]: len(r["waveform"]) for r in got} == {i: i + 1 for i in range(40)}


def test_schema_is_declared():
    assert AUDIO_CELL.fieldNames() == ["bytes", "array", "channels", "sampling_rate"]
    assert PipelineConfig().frame_width == 33


@pytest.mark.parametrize(("rate", "new_rate"), [(16, 24), (24, 16), (441, 240), (8, 8), (7, 24), (48, 8)])
def test_blocks_laid_end_to_end_are_the_whole(spark, rate, new_rate):
    rng = np.random.default_rng(rate)
    waves = [rng.uniform(-1, 1, n).astype(np.float32) for n in (1, rate - 1, rate, rate + 1, 5 * rate, 5 * rate + 3, 17 * rate + rate // 2)]
    rows = [(i, (None, w.tolist(), 1, rate)) for i, w in enumerate(waves)]
    rows += [(90, (None, [], 1, rate)), (91, (None, [0.5], 1, 0)), (92, None), (93, (None, None, 1, rate))]
    found = O.resample_in_blocks(cells(spark, rows), PipelineConfig(sample_rate=new_rate), seconds=1).collect()
    assert {r["id"] for r in found} == set(range(len(waves)))
    for i, w in enumerate(waves):
        own = sorted((r for r in found if r["id"] == i), key=lambda r: r["block"])
        assert [r["first"] for r in own] == [k * new_rate for k in range(-(-w.size // rate))]
        whole = A.resample(w.astype(np.float64), rate, new_rate)
        assert np.allclose(np.concatenate([r["waveform"] for r in own]), whole, rtol=0, atol=1e-12)


def test_a_long_recording_is_spread_over_tasks(spark):
    """Ten hours, at a low rate: blocks of ten minutes in many tasks, none with all of them."""
    n = 10 * 3600 * 100
    cell = F.struct(F.lit(None).cast("binary").alias("bytes"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i % 50 / 50.0).cast("float")).alias("array"), F.lit(1).alias("channels"), F.lit(100).alias("sampling_rate"))
    blocks = O.resample_in_blocks(spark.range(1).select("id", cell.alias("audio")), PipelineConfig(sample_rate=40), seconds=600)
    spread = blocks.select(F.spark_partition_id().alias("p"), F.size("waveform").alias("n"), "block").collect()
    assert len(spread) == 60 and sum(r["n"] for r in spread) == n * 2 // 5
    assert len({r["p"] for r in spread}) >= 4
