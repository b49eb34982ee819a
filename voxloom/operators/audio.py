"""Audio stages as partition-parallel Arrow jobs.

Each stage is a ``mapInArrow`` over the rows it is given: Spark decides the partitions, a worker
builds its encoder once per task and streams batch after batch. Failures of one row become a
``(stage, reason)`` pair next to a null value; the row is never lost and never stops the task.
Keep ``spark.sql.execution.arrow.maxRecordsPerBatch`` small for long recordings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.config import DEFAULT, PipelineConfig
from voxloom.functions import audio as A
from voxloom.functions.arrays import int_div
from voxloom.schemas import require_columns

Decoder = Callable[[bytes], tuple[np.ndarray, int]]


class AudioEncoder(Protocol):
    """Turns a mono waveform at the configured rate into ``[n_codebooks, n_frames]`` codes."""

    def encode(self, mono: np.ndarray) -> np.ndarray: ...


class TextEncoder(Protocol):
    """Turns a text into token ids."""

    def encode(self, text: str) -> list[int]: ...


# Output values (samples, codes) a worker collects before it hands a batch back.
BATCH_VALUES = 4_000_000


def _numbers(column: pa.Array, row: int) -> np.ndarray | None:
    """One list of an Arrow list column as an array, without a copy through Python objects."""
    cell = column[row]
    return cell.values.to_numpy(zero_copy_only=False) if cell.is_valid else None


def _cells(column: pa.StructArray) -> Iterator[dict]:
    """The audio structs of a batch, their arrays as numpy views."""
    raw, arrays, channels, rates = (column.field(n) for n in ("bytes", "array", "channels", "sampling_rate"))
    present = column.is_valid().to_pylist()
    for row, here in enumerate(present):
        yield {
            "bytes": raw[row].as_py() if here else None,
            "array": _numbers(arrays, row) if here else None,
            "channels": channels[row].as_py(),
            "sampling_rate": rates[row].as_py(),
        }


def _lists(values: list[np.ndarray | None], arrow_type: pa.DataType) -> pa.Array:
    """Arrays of one or two dimensions (or nulls) as an Arrow list column."""
    missing = pa.array([v is None for v in values])
    found = [v for v in values if v is not None]
    sizes = [0 if v is None else len(v) for v in values]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    if pa.types.is_list(arrow_type.value_type):
        widths = [v.shape[1] for v in found for _ in range(v.shape[0])]
        inner = pa.array(np.concatenate([[0], np.cumsum(widths)]).astype(np.int32))
        flat = np.concatenate([v.ravel() for v in found]) if found else np.empty(0)
        leaf = pa.array(flat, type=arrow_type.value_type.value_type)
        items = pa.ListArray.from_arrays(inner, leaf)
    else:
        flat = np.concatenate(found) if found else np.empty(0)
        items = pa.array(flat, type=arrow_type.value_type)
    return pa.ListArray.from_arrays(offsets, items, mask=missing)


def _map_cells(
    df: DataFrame,
    value: str,
    value_type: T.DataType,
    arrow_type: pa.DataType,
    stage: str,
    setup: Callable[[], Callable[[dict], np.ndarray]],
) -> DataFrame:
    """Replace ``audio`` by ``value``, ``stage`` and ``reason``, one Arrow batch at a time."""
    passed = [f for f in df.schema.fields if f.name != "audio"]
    schema = T.StructType(
        [
            *passed,
            T.StructField(value, value_type),
            T.StructField("stage", T.StringType()),
            T.StructField("reason", T.StringType()),
        ]
    )

    def attempt(work, cell) -> tuple[np.ndarray | None, str | None]:
        try:
            return work(cell), None
        except A.UnsupportedAudio as exc:
            return None, str(exc)
        except Exception as exc:  # one bad row must not stop the others
            return None, f"{type(exc).__name__}: {exc}"

    def pack(batch: pa.RecordBatch, start: int, results: list) -> pa.RecordBatch:
        part = batch.slice(start, len(results))
        reasons = [reason for _, reason in results]
        return pa.RecordBatch.from_arrays(
            [
                *[part.column(f.name) for f in passed],
                _lists([v for v, _ in results], arrow_type),
                pa.array([stage if r else None for r in reasons], type=pa.string()),
                pa.array(reasons, type=pa.string()),
            ],
            names=schema.fieldNames(),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            start, results, held = 0, [], 0
            for cell in _cells(batch.column("audio")):
                results.append(attempt(work, cell))
                held += 0 if results[-1][0] is None else results[-1][0].size
                if held > BATCH_VALUES:
                    yield pack(batch, start, results)
                    start, results, held = start + len(results), [], 0
            if results:
                yield pack(batch, start, results)

    return df.mapInArrow(run, schema)


def decode_channels(df: DataFrame, decoder: Decoder = A.decode_wav) -> DataFrame:
    """Decode ``audio`` to ``channels_data`` (one float list per channel), without mixing or resampling."""
    require_columns(df, ["audio"])

    def setup():
        def work(cell):
            return A.decode(cell, decoder)[0].astype(np.float32)

        return work

    floats = T.ArrayType(T.ArrayType(T.FloatType()))
    return _map_cells(df, "channels_data", floats, pa.list_(pa.list_(pa.float32())), "decode", setup)


def standardise_audio(
    df: DataFrame, cfg: PipelineConfig = DEFAULT, decoder: Decoder = A.decode_wav
) -> DataFrame:
    """Decode, mix down and resample ``audio`` to a mono ``waveform`` at the configured rate."""
    require_columns(df, ["audio"])
    rate = cfg.sample_rate

    def setup():
        return lambda cell: A.standardise(cell, decoder, rate)

    return _map_cells(df, "waveform", T.ArrayType(T.DoubleType()), pa.list_(pa.float64()), "decode", setup)


def resample_in_blocks(df: DataFrame, cfg: PipelineConfig = DEFAULT, seconds: int = 60) -> DataFrame:
    """Resample long decoded recordings in blocks that separate tasks filter: a row per block.

    ``audio`` cells must hold ``array`` with one channel. The result has the other columns and ``block``,
    ``first`` (number of the block's first output sample) and ``waveform``; blocks of a recording laid end to
    end are what ``standardise_audio`` gives. A block is cut with the samples that its filter looks at on
    either side, so blocks need nothing of each other; a recording is cut in the JVM and then spread, and no
    Python worker ever holds more than a block of it. Recordings without samples, or with a rate that is not
    positive, have no block.
    """
    require_columns(df, ["audio"])
    rate, new_rate = F.col("audio.sampling_rate"), cfg.sample_rate
    passed = [f for f in df.schema.fields if f.name != "audio"]
    keys = [F.col(f"`{f.name}`") for f in passed]
    reach = F.ceil(F.lit(A.LOWPASS_WIDTH) * rate / (F.least(rate, F.lit(new_rate)) * A.ROLLOFF)).cast("int") + 1
    n, size = F.size("audio.array"), rate * seconds
    cut = (
        df.where((rate > 0) & (n > 0) & (F.coalesce("audio.channels", F.lit(1)) == 1))
        .withColumn("__row", F.monotonically_increasing_id())
        .select(*keys, "audio", "__row", F.explode(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1)).alias("block"))
        .withColumn("__from", F.greatest(F.col("block") * size - reach, F.lit(0)))
        .select(
            *keys,
            "__row",
            "block",
            rate.alias("__rate"),
            (F.col("block") * size - F.col("__from")).alias("__before"),
            F.least(n - F.col("block") * size, size).alias("__n"),
            F.slice("audio.array", F.col("__from") + 1, F.col("block") * size + size + reach - F.col("__from")).alias("__piece"),
        )
        # A fixed number: filtering costs more than its bytes tell, so few bytes are no reason for few tasks.
        .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__row", "block")
    )
    schema = T.StructType(
        [*passed, T.StructField("block", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("waveform", T.ArrayType(T.DoubleType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [batch.column(c).to_pylist() for c in ("block", "__rate", "__before", "__n")]
            for row, (block, own_rate, before, n) in enumerate(zip(*numbers, strict=True)):
                orig, new = A.reduced_rates(own_rate, new_rate)
                piece = _numbers(batch.column("__piece"), row).astype(np.float64)
                wave = A.resample_block(piece, before, n, own_rate, new_rate)[: -(-new * n // orig)]
                part = batch.slice(row, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(f.name) for f in passed],
                        pa.array([block], pa.int32()),
                        pa.array([block * seconds * new_rate], pa.int64()),
                        _lists([wave], pa.list_(pa.float64())),
                    ],
                    names=schema.fieldNames(),
                )

    return cut.mapInArrow(run, schema)


def encode_audio(
    df: DataFrame,
    cfg: PipelineConfig = DEFAULT,
    make_encoder: Callable[[], AudioEncoder] | None = None,
    decoder: Decoder = A.decode_wav,
) -> DataFrame:
    """Decode, mix down, resample and encode ``audio`` to ``codes`` in one pass over the rows.

    ``make_encoder`` runs once per task, on the worker; the waveform never leaves it.
    """
    require_columns(df, ["audio"])
    rate, n_codebooks, vocab = cfg.sample_rate, cfg.n_codebooks, cfg.audio_vocab
    factory = make_encoder or (lambda: A.LatticeEncoder(n_codebooks))

    def setup():
        encoder = factory()

        def work(cell):
            mono = A.standardise(cell, decoder, rate)
            if mono.size == 0:
                raise A.UnsupportedAudio("empty_audio")
            codes = np.asarray(encoder.encode(mono))
            if codes.shape[0] != n_codebooks or codes.min() < 0 or codes.max() >= vocab:
                raise A.UnsupportedAudio("bad_codes")
            return codes.astype(np.int32)

        return work

    ints = T.ArrayType(T.ArrayType(T.IntegerType()))
    return _map_cells(df, "codes", ints, pa.list_(pa.list_(pa.int32())), "audio", setup)


def text_encoder_column(make_encoder: Callable[[], TextEncoder], text: Column) -> Column:
    """Token ids from a plug-in text encoder, built once per task."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else list(encoder.encode(t)))

    return encode(text)


class TokenizerJson:
    """Text encoder backed by a local tokenizer definition file present on every worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)

    def encode(self, text: str) -> list[int]:
        return self._tokenizer.encode(text).ids


def downmix_planar(samples: Column, channels: int) -> Column:
    """Mean over channels of a planar ``[channel 0 .., channel 1 ..]`` list, without Python."""
    n = int_div(F.size(samples), channels).cast("int")
    total = F.slice(samples, F.lit(1), n)
    for c in range(1, channels):
        total = F.zip_with(total, F.slice(samples, n * c + 1, n), lambda a, b: a + b)
    return F.transform(total, lambda x: x / F.lit(channels))
