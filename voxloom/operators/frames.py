"""Frame layout of samples: text rows, then audio rows, then one end row.

Frames are kept sparse, one row ``(.., pos, slot, token)`` per valid cell: slots 0 to 31 hold the
codebooks, slot 32 the text. A row being there *is* the mask. Dense padded tensors appear only in
``dense_batches``, the export for trainers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.config import DEFAULT, SUBSAMPLE_DIVISOR, PipelineConfig
from voxloom.functions.arrays import int_div
from voxloom.functions.codes import frame_count, whole_codes
from voxloom.functions.ordering import shuffle_key

# Dense cells laid out at a time by one worker.
DENSE_CELLS = 4_000_000

KIND_TEXT, KIND_AUDIO, KIND_END = "text", "audio", "end"


def _sizes(cfg: PipelineConfig) -> tuple[Column, Column]:
    """Text tokens and audio frames of a sample."""
    return F.size("text"), frame_count(whole_codes(F.col("audio"), cfg), cfg)


def sparse_frames(samples: DataFrame, keys: Sequence[str], cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """``(keys, kind, pos, slot, token)`` of every valid cell of every sample.

    One scan and one explode: text, audio and the zeros of the end frame are laid end to end, and
    position and slot follow from the place in that list by arithmetic. No shuffle.
    """
    books = cfg.n_codebooks
    cells = F.concat("text", whole_codes(F.col("audio"), cfg), F.array_repeat(F.lit(0), books))
    flat = samples.select(
        *keys,
        F.size("text").alias("__n"),
        frame_count(F.col("audio"), cfg).alias("__t"),
        F.posexplode(cells).alias("__i", "token"),
    )
    n, t = F.col("__n"), F.col("__t")
    k = F.col("__i") - n
    is_text, is_audio = k < 0, k < t * books
    frames = F.greatest(t, F.lit(1))
    return flat.select(
        *keys,
        F.when(is_text, KIND_TEXT).when(is_audio, KIND_AUDIO).otherwise(KIND_END).alias("kind"),
        F.when(is_text, F.col("__i")).when(is_audio, n + k % frames).otherwise(n + t).cast("int").alias("pos"),
        F.when(is_text, cfg.text_slot)
        .when(is_audio, int_div(k, frames))
        .otherwise(k - t * books)
        .cast("int")
        .alias("slot"),
        "token",
    )


def text_frames(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("kind") == KIND_TEXT).drop("kind")


def audio_frames(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("kind") == KIND_AUDIO).drop("kind")


def end_frames(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("kind") == KIND_END).drop("kind")


def frame_mask(samples: DataFrame, keys: Sequence[str], cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """Valid cells per position: ``(keys, pos, audio_valid, text_valid)``, without any token."""
    n, t = _sizes(cfg)
    return samples.select(
        *keys, n.alias("__n"), F.explode(F.sequence(F.lit(0), (n + t).cast("int"))).alias("pos")
    ).select(
        *keys,
        "pos",
        (F.col("pos") >= F.col("__n")).alias("audio_valid"),
        (F.col("pos") < F.col("__n")).alias("text_valid"),
    )


def target_frames(frames: DataFrame, cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """Cells a model has to predict: audio slots, the end frame included, without the text slot."""
    return frames.where(F.col("slot") < cfg.text_slot)


def valid_positions(frames: DataFrame, keys: Sequence[str], cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """Positions that are not padding. A valid position has slot 0 or the text slot, never both."""
    return frames.where((F.col("slot") == 0) | (F.col("slot") == cfg.text_slot)).select(*keys, "pos")


def context_pairs(samples: DataFrame, keys: Sequence[str], cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """``(keys, context_pos, target_pos)``: a position predicts the audio row that follows it.

    A sample without text has no position before its first audio row; it is left out here and
    found by ``without_context``.
    """
    n, t = _sizes(cfg)
    return (
        samples.where(F.size("text") > 0)
        .select(*keys, F.explode(F.sequence(n, (n + t).cast("int"))).alias("target_pos"))
        .select(*keys, (F.col("target_pos") - 1).alias("context_pos"), "target_pos")
    )


def without_context(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples that ``context_pairs`` leaves out."""
    return samples.where(F.size("text") == 0).select(*keys)


def split_targets(frames: DataFrame, cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """Target cells with the part of the model that learns them: codebook 0, or the others."""
    part = F.when(F.col("slot") == 0, "first").otherwise("rest")
    return target_frames(frames, cfg).withColumn("part", part)


def subsample_frames(
    samples: DataFrame, epoch: int, cfg: PipelineConfig = DEFAULT, key: str = "idx"
) -> DataFrame:
    """``(bin, key, pos, pick)``: a random sixteenth of the target rows of every batch.

    ``floor(n / 16)`` rows, none below 16. A batch is at most ``batch_size`` samples, so the
    window sorts one batch at a time.
    """
    n, t = _sizes(cfg)
    rows = samples.select(
        "bin", key, F.explode(F.sequence(n, (n + t).cast("int"))).alias("pos")
    ).withColumn("__key", shuffle_key(cfg.seed, F.lit(epoch), F.col(key), F.col("pos")))
    batch = W.partitionBy("bin")
    order = batch.orderBy("__key", key, "pos")
    return (
        rows.withColumn("pick", F.row_number().over(order))
        .withColumn("__quota", int_div(F.count(F.lit(1)).over(batch), SUBSAMPLE_DIVISOR))
        .where(F.col("pick") <= F.col("__quota"))
        .select("bin", key, "pos", "pick")
    )


def pad_lengths(samples: DataFrame) -> DataFrame:
    """Longest sample of every batch: the length all its samples are padded to."""
    return samples.groupBy("bin").agg(F.max("length").alias("pad_length"))


def with_pad_length(bins: DataFrame) -> DataFrame:
    """Add ``pad_length`` to every sample of a batch; one shuffle of the narrow table of bins."""
    return bins.withColumn("pad_length", F.max("length").over(W.partitionBy("bin")))


#: What a row of a padded sample holds: a text id, codes (or the end after them), nothing.
TEXT, AUDIO, PAD = 0, 1, 2


def dense_batches(batched: DataFrame, cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """Padded tensors, one row ``(bin, slot_in_bin, idx, pad_length, tokens, mask)`` per sample.

    ``tokens`` and ``mask`` are ``[pad_length][33]``. ``batched`` carries ``pad_length``, so no
    batch has to be gathered: each sample is laid out on its own, a whole Arrow batch at a time.
    """
    books, width = cfg.n_codebooks, cfg.frame_width
    keys = ["bin", "slot_in_bin", "idx", "pad_length"]
    source = batched.select(*keys, "audio", "text")
    schema = T.StructType(
        [
            *[source.schema[k] for k in keys],
            T.StructField("tokens", T.ArrayType(T.ArrayType(T.IntegerType()))),
            T.StructField("mask", T.ArrayType(T.ArrayType(T.BooleanType()))),
        ]
    )

    def nested(flat: np.ndarray, lengths: np.ndarray, value_type: pa.DataType) -> pa.Array:
        rows = np.arange(0, (lengths.sum() + 1) * width, width, dtype=np.int32)
        inner = pa.ListArray.from_arrays(pa.array(rows), pa.array(flat, type=value_type))
        outer = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(outer), inner)

    def fill(part: pa.RecordBatch, lengths: np.ndarray) -> pa.RecordBatch:
        """All samples of a part at once: one scatter for text ids and one for codes."""
        flat, sizes = {}, {}
        for name in ("audio", "text"):
            column = part.column(name)
            if column.null_count:
                raise ValueError(f"a sample without {name} cannot be laid out")
            flat[name] = column.flatten().to_numpy(zero_copy_only=False)
            sizes[name] = np.diff(column.offsets.to_numpy()).astype(np.int64)
        n_text, n_frames = sizes["text"], sizes["audio"] // books
        need = n_text + n_frames + 1
        wrong = np.flatnonzero((need > lengths) | (sizes["audio"] % books != 0))
        if wrong.size:
            row = wrong[0]
            raise ValueError(f"sample {part.column('idx')[row]} needs {need[row]} rows and is padded to {lengths[row]}")
        first_text = np.cumsum(lengths) - lengths
        kind = np.repeat(np.tile([TEXT, AUDIO, PAD], lengths.size), np.stack([n_text, n_frames + 1, lengths - need], axis=1).ravel())
        tokens = np.zeros((kind.size, width), np.int32)
        tokens[kind == TEXT, books] = flat["text"]
        # Codes lie codebook by codebook; frame by frame they fill the rows after the text.
        size = sizes["audio"]
        place = np.arange(flat["audio"].size) - np.repeat(np.cumsum(size) - size, size)
        book, frame = np.divmod(place, np.repeat(n_frames, size))
        tokens.ravel()[(np.repeat(first_text + n_text, size) + frame) * width + book] = flat["audio"]
        mask = np.empty((kind.size, width), bool)
        mask[:, :books], mask[:, books] = (kind == AUDIO)[:, None], kind == TEXT
        return pa.RecordBatch.from_arrays(
            [
                *[part.column(k) for k in keys],
                nested(tokens.ravel(), lengths, pa.int32()),
                nested(mask.ravel(), lengths, pa.bool_()),
            ],
            names=schema.fieldNames(),
        )

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("pad_length").to_numpy(zero_copy_only=False).astype(np.int64)
            # Padding multiplies the size, so a batch is handed back in parts of bounded size.
            part_no = np.cumsum(lengths * width) // DENSE_CELLS
            cuts = [0, *(np.flatnonzero(np.diff(part_no)) + 1), len(lengths)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if stop > start:
                    yield fill(batch.slice(start, stop - start), lengths[start:stop])

    return source.mapInArrow(lay_out, schema)


def weighted_sum(token: Column, pos: Column, slot: Column, cfg: PipelineConfig = DEFAULT) -> Column:
    """Aggregate: a checksum that depends on where every token stands."""
    place = pos.cast("bigint") * cfg.frame_width + slot + 1
    return F.sum(token.cast("bigint") * place).cast("bigint")


def dense_sums(dense: DataFrame, cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """``(bin, slot_in_bin, idx, n_frames, n_cells, n_valid, checksum)`` of every row of ``dense_batches``.

    ``checksum`` is that of ``weighted_sum`` over all cells, padding included. Every cell is read, a whole
    Arrow batch at a time: the sums are differences of running sums, so no cell becomes an object.
    """
    width = cfg.frame_width
    source = dense.select("bin", "slot_in_bin", "idx", "tokens", "mask")
    schema = T.StructType(
        [
            *source.schema.fields[:3],
            T.StructField("n_frames", T.IntegerType()),
            T.StructField("n_cells", T.IntegerType()),
            T.StructField("n_valid", T.LongType()),
            T.StructField("checksum", T.LongType()),
        ]
    )

    def offsets(lists: pa.Array) -> np.ndarray:
        """Where each list begins in ``flatten()``, and where the last one ends."""
        found = lists.offsets.to_numpy().astype(np.int64)
        return found - found[0]

    def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[at])

    def weigh(part: pa.RecordBatch) -> pa.RecordBatch:
        tokens, mask = part.column("tokens"), part.column("mask")
        if tokens.null_count or mask.null_count:
            raise ValueError("a sample without tokens or mask cannot be weighed")
        rows, cells = offsets(tokens), offsets(tokens.flatten())
        size = np.diff(cells)
        pos = np.arange(size.size) - np.repeat(rows[:-1], np.diff(rows))
        place = np.arange(cells[-1]) + np.repeat(pos * width + 1 - cells[:-1], size)
        token = tokens.flatten().flatten().to_numpy(zero_copy_only=False)
        valid = mask.flatten().flatten().to_numpy(zero_copy_only=False)
        set_cells = sums(valid, offsets(mask.flatten())[offsets(mask)])
        found = [np.diff(rows).astype(np.int32), np.diff(cells[rows]).astype(np.int32), set_cells, sums(token * place, cells[rows])]
        return pa.RecordBatch.from_arrays([*part.columns[:3], *map(pa.array, found)], names=schema.fieldNames())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            part_no = np.cumsum(lengths.astype(np.int64) * width) // DENSE_CELLS
            cuts = [0, *(np.flatnonzero(np.diff(part_no)) + 1), len(lengths)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if stop > start:
                    yield weigh(batch.slice(start, stop - start))

    return source.mapInArrow(each, schema)
