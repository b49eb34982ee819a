"""Shape changes of audio codes, and the sample length rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.config import DEFAULT, PipelineConfig
from voxloom.functions.arrays import int_div


def flatten_codes(codes: Column) -> Column:
    """``[codebooks][frames]`` to one codebook-major list of 32-bit integers."""
    return F.flatten(codes).cast("array<int>")


def frame_count(audio: Column, cfg: PipelineConfig = DEFAULT) -> Column:
    """Frames in a flat code list."""
    return int_div(F.size(audio), cfg.n_codebooks).cast("int")


def whole_codes(audio: Column, cfg: PipelineConfig = DEFAULT) -> Column:
    """The flat list itself; a list that is empty or does not divide into codebooks stops the job
    rather than shifting every cell after it."""
    broken = F.raise_error(F.lit("audio codes do not divide into whole frames"))
    return F.when(has_whole_frames(audio, cfg), audio).otherwise(broken.cast("array<int>"))


def sample_length(audio: Column, text: Column, cfg: PipelineConfig = DEFAULT) -> Column:
    """Audio frames, plus text tokens, plus the end frame."""
    return (frame_count(audio, cfg) + F.size(text) + 1).cast("int")


def has_whole_frames(audio: Column, cfg: PipelineConfig = DEFAULT) -> Column:
    """True when the flat list divides evenly into codebooks."""
    return (F.size(audio) > 0) & (F.size(audio) % cfg.n_codebooks == 0)


def reshape_codes(audio: Column, cfg: PipelineConfig = DEFAULT) -> Column:
    """Flat list back to ``[codebooks][frames]``; null where it does not divide evenly."""
    frames = frame_count(audio, cfg)
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(cfg.n_codebooks - 1)),
        lambda c: F.slice(audio, c * frames + 1, frames),
    )
    return F.when(has_whole_frames(audio, cfg), rows)


def is_consistent(audio: Column, text: Column, length: Column, cfg: PipelineConfig = DEFAULT) -> Column:
    """True when a stored ``length`` agrees with the arrays next to it."""
    return has_whole_frames(audio, cfg) & (length == sample_length(audio, text, cfg))
