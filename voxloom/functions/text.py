"""Transcript cleaning as native column expressions, and the bundled text encoder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.config import DEFAULT, PipelineConfig

# The 29 code points Python's str.strip() removes.
PY_WHITESPACE_CODES = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20,
    0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
PY_WHITESPACE = "".join(map(chr, PY_WHITESPACE_CODES))


def strip_text(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace, not just spaces."""
    return F.btrim(text, F.lit(PY_WHITESPACE))


def long_enough(stripped: Column, cfg: PipelineConfig = DEFAULT) -> Column:
    """True when the stripped text has the minimum number of code points (null is too short)."""
    return F.coalesce(F.length(stripped) >= cfg.min_text_chars, F.lit(False))


def speaker_of(df: DataFrame, cfg: PipelineConfig = DEFAULT, column: str = "speaker") -> Column:
    """Speaker label of each row, with the default where the column or the value is absent."""
    if column not in df.columns:
        return F.lit(cfg.default_speaker)
    fallback = "None" if cfg.strict_null_speaker else cfg.default_speaker
    return F.coalesce(F.col(column).cast("string"), F.lit(fallback))


def with_speaker(text: Column, speaker: Column, cfg: PipelineConfig = DEFAULT) -> Column:
    """``[speaker]text``, or the bare text when speakers are switched off."""
    return text if cfg.omit_speaker else F.concat(F.lit("["), speaker, F.lit("]"), text)


def _bytes_of(texts: pa.Array) -> pa.Array:
    """Byte values of a whole batch of strings: Arrow already stores them as UTF-8, end to end."""
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    ids = pa.array(raw[offsets[0] : offsets[-1]].astype(np.int32))
    starts = pa.array((offsets - offsets[0]).astype(np.int32))
    return pa.ListArray.from_arrays(starts, ids, mask=texts.is_null() if texts.null_count else None)


def utf8_ids(text: Column) -> Column:
    """UTF-8 byte values of a text as token ids.

    Measured on one core over 25 MB of text: 0.6 s this way, 5.6 s with ``transform`` over the
    binary form, and quadratic time with substrings of the text or of its hex form.
    """
    return F.arrow_udf(_bytes_of, "array<int>")(text)
