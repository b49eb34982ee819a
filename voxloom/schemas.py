"""Declared schemas, and the one check each input gets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

AUDIO_CELL = T.StructType(
    [
        T.StructField("bytes", T.BinaryType()),
        T.StructField("array", T.ArrayType(T.FloatType())),
        T.StructField("channels", T.IntegerType()),
        T.StructField("sampling_rate", T.IntegerType()),
    ]
)

# Chunk files hold 64-bit integers when another tool wrote them and 32-bit ones when we did;
# Parquet readers widen but do not narrow, so the wide type reads both.
CHUNK_FILE = T.StructType(
    [
        T.StructField("audio", T.ArrayType(T.LongType())),
        T.StructField("text", T.ArrayType(T.LongType())),
        T.StructField("length", T.LongType()),
    ]
)

# With the sum of what a row serves, which only our own files have.
SERVED_FILE = T.StructType([*CHUNK_FILE.fields, T.StructField("cells", T.LongType())])

QUARANTINE = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)


class MissingColumnsError(ValueError):
    """A required input column is absent."""


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Fail at analysis time when a required column is missing, instead of row by row."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise MissingColumnsError(f"missing required columns: {', '.join(missing)}")
    return df
