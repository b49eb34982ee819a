"""From corpus rows to token samples, and what became of every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.config import DEFAULT, PipelineConfig
from voxloom.functions import codes as C
from voxloom.functions import text as X
from voxloom.schemas import require_columns

WRITTEN = "written"
QUARANTINED = "quarantined"
DROPPED_SHORT = "dropped_short"


def clean_rows(corpus: DataFrame, cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """Strip the text, settle the speaker and build the prefixed text; nothing is dropped yet."""
    require_columns(corpus, ["text"])
    stripped = corpus.withColumn("text", X.strip_text(F.col("text")))
    return stripped.withColumn("speaker", X.speaker_of(stripped, cfg)).withColumn(
        "tagged_text", X.with_speaker(F.col("text"), F.col("speaker"), cfg)
    )


def keep_long_enough(cleaned: DataFrame, cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """Rows whose text is long enough. Goes before any Arrow stage: filters do not pass through one."""
    return cleaned.where(X.long_enough(F.col("text"), cfg))


def short_rows(cleaned: DataFrame, cfg: PipelineConfig = DEFAULT, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """The complement of ``keep_long_enough``, as quarantine rows."""
    rows = cleaned.where(~X.long_enough(F.col("text"), cfg))
    return quarantine(rows, F.lit("text"), F.lit("short_text"), keys)


def quarantine(
    rows: DataFrame, stage: Column, reason: Column, keys: tuple[str, ...] = ("sample_id",)
) -> DataFrame:
    """Rows that were not written, with the stage and the reason."""
    return rows.select(*keys, stage.alias("stage"), reason.alias("reason"))


def split_outcome(staged: DataFrame, keys: tuple[str, ...] = ("sample_id",)) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantine rows of a stage that returned ``(stage, reason)`` next to its value."""
    good = staged.where(F.col("reason").isNull()).drop("stage", "reason")
    bad = quarantine(staged.where(F.col("reason").isNotNull()), F.col("stage"), F.col("reason"), keys)
    return good, bad


def to_samples(encoded: DataFrame, cfg: PipelineConfig = DEFAULT, text_ids: Column | None = None) -> DataFrame:
    """Flatten ``codes``, encode ``tagged_text`` and add ``length``; other columns pass through."""
    ids = X.utf8_ids(F.col("tagged_text")) if text_ids is None else text_ids
    arrays = encoded.withColumn("audio", C.flatten_codes(F.col("codes"))).withColumn(
        "text", ids.cast("array<int>")
    )
    return arrays.withColumn("length", C.sample_length(F.col("audio"), F.col("text"), cfg)).drop(
        "codes", "tagged_text"
    )


def without_done(corpus: DataFrame, done: DataFrame, keys: list[str] | str = "sample_id") -> DataFrame:
    """Rows not handled by an earlier run: an exact anti join on a stable key."""
    keys = [keys] if isinstance(keys, str) else keys
    return corpus.join(done.select(*keys).distinct(), keys, "left_anti")
