"""Run counters and corpus-hour estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from voxloom.config import MEASURED_AUDIO_HOURS, MEASURED_WALL_HOURS
from voxloom.operators.tokenize import DROPPED_SHORT, QUARANTINED, WRITTEN


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with a live row count that is filled by the job that writes it: no second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def observed_outcomes(outcomes: DataFrame) -> tuple[DataFrame, Observation]:
    """``outcomes`` (with ``stage`` and ``reason``) and its rows per outcome, counted by the job that writes it.

    The job must have a single stage, as a narrow one has: there every task counts once, however often it runs.
    """
    seen = Observation()
    kept, short = F.col("reason").isNull(), F.col("stage") == "text"
    counts = {WRITTEN: kept, DROPPED_SHORT: ~kept & short, QUARANTINED: ~kept & ~short}
    return outcomes.observe(seen, *[F.count_if(c).alias(name) for name, c in counts.items()]), seen


def estimate_hours(audio_hours: Column, wall_hours: float, measured_audio_hours: float) -> Column:
    """Processing time at the measured rate."""
    return audio_hours * F.lit(wall_hours / measured_audio_hours)


def duration_estimate(
    recordings: DataFrame,
    subset: str = "subset",
    seconds: str = "seconds",
    wall_hours: float = MEASURED_WALL_HOURS,
    measured_audio_hours: float = MEASURED_AUDIO_HOURS,
) -> DataFrame:
    """Hours of audio per subset, processing hours and days, and a ``TOTAL`` line.

    ``seconds`` should be an integer (or decimal) column so that sums are exact in any order.
    """
    # Sums per subset first, so the roll-up multiplies a handful of rows and not the corpus.
    per_subset = recordings.groupBy(subset).agg(F.sum(seconds).alias("__seconds"))
    hours = F.sum("__seconds") / F.lit(3600.0)
    label = F.when(F.grouping(subset) == 1, "TOTAL").otherwise(F.col(subset))
    return (
        per_subset.rollup(subset)
        .agg(label.alias("line"), hours.alias("audio_hours"))
        .withColumn("est_hours", estimate_hours(F.col("audio_hours"), wall_hours, measured_audio_hours))
        .select(
            F.col("line").alias("subset"),
            "audio_hours",
            "est_hours",
            (F.col("est_hours") / 24).alias("est_days"),
        )
    )


def real_time_factor(wall_hours: float = MEASURED_WALL_HOURS, audio_hours: float = MEASURED_AUDIO_HOURS) -> float:
    """Hours of audio processed per hour."""
    return audio_hours / wall_hours
