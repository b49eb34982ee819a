"""The training order as a stream that never ends and goes on where it stopped.

Spark's own counting source hands out numbers; the engine's checkpoint remembers how many. A number stands
for a place of an epoch, and ``operators.permutation`` says which bin lies there, so nothing of an epoch is
ever built: a micro-batch is the next places, looked up among the bins' members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxloom.config import DEFAULT, PipelineConfig
from voxloom.operators import schedule as B

#: The source wants a clock: a batch is so many milliseconds, which nothing here depends on.
_TICK = 1000


def read_places(spark: SparkSession, n_bins: int, bins_per_batch: int, n_partitions: int | None = None) -> DataFrame:
    """``(epoch, pos)`` of all places of all epochs in order, ``bins_per_batch`` at a time."""
    if n_bins <= 0:
        raise ValueError("there is no bin to schedule")
    reader = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", bins_per_batch).option("advanceMillisPerBatch", _TICK)
    if n_partitions:
        reader = reader.option("numPartitions", n_partitions)
    number = F.col("value")
    return reader.load().select(F.floor(number / n_bins).cast("int").alias("epoch"), (number % n_bins).alias("pos"))


def read_schedule(
    spark: SparkSession, members: DataFrame, n_bins: int, n_replicas: int = 1, cfg: PipelineConfig = DEFAULT, bins_per_batch: int = 100_000
) -> DataFrame:
    """The rows of ``schedule(.., shuffle="formula")``, epoch after epoch, without an end.

    ``members`` is ``bin_members`` of the index, best a table on disk: every micro-batch joins it by bin, so
    ``bins_per_batch`` should be a good part of an epoch when there are many bins.
    """
    placed = B.bin_at(read_places(spark, n_bins, bins_per_batch), n_bins, cfg).join(members, "bin")
    return B.in_order(placed, B.shuffle_members(cfg.seed), n_replicas)


def write_schedule(schedule: DataFrame, out_dir: str, available_now: bool = True) -> StreamingQuery:
    """Append the schedule to ``out_dir/places``, a folder per replica, each row once over all restarts.

    ``available_now`` ends after the next batch, as a trainer's own loop wants it; otherwise the query runs
    until it is stopped.
    """
    writer = schedule.writeStream.format("parquet").partitionBy("rank").option("path", f"{out_dir}/places")
    writer = writer.option("checkpointLocation", f"{out_dir}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
