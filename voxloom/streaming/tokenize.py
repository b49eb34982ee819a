"""Incremental tokenisation with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from voxloom.config import DEFAULT, PipelineConfig
from voxloom.operators import tokenize as K
from voxloom.operators.position import exclusive_sums
from voxloom.operators.stats import observed_outcomes
from voxloom.plans.tokenize import Encoders, outcomes, sample_columns
from voxloom.session import staged
from voxloom.sources import chunks as H
from voxloom.sources import corpus as S
from voxloom.sources.commits import COMMITS, Commit, commit_once

KEYS = ("sample_id", "file_name", "row_index")


def read_corpus_stream(
    spark: SparkSession, in_dir: str, split: str, schema: T.StructType, files_per_batch: int = 100
) -> DataFrame:
    """New files of a split as they appear, with the same row names as a batch read."""
    dataset = in_dir.rstrip("/").rsplit("/", 1)[-1]
    rows = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{S.split_prefix(split)}-*.parquet")
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(in_dir)
        .select(
            "*",
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.row_index").alias("row_index"),
        )
    )
    return rows.withColumn("sample_id", S.sample_id(F.col("file_name"), F.col("row_index"), dataset))


def write_batch(
    rows: DataFrame, batch_id: int, out_dir: str, split: str, cfg: PipelineConfig, encoders: Encoders
) -> None:
    """Tokenise one micro-batch into folders named after it, then list it.

    A replayed batch overwrites itself and keeps its numbers. Rows are counted by the job that encodes them;
    where chunk numbers go on is known from the commits before, nothing that was written is read.
    """
    target = f"{out_dir}/samples/batch_id={batch_id}"
    watched, counted = observed_outcomes(outcomes(rows, cfg, encoders, KEYS))
    with staged(watched, "staged") as done:
        n = counted.get[K.WRITTEN]
        good, bad = K.split_outcome(done, KEYS)
        placed = H.assign_chunks(good, "file_name", "row_index", (), 1, cfg)
        placed = sample_columns(placed, F.split_part("sample_id", F.lit("/"), F.lit(1)), split, None, cfg)
        H.write_chunks(placed, n, target, split, None, 1, cfg, mode="overwrite")
        bad.write.mode("overwrite").parquet(f"{out_dir}/quarantine/batch_id={batch_id}")
    run = Commit(f"batch-{batch_id}", split, None, 1, -(-n // cfg.chunk_rows))
    commit_once(rows.sparkSession, f"{out_dir}/samples", run)


def stream_samples(spark: SparkSession, out_dir: str) -> DataFrame:
    """Samples of all listed batches of a stream, chunks numbered through."""
    samples = f"{out_dir}/samples"
    listed = spark.read.schema("run string, shift bigint").json(f"{samples}/{COMMITS}")
    numbers = listed.select(F.regexp_extract("run", r"^batch-(\d+)$", 1).try_cast("int").alias("batch_id"), "shift")
    rows = spark.read.parquet(samples).join(numbers, "batch_id")
    return rows.withColumn("chunk_no", F.col("chunk_no") + F.col("shift")).drop("shift")


def tokenize_stream(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    split: str,
    schema: T.StructType,
    cfg: PipelineConfig = DEFAULT,
    encoders: Encoders = Encoders(),
    files_per_batch: int = 100,
) -> StreamingQuery:
    """Start tokenising all files present and stop when they are done.

    The checkpoint remembers finished files, so the next call handles new files only. Chunks are
    numbered inside their batch in the files, and through all batches by ``stream_samples``.
    """

    def each(rows: DataFrame, batch_id: int) -> None:
        write_batch(rows, batch_id, out_dir, split, cfg, encoders)

    return (
        read_corpus_stream(spark, in_dir, split, schema, files_per_batch)
        .writeStream.foreachBatch(each)
        .option("checkpointLocation", f"{out_dir}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def dense_chunk_numbers(samples: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Chunk numbers 1, 2, .. over all batches of a table without commits, from the chunks of each batch."""
    keys = [*group, "batch_id"]
    per_batch = samples.groupBy(*keys).agg(F.max("chunk_no").alias("n_chunks"))
    starts = exclusive_sums(per_batch, "n_chunks", ["batch_id"], "__before", group).select(*keys, "__before")
    return samples.join(starts, keys).withColumn("chunk_no", F.col("chunk_no") + F.col("__before")).drop("__before")
