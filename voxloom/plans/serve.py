"""Token chunks to training batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.config import DEFAULT, PipelineConfig
from voxloom.functions.arrays import int_div
from voxloom.functions.codes import is_consistent
from voxloom.operators import frames as R
from voxloom.operators import index as I
from voxloom.operators import schedule as B
from voxloom.session import materialize
from voxloom.sources import chunks as H
from voxloom.sources.catalogue import catalogue, row_groups


@dataclass(frozen=True)
class SampleIndex:
    """Index of one split: the files, every sample's number and length, the total, and row groups."""

    chunk_files: list[tuple[str, str]]
    files: DataFrame
    index: DataFrame
    n_samples: int
    groups: DataFrame

    def samples(self, spark: SparkSession, in_memory: bool = False) -> DataFrame:
        """Samples with their ``idx``; ``in_memory`` keeps them, spilling to disk when they do not fit."""
        rows = H.scan_chunks(spark, self.chunk_files)
        numbered = I.add_idx(rows, self.files).drop("path", "row_index")
        return numbered.persist(StorageLevel.MEMORY_AND_DISK) if in_memory else numbered


def build_index(spark: SparkSession, root: str, split: str, check: bool | str = True) -> SampleIndex:
    """Number all samples of a split.

    Of our own files only footers and ``length`` are read: their arrays are checked against their sums by
    the scan that serves them, which raises at damage. Arrays of files without sums are read here, and
    damaged files are left out (``sources.chunks.sound_files``; ``check="full"`` reads all files).

    The index is written to the shared folder once; bins, schedules and totals reuse it.
    """
    listed = H.sound_catalogue(spark, root, split, check)
    found = H.file_list(listed)
    lengths = H.scan_lengths(spark, found)
    files = materialize(I.file_table(I.file_counts(lengths)), "files")
    index = materialize(I.global_index(lengths, files), "index")
    groups = materialize(I.group_table(row_groups(listed)), "groups")
    return SampleIndex(found, files, index, index.count(), groups)


def fetch_samples(
    spark: SparkSession, root: str, split: str, requests: DataFrame, cfg: PipelineConfig = DEFAULT
) -> DataFrame:
    """Samples of a split by number (``requests.idx``), each once: ``idx, path, row_index, audio, text, length``.

    Numbers are those of ``build_index`` when no file is left out. Footers say where a number lies; no index
    of samples is built, and only the row groups that hold a requested sample are read.
    """
    groups = I.group_table(row_groups(catalogue(spark, root, split)))
    return I.fetch_from_groups(requests, groups, H.read_groups, cfg)


def build_validation_index(spark: SparkSession, root: str, check: bool | str = True) -> SampleIndex:
    """Index of the validation split, or of the test split when there is no validation sample."""
    found = build_index(spark, root, "validation", check)
    return found if found.n_samples else build_index(spark, root, "test", check)


def batch_schedule(
    index: SampleIndex,
    n_epochs: int = 1,
    n_replicas: int = 1,
    cfg: PipelineConfig = DEFAULT,
    shuffle: bool | str = True,
    uneven: str = "keep",
    first_epoch: int = 0,
) -> DataFrame:
    """The order in which every replica meets every sample, for the given epochs.

    ``shuffle="formula"`` is the order that ``streaming.schedule`` goes on with for ever.
    """
    bins = B.length_bins(index.index, cfg)
    n_bins = B.bin_count(index.n_samples, cfg)
    return B.schedule(bins, n_bins, n_epochs, n_replicas, cfg, shuffle, uneven, first_epoch)


def only_consistent(samples: DataFrame, cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """``samples``; one whose stored length does not fit its arrays raises: it would not fit its batch either."""
    sound = is_consistent(F.col("audio"), F.col("text"), F.col("length"), cfg)
    wrong = F.raise_error(F.concat(F.lit("stored length does not fit the arrays of sample "), F.col("idx").cast("string")))
    return samples.where(F.when(F.coalesce(sound, F.lit(False)), F.lit(True)).otherwise(wrong.cast("boolean")))


def batches(spark: SparkSession, index: SampleIndex, cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """Every sample with its bin, its place in it and the length its batch is padded to.

    What a bin holds does not depend on epoch or replica, so samples are joined to bins once for
    a whole training run; the schedule then only orders bins.
    """
    bins = B.length_bins(index.index, cfg)
    samples = only_consistent(index.samples(spark), cfg)
    return R.with_pad_length(bins).drop("length").join(samples, "idx")


def placed_samples(
    index: SampleIndex, cfg: PipelineConfig = DEFAULT, bins_per_file: int = 512, groups_per_task: int = 16
) -> DataFrame:
    """``batches`` dealt out to files of whole bins, in their order, with the arrays moved once.

    Bins, files and row-group addresses are settled on narrow rows; the tasks that read the arrays get them
    beside the addresses and send every sample straight to its file.
    """
    n_files = max(1, -(-B.bin_count(index.n_samples, cfg) // bins_per_file))
    bins = R.with_pad_length(B.length_bins(index.index, cfg)).drop("length")
    addressed = I.locate(bins.select("idx"), index.groups, cfg, ("path", "group")).join(bins, "idx")
    n_tasks = max(1, -(-index.groups.count() // groups_per_task))
    rows = H.read_groups(addressed, "bin", "slot_in_bin", "pad_length", n_tasks=n_tasks)
    file_no = int_div(F.col("bin"), bins_per_file).cast("int")
    ordered = only_consistent(rows, cfg).repartitionById(n_files, file_no)
    return ordered.sortWithinPartitions("bin", "slot_in_bin")


def export_batches(
    spark: SparkSession, root: str, split: str, out_dir: str, cfg: PipelineConfig = DEFAULT, bins_per_file: int = 512
) -> SampleIndex:
    """Write dense padded batches for trainers: whole bins per file, files in bin order.

    Samples are brought together while they are still sparse. Padding, which multiplies their
    size, is the last step before the file is written and is never shuffled.
    """
    index = build_index(spark, root, split)
    R.dense_batches(placed_samples(index, cfg, bins_per_file), cfg).write.parquet(out_dir)
    return index


def create_batches(
    spark: SparkSession,
    root: str,
    n_epochs: int = 1,
    n_replicas: int = 1,
    cfg: PipelineConfig = DEFAULT,
    first_epoch: int = 0,
    rank: int | None = None,
    uneven: str = "keep",
    check: bool | str = True,
    shuffle: bool | str = True,
) -> tuple[DataFrame, DataFrame]:
    """Schedules for training (shuffled) and for evaluation (from short to long).

    ``rank`` keeps one replica's share; ``uneven`` says what becomes of bins that do not divide by the
    replicas; ``check`` looks for damaged files first. An endless run asks for one epoch after the other
    by ``first_epoch``.
    """
    if rank is not None and not 0 <= rank < n_replicas:
        raise ValueError(f"rank {rank} of {n_replicas} replicas")
    train = build_index(spark, root, "train", check)
    held_out = build_validation_index(spark, root, check)
    plans = (
        batch_schedule(train, n_epochs, n_replicas, cfg, shuffle, uneven, first_epoch),
        batch_schedule(held_out, 1, n_replicas, cfg, shuffle=False),
    )
    return plans if rank is None else tuple(p.where(F.col("rank") == rank) for p in plans)
