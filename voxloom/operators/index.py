"""The global sample index: which file and row a sample number stands for."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.config import DEFAULT, PipelineConfig
from voxloom.functions.arrays import int_div
from voxloom.functions.codes import is_consistent
from voxloom.operators.position import exclusive_sums


def file_counts(samples: DataFrame) -> DataFrame:
    """Rows per file."""
    return samples.groupBy("path").agg(F.count(F.lit(1)).alias("len"))


def file_table(counts: DataFrame) -> DataFrame:
    """``(path, start, len)``: files in path order with the number of their first sample.

    One row per file; the same list the driver already held to plan the scan.
    """
    return exclusive_sums(counts, "len", ["path"], "start").select("path", "start", "len")


def index_totals(files: DataFrame) -> DataFrame:
    """Number of files and of samples."""
    return files.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("len"), F.lit(0)).cast("bigint").alias("n_samples"),
    )


def add_idx(rows: DataFrame, files: DataFrame, cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """Add ``idx = start + row_index`` to rows that carry ``path`` and ``row_index``.

    No sort: the row number inside a file comes from the file itself. Spark broadcasts the file
    table while it is below its threshold. Beyond it both sides shuffle on the path *and* a block
    of row numbers, listed once per block in the file table, so a file that holds a third of all
    rows is spread over many tasks.
    """
    last = int_div(F.col("len") - 1, cfg.position_block)
    starts = files.where(F.col("len") > 0).select(
        "path", "start", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("__block")
    )
    keyed = rows.withColumn("__block", int_div(F.col("row_index"), cfg.position_block))
    return (
        keyed.join(starts, ["path", "__block"])
        .withColumn("idx", F.col("start") + F.col("row_index"))
        .drop("__block", "start")
    )


def global_index(lengths: DataFrame, files: DataFrame, cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """``(idx, path, row_index, length)`` of every sample."""
    return add_idx(lengths, files, cfg).select("idx", "path", "row_index", "length")


def inconsistent_samples(samples: DataFrame, cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """Samples whose stored ``length`` or code list cannot be right."""
    return samples.where(~is_consistent(F.col("audio"), F.col("text"), F.col("length"), cfg))


def duplicate_ids(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples that stand in a table more than once, as when two runs wrote the same rows."""
    return samples.groupBy(key).agg(F.count(F.lit(1)).alias("n_copies")).where(F.col("n_copies") > 1)


def group_table(groups: DataFrame) -> DataFrame:
    """``(path, group, start, len)``: row groups in path order with the number of their first sample."""
    return exclusive_sums(groups, "len", ["path", "group"], "start").select("path", "group", "start", "len")


def locate(
    requests: DataFrame, files: DataFrame, cfg: PipelineConfig = DEFAULT, keys: tuple[str, ...] = ("path",)
) -> DataFrame:
    """File and local row of every requested ``idx`` (the greatest ``start`` not above it).

    ``files`` are pieces of the index with ``start``, ``len`` and ``keys``: files, or row groups of them.

    An as-of join without comparing pairs: sample numbers are cut into blocks of ``chunk_rows``,
    a file is listed once in every block it reaches, and in each block one pass in number order
    carries the latest file forward. A block holds at most ``chunk_rows`` distinct numbers and as
    many files, whatever the file sizes; numbers asked for repeatedly are looked up once.
    Numbers outside the index are left out.
    """
    block = cfg.chunk_rows
    first = int_div(F.col("start"), block)
    last = int_div(F.col("start") + F.col("len") - 1, block)
    entries = (
        files.where(F.col("len") > 0)
        .withColumn("__block", F.explode(F.sequence(first, last)))
        .select(
            "__block",
            F.greatest(F.col("start"), F.col("__block") * block).alias("__at"),
            F.lit(0).alias("__is_request"),
            F.struct(*keys, "start", "len").alias("__file"),
        )
    )
    wanted = requests.select(F.col("idx").cast("bigint").alias("idx")).distinct()
    asks = wanted.select(
        int_div(F.col("idx"), block).alias("__block"),
        F.col("idx").alias("__at"),
        F.lit(1).alias("__is_request"),
        F.lit(None).cast(entries.schema["__file"].dataType).alias("__file"),
    )
    so_far = (
        W.partitionBy("__block")
        .orderBy("__at", "__is_request")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        entries.unionByName(asks)
        .withColumn("__file", F.last("__file", ignorenulls=True).over(so_far))
        .where((F.col("__is_request") == 1) & F.col("__file").isNotNull())
        .select(
            F.col("__at").alias("idx"),
            *[F.col(f"__file.{k}").alias(k) for k in keys],
            (F.col("__at") - F.col("__file.start")).alias("row_index"),
            F.col("__file.len").alias("__len"),
        )
        .where(F.col("row_index") < F.col("__len"))
        .drop("__len")
    )


def fetch(requests: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples whose ``idx`` was asked for, each once."""
    return samples.join(requests.select("idx").distinct(), "idx", "left_semi")


def fetch_from_files(requests: DataFrame, files: DataFrame, scan, cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """Requests read by a reader that takes a list of files: ``scan`` maps paths to rows with ``path`` and
    ``row_index``. Files without a requested row are not opened; their names go through the driver, as for
    any scan. ``fetch_from_groups`` opens less and collects nothing.
    """
    found = locate(requests, files, cfg)
    paths = [unquote(r["path"]) for r in found.select("path").distinct().collect()]
    return scan(sorted(paths)).join(found, ["path", "row_index"])


def fetch_from_groups(requests: DataFrame, groups: DataFrame, read, cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """Requests read from disk by row groups: only those that hold a requested row are opened.

    ``groups`` is a ``group_table``; ``read`` maps ``idx, path, group, row_index`` to samples (see
    ``sources.chunks.read_groups``). The rows to take stay a table throughout.
    """
    return read(locate(requests, groups, cfg, ("path", "group")))
