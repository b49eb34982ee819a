"""Reading raw corpora: whole splits, and shares of a split for independent runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.sources.files import glob_paths

# Accepted split names and the file prefix each one stands for.
SPLIT_PREFIX = {"train": "train", "val": "validation", "validation": "validation", "test": "test"}
SPLITS = ("train", "validation", "test")


def split_prefix(split: str) -> str:
    """File prefix of a split; ``val`` and ``validation`` are the same split."""
    if split not in SPLIT_PREFIX:
        raise ValueError(f"unknown split {split!r}: use 'train', 'validation' or 'test'")
    return SPLIT_PREFIX[split]


def split_files(spark: SparkSession, root: str, split: str) -> list[str]:
    """Files of a split, sorted by path."""
    return glob_paths(spark, f"{root}/{split_prefix(split)}-*.parquet")


def read_files(
    spark: SparkSession, files: list[str], schema: T.StructType | None, pattern: str | None = None
) -> DataFrame | None:
    """The listed files with ``file_name`` and ``row_index``; no files give an empty table, or
    None when there is no schema to give it. A file that cannot be read raises.

    ``pattern`` says that the list is all files of that pattern in one directory: then Spark lists
    the directory itself instead of being handed every path.
    """
    if not files:
        if schema is None:
            return None
        empty = spark.createDataFrame([], schema)
        return empty.withColumn("file_name", F.lit("")).withColumn("row_index", F.lit(0).cast("bigint"))
    reader = spark.read if schema is None else spark.read.schema(schema)
    if pattern:
        rows = reader.option("pathGlobFilter", pattern).parquet(files[0].rsplit("/", 1)[0])
    else:
        rows = reader.parquet(*files)
    return rows.select(
        "*",
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.row_index").alias("row_index"),
    )


def scan_split(spark: SparkSession, root: str, split: str, schema: T.StructType | None = None) -> DataFrame | None:
    """All rows of one split."""
    files = split_files(spark, root, split)
    return read_files(spark, files, schema, f"{split_prefix(split)}-*.parquet" if files else None)


def scan_division(
    spark: SparkSession,
    root: str,
    split: str,
    division: int,
    n_divisions: int,
    schema: T.StructType | None = None,
) -> DataFrame | None:
    """Rows of every ``n_divisions``-th file of a split, starting at file ``division``.

    Spark already reads files in parallel; divisions serve separate backfill runs.
    """
    if not 0 <= division < n_divisions:
        raise ValueError("division must lie in [0, n_divisions)")
    return read_files(spark, split_files(spark, root, split)[division::n_divisions], schema)


def division_of(split: Column, file_ordinal: Column, n_divisions: int) -> Column:
    """The division that handles a file: training files are dealt out, other splits go to division 0."""
    return F.when(split == "train", file_ordinal % n_divisions).otherwise(0).cast("int")


def division_plan(n_divisions: int, division: int) -> list[tuple[str, int, int]]:
    """``(split, division, n_divisions)`` of the scans one division has to run."""
    plan = [("train", division, n_divisions)]
    return plan + [(s, 0, 1) for s in ("validation", "test")] if division == 0 else plan


def sample_id(file_name: Column, row_index: Column, dataset: str = "") -> Column:
    """Stable name of a row: it depends on the file and the row alone, not on how a run was divided."""
    return F.concat(F.lit(f"{dataset}/"), file_name, F.lit("#"), row_index.cast("string"))
