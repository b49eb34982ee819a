"""Session settings, the shared scratch folder, and size-checked broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """Single-machine session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("voxloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="voxloom-package-"), "voxloom")
        archive = shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package))
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)


_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as named by the session.

    Only a local master may fall back to a temporary folder: on a cluster that folder would
    live on one machine and vanish with it.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="voxloom-")
    return _LOCAL_ROOTS[app]


_LISTENERS: list[list[str]] = []


def new_scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _LISTENERS:
        paths.append(path)
    return path


@contextmanager
def scratch_paths() -> Iterator[list[str]]:
    """The paths that ``new_scratch`` hands out within a ``with`` block, for whoever knows when they are read."""
    paths: list[str] = []
    _LISTENERS.append(paths)
    try:
        yield paths
    finally:
        _LISTENERS[:] = [x for x in _LISTENERS if x is not paths]  # another list may have the same paths


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder or file of the shared folder; one that is not there is fine."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows reads files that survive the loss of any executor, and
    expensive upstream work (decoding, encoding) runs once however often the result is used.
    """
    spark = df.sparkSession
    path = new_scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``materialize`` for the length of a ``with`` block: the folder goes when the block ends."""
    spark = df.sparkSession
    path = new_scratch(spark, label)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        delete_path(spark, path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written within a ``with`` block leaves no shuffle files behind; else they stay until the driver collects garbage."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def broadcast_if_small(df: DataFrame, n_rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only for a side whose row count is known to be below ``limit``."""
    return F.broadcast(df) if n_rows <= limit else df
