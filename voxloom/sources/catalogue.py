"""Chunk files as a table: a Spark data source that lists folders and reads footers in tasks.

A row per file: data set, split, division, chunk number, path, rows, and whether the file carries content
sums. Footers are read by tasks, a group of files each; a file whose footer cannot be read has null rows.
Split and data set are settled from names alone, before any file is opened: as options, or as filters where
the session lets Python sources take them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from voxloom.sources.commits import COMMITS, Commit
from voxloom.sources.files import qualified, uri_of

FORMAT = "voxloom_chunks"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Files whose footers one task reads.
GROUP = 128
SCHEMA = "dataset string, split string, division int, chunk_no bigint, shift bigint, path string, uri string, n_rows bigint, has_sums boolean, max_chunk bigint, group_rows array<bigint>"
_NAME = re.compile(r"^([a-z]+)(.*?)part_(.*)\.parquet$")
_DIVISION = re.compile(r"^_div(\d+)_$")
_LAST = re.compile(r"_(-?\d+)$")


def parse_name(name: str) -> tuple[str, int | None, int | None] | None:
    """Split, division and trailing number of the name of a chunk file; None for other names."""
    found = _NAME.match(name)
    if not found:
        return None
    division, last = _DIVISION.match(found[2]), _LAST.search("_" + found[3])
    return found[1], int(division[1]) if division else None, int(last[1]) if last else None


class _Group(InputPartition):
    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows


class _Footers(DataSourceReader):
    """Lists one folder, or every folder directly below it, and reads the footers of what it found."""

    def __init__(self, root: str, split: str | None, dataset: str | None) -> None:
        self.root, self.split, self.datasets = root.rstrip("/"), split, None if dataset is None else {dataset}

    def _store(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root if "://" in self.root or not self.root.startswith("file:") else self.root[5:])
        return store, base.rstrip("/")

    def _folder(self, store, path: str) -> tuple[list[str], list[Commit]]:
        """Names of the chunk files in a folder, and its commits."""
        from pyarrow import fs

        names = [i.base_name for i in store.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File]
        kept = sorted(i.path for i in store.get_file_info(fs.FileSelector(f"{path}/{COMMITS}", allow_not_found=True)) if fnmatch(i.base_name, "[!.]*.json"))
        commits = []
        for p in kept:
            with store.open_input_stream(p) as f:
                commits.append(Commit.parse(f.read().decode()))
        return sorted(n for n in names if not n.startswith((".", "_"))), commits

    def listed(self) -> list[tuple]:
        """``(dataset, split, division, shift, path, name number)`` of the files that readers may take."""
        from pyarrow import fs

        store, base = self._store()
        infos = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        folders = sorted(i.base_name for i in infos if i.type == fs.FileType.Directory and not i.base_name.startswith(("_", ".")))
        rows = []
        for dataset in folders or [""]:
            if self.datasets is not None and dataset not in self.datasets:
                continue
            tail = f"/{dataset}" if dataset else ""
            if not infos:
                continue
            names, commits = self._folder(store, base + tail)
            shift = {f: c.shift for c in commits for f in c.files}
            for name in names:
                parsed = parse_name(name)
                if parsed is None or commits and name not in shift or self.split not in (None, parsed[0]):
                    continue
                rows.append((dataset, parsed[0], parsed[1], shift.get(name, 0), f"{self.root}{tail}/{name}", parsed[2]))
        return rows

    def partitions(self) -> list[_Group]:
        rows = self.listed()
        return [_Group(rows[i : i + GROUP]) for i in range(0, len(rows), GROUP)] or [_Group([])]

    def read(self, partition: _Group) -> Iterator[tuple]:
        import pyarrow as pa
        import pyarrow.parquet as pq

        store, base = self._store()
        for dataset, split, division, shift, path, number in partition.rows:
            n_rows, sums, low, high, groups = None, None, None, None, None
            try:
                with store.open_input_file(base + path[len(self.root) :]) as f:
                    footer = pq.read_metadata(f)
                n_rows = footer.num_rows
                sums = "cells" in footer.schema.names
                low, high = _chunk_range(footer)
                groups = [footer.row_group(g).num_rows for g in range(footer.num_row_groups)]
            except (OSError, pa.ArrowInvalid):
                pass  # the row says so: n_rows stays null
            own = low if low is not None else number
            most = max((x + shift for x in (high, number) if x is not None), default=None)
            yield dataset, split, division, None if own is None else own + shift, shift, path, uri_of(path), n_rows, sums, most, groups


def _chunk_range(footer) -> tuple[int | None, int | None]:
    """Least and greatest ``chunk_no`` of a file, from the statistics in its footer."""
    low = high = None
    for g in range(footer.num_row_groups):
        group = footer.row_group(g)
        for c in range(group.num_columns):
            column = group.column(c)
            if column.path_in_schema == "chunk_no" and column.statistics is not None and column.statistics.has_min_max:
                low = column.statistics.min if low is None else min(low, column.statistics.min)
                high = column.statistics.max if high is None else max(high, column.statistics.max)
    return low, high


class _PushedFooters(_Footers):
    """The same, taking filters on split and data set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("split",) and self.split in (None, f.value):
                self.split = f.value
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("dataset",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.datasets = wanted if self.datasets is None else self.datasets & wanted
            else:
                yield f


class ChunkCatalogue(DataSource):
    """``spark.read.format("voxloom_chunks").load(root)``; options ``split`` and ``dataset`` are filters."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = _PushedFooters if self.options.get("pushdown") == "true" else _Footers
        return kind(self.options["path"], self.options.get("split"), self.options.get("dataset"))


def catalogue(spark: SparkSession, root: str, split: str | None = None, dataset: str | None = None) -> DataFrame:
    """The chunk files below ``root`` that readers may take (see ``SCHEMA``).

    When ``root`` has subdirectories each is a data set, otherwise ``root`` itself is the one data set ("").
    ``chunk_no`` is the committed number of a file's first chunk; ``max_chunk`` also heeds the number in its
    name. A root that does not exist is empty.
    """
    spark.dataSource.register(ChunkCatalogue)
    reader = spark.read.format(FORMAT).option("pushdown", spark.conf.get(PUSHDOWN, "false"))
    for key, value in (("split", split), ("dataset", dataset)):
        if value is not None:
            reader = reader.option(key, value)
    return reader.load(qualified(spark, root))


def readable(files: DataFrame) -> DataFrame:
    """Files with a sound footer and at least one row."""
    return files.where(F.coalesce(F.col("n_rows"), F.lit(0)) > 0)


def row_groups(files: DataFrame) -> DataFrame:
    """``(path, group, len)``: a row per row group, from the footers."""
    each = readable(files).select("path", F.posexplode("group_rows").alias("group", "len"))
    return each.where("len > 0")


def files_per_dataset(files: DataFrame) -> DataFrame:
    return files.groupBy("split", "dataset").agg(F.count(F.lit(1)).alias("n_files"))


def samples_per_dataset(files: DataFrame) -> DataFrame:
    return readable(files).groupBy("dataset", "split").agg(F.sum("n_rows").cast("bigint").alias("n_samples"))


def next_chunks(files: DataFrame) -> DataFrame:
    """The next free chunk number of every data set, split and division: 1 when no file has a number."""
    after = (F.coalesce(F.max("max_chunk"), F.lit(0)) + 1).cast("bigint")
    return files.groupBy("dataset", "split", "division").agg(after.alias("next_chunk"))

