"""Chunked token tables: writing, numbering, discovering, reading and checking them.

Files are named ``{split}_part_{first chunk}-..parquet`` or ``{split}_div{d}_part_..`` and lie flat
in one directory per dataset, so any reader that looks for ``{split}*part_*.parquet`` finds them. Our own
readers take the files that commits list (``sources.commits``) and find them by ``sources.catalogue``.

Every row carries ``cells``, a hash of the arrays and the length that are served. It is checked by the same
scan that serves them, so no pass over the arrays comes before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.config import DEFAULT, PipelineConfig
from voxloom.functions.arrays import int_div
from voxloom.operators.position import position_by_number
from voxloom.schemas import CHUNK_FILE, SERVED_FILE
from voxloom.session import materialize
from voxloom.sources.catalogue import catalogue, next_chunks, readable, samples_per_dataset
from voxloom.sources.commits import Commit, append_run, visible_files, visible_in_folders
from voxloom.sources.files import put_whole, qualified, store_of, subdirectories

#: What names of chunk files look like, for any split.
CHUNKS = "*part_*.parquet"

# Spark's name for the leading part of its output file names.
OUTPUT_BASENAME = "mapreduce.output.basename"


def chunk_prefix(split: str, division: int | None = None) -> str:
    return f"{split}_part_" if division is None else f"{split}_div{division}_part_"


def chunk_name(split: str, chunk_no: int, division: int | None = None) -> str:
    """Name of a single chunk, for tables written one file at a time by other tools."""
    return f"{chunk_prefix(split, division)}{chunk_no:03d}.parquet"


def assign_chunks(
    kept: DataFrame,
    file_col: str,
    row_col: str,
    group: tuple[str, ...] = (),
    first_chunk: int = 1,
    cfg: PipelineConfig = DEFAULT,
) -> DataFrame:
    """Add ``position`` (input order of kept rows) and ``chunk_no`` (``chunk_rows`` rows each)."""
    placed = position_by_number(kept, file_col, row_col, "position", group, cfg.position_block)
    chunk = int_div(F.col("position"), cfg.chunk_rows) + F.lit(first_chunk)
    return placed.withColumn("chunk_no", chunk.cast("bigint"))


def content_sum() -> Column:
    """A hash of what is served of a row; the arrays must be of 32-bit integers."""
    return F.xxhash64("audio", "text", "length")


def write_chunks(
    placed: DataFrame,
    n_rows: int,
    out_dir: str,
    split: str,
    division: int | None = None,
    first_chunk: int = 1,
    cfg: PipelineConfig = DEFAULT,
    mode: str = "append",
    done: DataFrame | None = None,
    moved: Callable[[str], None] | None = None,
) -> Commit | None:
    """Write rows that carry ``position`` and ``chunk_no`` as one file per chunk.

    A task gets whole chunks and writes at most ``chunks_per_task`` of them; it turns to a new file every
    ``chunk_rows`` rows, which is exactly where a chunk ends.

    Appending goes through a folder of the run's own, and the run is listed when all its files are in
    place (``commits.append_run``): readers see all of it or nothing. ``done`` and ``moved`` are handed on.
    """
    if n_rows == 0 and mode == "append":
        return None
    spark, rows_per_task = placed.sparkSession, cfg.chunk_rows * cfg.chunks_per_task
    n_tasks = max(1, -(-n_rows // rows_per_task))
    task = int_div(F.col("position"), rows_per_task).cast("int")
    dealt = placed.repartitionById(n_tasks, task).sortWithinPartitions("position")
    name = f"{chunk_prefix(split, division)}{first_chunk:09d}"
    if mode == "append":
        run = Commit("", split, division, first_chunk, -(-n_rows // cfg.chunk_rows))

        def write(folder: str) -> None:
            dealt.mapInArrow(_files_of(qualified(spark, folder), name, cfg.chunk_rows), "n_files int").collect()

        return append_run(spark, write, out_dir, CHUNKS, run, done, moved)
    dealt.write.option(OUTPUT_BASENAME, name).option("maxRecordsPerFile", cfg.chunk_rows).mode(mode).parquet(out_dir)
    return None


def _files_of(folder: str, name: str, rows_per_file: int):
    """The rows of a task as files of ``rows_per_file``, and how many files it wrote.

    Names depend on the task alone: one that runs again puts the same files in place. A file costs its rows
    and a rename; with Spark's own writer every file also went through the driver when the job ended.
    """
    label = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        start, n_files = f"{name}-{TaskContext.get().partitionId():05d}-{label}", 0
        for table in _cut(batches, rows_per_file):
            out = pa.BufferOutputStream()
            pq.write_table(table, out, compression="snappy")
            put_whole(store, f"{base}/{start}.c{n_files:03d}.snappy.parquet", out.getvalue())
            n_files += 1
        yield pa.RecordBatch.from_pydict({"n_files": pa.array([n_files], pa.int32())})

    return run


def _cut(batches: Iterator[pa.RecordBatch], n_rows: int) -> Iterator[pa.Table]:
    """Tables of ``n_rows`` rows, the last one with what is left."""
    held, missing = [], n_rows
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            held.append(batch.slice(at, missing))
            at, missing = at + held[-1].num_rows, missing - held[-1].num_rows
            if not missing:
                yield pa.Table.from_batches(held)
                held, missing = [], n_rows
    if held:
        yield pa.Table.from_batches(held)


def trailing_number(stem: Column) -> Column:
    """The integer after the last underscore of a file stem; null when there is none."""
    return F.regexp_extract(stem, r"_([^_]+)$", 1).try_cast("bigint")


def next_number(stem: Column) -> Column:
    """Aggregate: one more than the highest trailing number, 1 when no stem has one."""
    return (F.coalesce(F.max(trailing_number(stem)), F.lit(0)) + 1).cast("bigint")


def next_chunk_number(spark: SparkSession, out_dir: str, split: str, division: int | None = None) -> int:
    """Where chunk numbering goes on: after the committed numbers, those in the files and those in their names."""
    own = F.col("division").eqNullSafe(F.lit(division).cast("int"))
    found = next_chunks(catalogue(spark, out_dir, split).where(own)).agg(F.max("next_chunk")).first()[0]
    return found or 1


def read_columns(spark: SparkSession, files: list[str], schema, skip_corrupt: bool = True) -> DataFrame:
    """The named columns of the files; a column a file lacks reads as null."""
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", str(skip_corrupt).lower())
    return reader.parquet(*files)


def existing_count(spark: SparkSession, out_dir: str, split: str, division: int | None = None) -> int:
    """Samples already written. No column is read: the count comes from the file footers."""
    own = F.col("division").eqNullSafe(F.lit(division).cast("int"))
    return catalogue(spark, out_dir, split).where(own).agg(F.sum("n_rows")).first()[0] or 0


def split_summary(samples: DataFrame) -> DataFrame:
    """Chunks and samples per split."""
    per_chunk = samples.groupBy("split", "chunk_no").agg(F.count(F.lit(1)).alias("n"))
    return per_chunk.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("n").cast("bigint").alias("n_samples")
    )


def discover_datasets(spark: SparkSession, root: str, split: str) -> list[tuple[str, str]]:
    """``(dataset, path)`` of every chunk file of a split that readers may take, sorted.

    When ``root`` has subdirectories, each one that holds matching files is a dataset and files
    directly in ``root`` are ignored; otherwise ``root`` itself is the one dataset. No file is opened;
    ``catalogue`` gives the same files with what their footers say.
    """
    pattern = f"{split}*part_*.parquet"
    names = subdirectories(spark, root)
    if not names:
        return [("", p) for p in visible_files(spark, root, pattern)]
    pairs = [(p.rsplit("/", 2)[-2], p) for p in visible_in_folders(spark, root, pattern)]
    return sorted((d, p) for d, p in pairs if d in names)


def sample_counts(spark: SparkSession, root: str) -> DataFrame:
    """``(dataset, split, n_samples)`` of all chunk files below ``root``, from their footers."""
    return samples_per_dataset(catalogue(spark, root))


def scan_chunks(spark: SparkSession, files: list[tuple[str, str]], skip_corrupt: bool = False) -> DataFrame:
    """Samples of the listed chunk files with ``path`` and ``row_index``, arrays as 32-bit integers.

    A file that cannot be read raises; ``skip_corrupt`` drops what cannot be read without a word. A row
    whose arrays do not have the sum that was written with them raises as soon as an array is read.
    """
    schema = SERVED_FILE
    if not files:
        wide = spark.createDataFrame([], schema).selectExpr("*", "'' path", "0L row_index")
    else:
        wide = read_columns(spark, [p for _, p in files], schema, skip_corrupt).select(
            "*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_index")
        )
    return served(wide, "path", "row_index")


def served(wide: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and what is served of rows as files hold them; a row without its sum's arrays raises.

    ``keys`` must include ``path`` and ``row_index``, which an error names.
    """
    rows = wide.select(
        *keys,
        F.col("audio").cast("array<int>").alias("audio"),
        F.col("text").cast("array<int>").alias("text"),
        F.col("length").cast("int").alias("length"),
        "cells",
    )
    sound = F.col("cells").isNull() | (F.col("cells") == content_sum())
    wrong = F.raise_error(F.concat(F.lit("damaged arrays in row "), F.col("row_index").cast("string"), F.lit(" of "), F.col("path")))

    def checked(name: str) -> Column:
        return F.when(sound, F.col(name)).otherwise(wrong.cast("array<int>")).alias(name)

    return rows.select(*keys, checked("audio"), checked("text"), "length")


def read_groups(located: DataFrame, *carried: str, n_tasks: int | None = None) -> DataFrame:
    """Samples at ``path``, ``group`` and ``row_index`` (in the group), with ``idx`` and the ``carried``
    columns, read by row groups.

    A task gets whole row groups, opens each once and decodes nothing else of the file, so a look-up costs
    what its row groups hold, however large the files are. Addresses are shuffled, arrays are not, and the
    driver sees no path. ``n_tasks`` is fixed, as addresses say nothing of what reading them costs.
    """
    n_tasks = n_tasks or int(located.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = located.select(*carried, "idx", "path", "group", "row_index")
    dealt = dealt.repartition(n_tasks, "path", "group").sortWithinPartitions("path", "group", "row_index")
    wide = dealt.mapInArrow(_rows_of_groups, T.StructType([*dealt.schema.fields, *SERVED_FILE.fields]))
    return served(wide, *carried, "idx", "path", "row_index")


def _rows_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    arrays = pa.large_list(pa.int64())
    for batch in batches:
        place = list(zip(batch.column("path").to_pylist(), batch.column("group").to_pylist(), strict=True))
        edges = [i for i in range(len(place)) if i == 0 or place[i] != place[i - 1]] + [len(place)]
        for a, b in zip(edges, edges[1:], strict=False):
            path, group = place[a]
            store, name = fs.FileSystem.from_uri(path[5:] if path.startswith("file:/") and "://" not in path else path)
            with store.open_input_file(name) as source:
                file = pq.ParquetFile(source)
                held = set(file.schema_arrow.names)
                table = file.read_row_group(group, columns=[f.name for f in SERVED_FILE if f.name in held])
            rows = table.take(batch.column("row_index")[a:b]).combine_chunks()
            columns = []
            for field in SERVED_FILE:
                kind = arrays if isinstance(field.dataType, T.ArrayType) else pa.int64()
                column = rows.column(field.name).combine_chunks() if field.name in held else pa.nulls(b - a, kind)
                columns.append(column.cast(kind).cast(pa.list_(pa.int64()) if kind is arrays else kind))
            yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *columns], names=[*batch.schema.names, *SERVED_FILE.names])


def committed_samples(spark: SparkSession, root: str, schema: str, split: str | None = None) -> DataFrame:
    """Columns ``schema`` of all files that readers may take, with ``chunk_no`` as the commits settled it."""
    files = readable(catalogue(spark, root, split))
    paths = [r["path"] for r in files.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], f"{schema}, chunk_no bigint")
    rows = read_columns(spark, paths, f"{schema}, chunk_no bigint", skip_corrupt=False).withColumn("uri", F.col("_metadata.file_path"))
    numbered = rows.join(files.select("uri", "shift"), "uri")
    return numbered.withColumn("chunk_no", F.col("chunk_no") + F.col("shift")).drop("uri", "shift")


def scan_lengths(spark: SparkSession, files: list[tuple[str, str]], skip_corrupt: bool = False) -> DataFrame:
    """Only path, row number and ``length`` of every sample: all an index needs."""
    return scan_chunks(spark, files, skip_corrupt).select("path", "row_index", "length")


def union_datasets(parts: list[DataFrame]) -> DataFrame:
    """Several chunk tables as one."""
    return reduce(DataFrame.unionByName, parts)


def damaged_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Files of a catalogue that cannot be read in full: ``(path, footer_rows, read_rows)``, paths as URIs.

    A broken footer leaves no row at all; damage further in leaves fewer rows than the footer
    promises, or rows that do not have the sum written with them. A file without any row is reported too;
    leaving it out changes nothing. Footers are not read again, and every column that is served is.
    """
    paths = [r["path"] for r in readable(files).select("path").collect()]
    listed = files.select(F.col("uri").alias("path"), F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("footer_rows"))
    if not paths:
        return listed.select("*", F.lit(0).cast("bigint").alias("read_rows"))
    base = read_columns(spark, paths, SERVED_FILE)
    arrays = [F.col(c).cast("array<int>").alias(c) for c in ("audio", "text")]
    base = base.select(F.col("_metadata.file_path").alias("path"), "cells", *arrays, F.col("length").cast("int").alias("length"))
    # A plain row count would be answered from the footers; comparing sums has to read the values.
    sound = F.coalesce(F.col("cells") == content_sum(), content_sum().isNotNull())
    read = base.groupBy("path").agg(F.sum(sound.cast("int")).alias("read_rows"))
    joined = listed.join(read, "path", "left")
    read_rows = F.coalesce("read_rows", F.lit(0)).cast("bigint").alias("read_rows")
    whole = (F.col("footer_rows") > 0) & (F.col("footer_rows") == F.col("read_rows"))
    return joined.select("path", "footer_rows", read_rows).where(~whole)


def corrupt_files(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """``damaged_files`` of an explicit list of files, as ``discover_datasets`` gives it."""
    paths = {p for _, p in files}
    folders = sorted({p.rsplit("/", 1)[0] for p in paths})
    rows = [r for f in folders for r in catalogue(spark, f).select("path", "uri", "n_rows").collect() if r["path"] in paths]
    return damaged_files(spark, spark.createDataFrame(rows, "path string, uri string, n_rows bigint"))


def drop_corrupt(samples: DataFrame, corrupt: DataFrame) -> DataFrame:
    """Samples of sound files only: a file that is bad anywhere is left out as a whole."""
    return samples.join(corrupt.select("path"), "path", "left_anti")


def sound_catalogue(spark: SparkSession, root: str, split: str, check: bool | str = True) -> DataFrame:
    """Catalogue rows of the files of a split that can be served, written to the shared folder.

    Footers are read by tasks, once. Files whose rows carry sums are checked when they are served; the
    arrays of the others, which other tools wrote, are read here. ``check="full"`` reads the arrays of all
    files, so damaged ones are left out beforehand instead of raising later; ``check=False`` reads none.
    """
    files = catalogue(spark, root, split)
    files = materialize(files if check is False else readable(files), "catalogue")
    suspect = files.where(F.lit(check == "full") | ~F.col("has_sums"))
    if check is False or not suspect.limit(1).count():
        return files
    bad = materialize(damaged_files(spark, suspect), "damaged")
    return files.join(bad.select(F.col("path").alias("uri")), "uri", "left_anti")


def file_list(files: DataFrame) -> list[tuple[str, str]]:
    """``(dataset, path)`` of catalogue rows in path order, as a scan takes them."""
    return sorted((r["dataset"], r["path"]) for r in files.select("dataset", "path").collect())


def sound_files(spark: SparkSession, root: str, split: str, check: bool | str = True) -> list[tuple[str, str]]:
    """The files of ``sound_catalogue``."""
    return file_list(sound_catalogue(spark, root, split, check))
