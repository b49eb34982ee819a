"""Corpus to chunked token tables: resumable, with every row accounted for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.config import DEFAULT, PipelineConfig
from voxloom.functions.audio import decode_wav
from voxloom.operators import audio as A
from voxloom.operators import done as D
from voxloom.operators import tokenize as K
from voxloom.operators.stats import observed_outcomes
from voxloom.schemas import QUARANTINE, require_columns
from voxloom.session import staged
from voxloom.sources import chunks as H
from voxloom.sources import corpus as S
from voxloom.sources.commits import Commit, append_run, read_commits, visible_files

LEDGER = "sample_id string, file_name string, row_index bigint"


@dataclass(frozen=True)
class Encoders:
    """Replaceable parts of tokenisation. Factories run on the workers, once per task."""

    make_audio: Callable[[], A.AudioEncoder] | None = None
    make_text: Callable[[], A.TextEncoder] | None = None
    decode: Callable[[bytes], tuple[np.ndarray, int]] = decode_wav

    def text_ids(self) -> Column | None:
        return A.text_encoder_column(self.make_text, F.col("tagged_text")) if self.make_text else None


@dataclass(frozen=True)
class RunCounts:
    """What happened to the rows of one split."""

    seen: int = 0
    skipped: int = 0
    written: int = 0
    quarantined: int = 0
    dropped_short: int = 0


def outcomes(
    corpus: DataFrame, cfg: PipelineConfig = DEFAULT, encoders: Encoders = Encoders(), keys: tuple = ("sample_id",)
) -> DataFrame:
    """Every row of ``corpus`` as a sample, or with the ``stage`` and ``reason`` it fell out at.

    Narrow from end to end: no shuffle. Short texts leave before the audio is touched.
    """
    require_columns(corpus, ["text", "audio", *keys])
    cleaned = K.clean_rows(corpus, cfg)
    columns = [*keys, "speaker", "tagged_text"]
    long = K.keep_long_enough(cleaned, cfg).select(*columns, "audio")
    encoded = A.encode_audio(long, cfg, encoders.make_audio, encoders.decode)
    samples = K.to_samples(encoded, cfg, encoders.text_ids())
    short = K.short_rows(cleaned, cfg, keys)
    return samples.unionByName(short, allowMissingColumns=True)


def quarantine_dir(out_dir: str) -> str:
    """Beside the chunks, not below them: a subdirectory would count as a dataset."""
    return out_dir.rstrip("/") + "_quarantine"


def handled_in(spark: SparkSession, folder: str, pattern: str, split: str) -> DataFrame | None:
    """Bitmaps of the input rows that the files of a folder stand for; None when there are none.

    Runs list their rows beside their files; only files without such a list are read for the names of
    their rows.
    """
    commits = read_commits(spark, folder)
    listed = [c for c in commits if c.done and c.split == split]
    named = {f for c in commits for f in c.files if c.done}
    files = [f for f in visible_files(spark, folder, pattern, commits) if f.rsplit("/", 1)[-1] not in named]
    parts = [spark.read.schema(D.SCHEMA).parquet(*[f"{folder}/{c.done}" for c in listed])] if listed else []
    if files:
        ledger = H.read_columns(spark, files, LEDGER, skip_corrupt=False).where("sample_id is not null")
        parts.append(D.done_bits(ledger, F.split_part("sample_id", F.lit("/"), F.lit(1))))
    return H.union_datasets(parts) if parts else None


def handled_rows(
    spark: SparkSession, out_dir: str, split: str, dataset: str, retry_quarantine: bool = False
) -> DataFrame | None:
    """Bitmaps of the rows of a data set that earlier runs wrote or set aside, whichever division ran
    them; None before the first run."""
    folders = [(out_dir, f"{split}*part_*.parquet")]
    if not retry_quarantine:
        folders.append((quarantine_dir(out_dir), f"{split}*.parquet"))
    found = [handled_in(spark, folder, pattern, split) for folder, pattern in folders]
    parts = [p for p in found if p is not None]
    return D.merged(H.union_datasets(parts).where(F.col("dataset") == dataset)) if parts else None


def file_states(spark: SparkSession, files: dict[str, str], done: DataFrame | None) -> DataFrame:
    """``(file_name, n_rows, n_done, n_blocks)`` per input file; row counts come from the file footers."""
    rows = spark.read.schema(T.StructType()).parquet(*files.values())
    totals = rows.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(F.count(F.lit(1)).alias("n_rows"))
    if done is None:
        return totals.withColumns({"n_done": F.lit(0).cast("bigint"), "n_blocks": F.lit(0).cast("bigint")})
    return totals.join(D.done_per_file(done), "file_name", "left").na.fill(0, ["n_done", "n_blocks"])


def pending_rows(
    spark: SparkSession,
    files: list[str],
    done: DataFrame | None,
    schema: T.StructType,
    cfg: PipelineConfig,
    dataset: str,
    split: str,
    whole: bool,
) -> tuple[DataFrame | None, int, int]:
    """Rows still to do (None when there are none), rows seen and rows already done.

    Decided per file first, from row counts and bit counts: finished files are not opened again and
    untouched files need no test. Only rows of files that were left half done are looked up in bitmaps.
    The driver sees the names of the files that are to be opened, as for any scan.
    """
    names = {f.rsplit("/", 1)[-1]: f for f in files}
    states = file_states(spark, names, done)
    if done is not None:
        states = states.persist()
    try:
        sums = states.agg(F.sum("n_rows"), F.sum(F.least("n_rows", "n_done"))).first()
        left = states.where("n_done < n_rows").select("file_name", "n_done", "n_blocks").collect()
    finally:
        states.unpersist()
    fresh = sorted(names[r["file_name"]] for r in left if r["n_done"] == 0)
    half = {r["file_name"]: r["n_blocks"] for r in left if r["n_done"]}
    pattern = f"{split}-*.parquet" if whole and len(fresh) == len(files) else None
    parts = []
    if fresh:
        parts.append(S.read_files(spark, fresh, schema, pattern))
    if half:
        rest = S.read_files(spark, sorted(names[f] for f in half), schema)
        parts.append(D.without_marked(rest, done, sum(half.values()), cfg.broadcast_rows))
    seen, skipped = sums[0] or 0, sums[1] or 0
    if not parts:
        return None, seen, skipped
    todo = H.union_datasets(parts)
    name = S.sample_id(F.col("file_name"), F.col("row_index"), dataset)
    return todo.withColumn("sample_id", name), seen, skipped


def sample_columns(placed: DataFrame, dataset: Column, split: str, division: int | None, cfg: PipelineConfig) -> DataFrame:
    """The columns of a chunk table, the same for every way of writing one."""
    return placed.select(
        "sample_id",
        dataset.alias("dataset"),
        F.lit(split).alias("split"),
        F.lit(division).cast("int").alias("division"),
        "chunk_no",
        "position",
        "file_name",
        "row_index",
        "speaker",
        "audio",
        "text",
        "length",
        F.lit(cfg.n_codebooks).alias("n_codebooks"),
        H.content_sum().alias("cells"),
    )


def tokenize_split(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    split: str,
    schema: T.StructType,
    cfg: PipelineConfig = DEFAULT,
    encoders: Encoders = Encoders(),
    division: int | None = None,
    n_divisions: int = 1,
    retry_quarantine: bool = False,
    dataset: str | None = None,
    moved: Callable[[str], None] | None = None,
) -> RunCounts:
    """Tokenise what is left of one split and append it as chunks.

    Rows are known by data set (the name of ``in_dir`` unless given), file and row number.

    The result is written once to the shared folder before it is numbered, so audio is encoded
    once and a lost executor cannot change a row after its position is known. All chunks appear at
    once, with the bitmaps of their input rows; the quarantine follows, so a crash in between repeats
    quarantined rows only. ``moved`` is told the name of every chunk file that is in place.
    """
    if not 0 <= (division or 0) < n_divisions:
        raise ValueError(f"division {division} of {n_divisions}")
    split = S.split_prefix(split)
    files = S.split_files(spark, in_dir, split)[(division or 0) :: n_divisions]
    if not files:
        return RunCounts()
    dataset = dataset or in_dir.rstrip("/").rsplit("/", 1)[-1]
    done = handled_rows(spark, out_dir, split, dataset, retry_quarantine)
    todo, seen, skipped = pending_rows(spark, files, done, schema, cfg, dataset, split, n_divisions == 1)
    if todo is None:
        return RunCounts(seen, skipped)
    keys = ("sample_id", "file_name", "row_index")
    watched, counted = observed_outcomes(outcomes(todo, cfg, encoders, keys))
    with staged(watched, "staged") as rows:
        written, set_aside, short = (counted.get[s] for s in (K.WRITTEN, K.QUARANTINED, K.DROPPED_SHORT))
        good, bad = K.split_outcome(rows, keys)
        first = H.next_chunk_number(spark, out_dir, split, division)
        placed = H.assign_chunks(good, "file_name", "row_index", (), first, cfg)
        samples = sample_columns(placed, F.lit(dataset), split, division, cfg)
        H.write_chunks(samples, written, out_dir, split, division, first, cfg, done=D.done_bits(good, dataset), moved=moved)
        if set_aside or short:
            writer, run = bad.write.option(H.OUTPUT_BASENAME, split), Commit("", split, division)
            append_run(spark, writer.parquet, quarantine_dir(out_dir), "*.parquet", run, D.done_bits(bad, dataset))
    return RunCounts(seen, skipped, written, set_aside, short)


def tokenize_corpus(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    schema: T.StructType,
    cfg: PipelineConfig = DEFAULT,
    encoders: Encoders = Encoders(),
    division: int | None = None,
    n_divisions: int = 1,
    retry_quarantine: bool = False,
    dataset: str | None = None,
    moved: Callable[[str], None] | None = None,
) -> dict[str, RunCounts]:
    """Tokenise every split of a corpus, or one division's share of it.

    Divisions may run at the same time and into the same folder. ``retry_quarantine`` tries rows again
    that an earlier run set aside. ``dataset`` and ``moved`` as for ``tokenize_split``.
    """
    if division is None and n_divisions != 1:
        raise ValueError("say which division of them to run")
    if division is None:
        plan = [(s, None, 1) for s in S.SPLITS]
    else:
        plan = S.division_plan(n_divisions, division)
    return {
        split: tokenize_split(spark, in_dir, out_dir, split, schema, cfg, encoders, d, n, retry_quarantine, dataset, moved)
        for split, d, n in plan
    }


def quarantine_rows(spark: SparkSession, out_dir: str) -> DataFrame:
    """Rows that are set aside: once each, and not those that a later run wrote after all."""
    files = visible_files(spark, quarantine_dir(out_dir), "*.parquet")
    if not files:
        return spark.createDataFrame([], QUARANTINE)
    aside = spark.read.schema(QUARANTINE).parquet(*files).withColumn("__at", F.col("_metadata.file_modification_time"))
    columns = QUARANTINE.fieldNames()
    rest = [c for c in columns if c != "sample_id"]
    latest = aside.groupBy("sample_id").agg(F.max(F.struct("__at", *rest)).alias("__last")).select("sample_id", *[F.col(f"__last.{c}").alias(c) for c in rest])
    chunks = visible_files(spark, out_dir, H.CHUNKS)
    if chunks:
        latest = latest.join(H.read_columns(spark, chunks, "sample_id string", skip_corrupt=False), "sample_id", "left_anti")
    return latest.select(*columns)
