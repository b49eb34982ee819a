"""Corpora and samples derived by Spark from the given tables, with their SQL twins.

Everything covers whole tables and whole texts. Files are written below the session's shared
folder, once per application and table set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.config import PipelineConfig
from voxloom.functions import text as X
from voxloom.functions.arrays import index_range
from voxloom.functions.codes import sample_length
from voxloom.operators.position import position_by_number
from voxloom.operators.tokenize import clean_rows, keep_long_enough
from voxloom.schemas import AUDIO_CELL
from voxloom.session import new_scratch, staged
from voxloom.sources import chunks as H
from voxloom.sources import corpus as S
from voxloom.sources.files import put_bytes, rename_file

CFG = PipelineConfig(chunk_rows=64, position_block=1 << 16)
N_FILES = 4
N_DIVISIONS = 3
N_REPLICAS = 3
N_EPOCHS = 3
DAMAGED = 7
#: Bytes of a row group of corpus files: one is read by one task, and there are few files however many rows.
CORPUS_GROUP = 1 << 20
GROUP_BYTES = "parquet.block.size"

# Whitespace as a DuckDB expression.
WS = " || ".join(f"chr({c})" for c in X.PY_WHITESPACE_CODES)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def split_of(number: Column) -> Column:
    return F.when(number % 10 == 8, "validation").when(number % 10 == 9, "test").otherwise("train")


def split_sql(number: str) -> str:
    return f"case {number} % 10 when 8 then 'validation' when 9 then 'test' else 'train' end"


def dialogue(spark: SparkSession, sf: str) -> DataFrame:
    """``conversations`` as a corpus: row number, file, split, speaker and transcript."""
    conv = F.col("conv_id")
    return table(spark, sf, "conversations").select(
        (conv * 100 + F.col("turn")).alias("sid"),
        (conv % N_FILES).cast("int").alias("file_no"),
        split_of(conv).alias("split"),
        F.col("role").alias("speaker"),
        "text",
    )


DIALOGUE = f"""dialogue as (
  select conv_id * 100 + turn as sid, (conv_id % {N_FILES})::int as file_no,
    {split_sql("conv_id")} as split, role as speaker, text as raw, trim(text, {WS}) as txt
  from conversations)"""


def prose(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as a corpus whose files are the sources; it has no speaker column."""
    return table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("path"), split_of(F.col("doc_id")).alias("split"), "lang", "text", "n_chars"
    )


PROSE = f"""prose as (
  select doc_id, source as path, {split_sql("doc_id")} as split, lang, text as raw,
    trim(text, {WS}) as txt, n_chars
  from documents)"""


def spoken_lines(spark: SparkSession, sf: str) -> DataFrame:
    """What ``samples`` are made of: the tagged text and the number of frames, no arrays yet."""
    rows = keep_long_enough(clean_rows(dialogue(spark, sf)))
    frames = (F.length("text") % 5 + 1).alias("frames")
    return rows.select("sid", "file_no", "split", F.col("speaker").alias("dataset"), frames, "tagged_text")


def with_arrays(lines: DataFrame, *carried: str) -> DataFrame:
    """``carried`` columns of spoken lines with their arrays and length."""
    codes = F.transform(
        index_range(F.col("frames") * 32), lambda k: ((F.col("sid") * 31 + k * 7) % 2048).cast("int")
    )
    arrays = lines.select(*carried, codes.alias("audio"), X.utf8_ids(F.col("tagged_text")).alias("text"))
    return arrays.withColumn("length", sample_length(F.col("audio"), F.col("text")))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Tokenised dialogue with byte ids as text and codes made from a formula."""
    return with_arrays(spoken_lines(spark, sf), "sid", "file_no", "split", "dataset")


BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: ('0x' || h)::int)"

SAMPLES = f"""{DIALOGUE}, samples as (
  select sid, file_no, split, speaker as dataset,
    list_transform(range(0, 32 * (length(txt) % 5 + 1)), lambda k: ((sid * 31 + k * 7) % 2048)::int) as audio,
    {BYTES.format("('[' || speaker || ']' || txt)")} as text,
    (length(txt) % 5 + 1 + strlen('[' || speaker || ']' || txt) + 1)::int as length
  from dialogue where length(txt) >= 10)"""


def lengths(spark: SparkSession, sf: str) -> DataFrame:
    """``(sid, file_no, split, dataset, length)`` without building any array."""
    rows = keep_long_enough(clean_rows(dialogue(spark, sf)))
    length = F.length("text") % 5 + 1 + F.octet_length("tagged_text") + 1
    return rows.select("sid", "file_no", "split", F.col("speaker").alias("dataset"), length.cast("int").alias("length"))


def indexed_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """``lengths`` with ``idx``, the place in file order: written once, like any sample index."""

    def write(path: str) -> None:
        rows = lengths(spark, sf)
        position_by_number(rows, "file_no", "sid", "idx", block=CFG.position_block).write.parquet(path)

    return spark.read.parquet(written_once(spark, sf, "index", write))


def numbered_samples(spark: SparkSession, sf: str) -> DataFrame:
    """``samples`` with ``idx``; the arrays are joined to the narrow numbering."""
    return samples(spark, sf).join(indexed_lengths(spark, sf).select("sid", "idx"), "sid")


INDEXED = f"""{SAMPLES}, indexed as (
  select *, row_number() over (order by file_no, sid) - 1 as idx from samples)"""

BINS = f"""{INDEXED}, ranked as (
  select *, row_number() over (order by length, idx) - 1 as rnk from indexed),
  bins as (
  select rnk // {CFG.batch_size} as bin, (rnk % {CFG.batch_size})::int as slot_in_bin, * exclude (rnk) from ranked)"""

SCHEDULE = f"""{BINS}, epochs as (select unnest(range(0, {N_EPOCHS}))::int as epoch),
  placed as (
  select epoch, bin, row_number() over (partition by epoch
    order by md5('{CFG.seed}:' || epoch || ':' || bin), bin) - 1 as pos
  from (select distinct bin from bins), epochs),
  schedule as (
  select p.epoch, (p.pos % {N_REPLICAS})::int as rank, p.pos, b.bin, b.idx, b.length,
    (row_number() over (partition by p.epoch, b.bin
      order by md5('{CFG.seed}:' || p.epoch || ':' || b.idx), b.idx) - 1)::int as slot_in_bin
  from placed p join bins b using (bin))"""

FRAMES = f"""{SAMPLES}, sized as (select *, len(text) as n, len(audio) // 32 as t from samples),
  frames as (
  select sid, 'text' as kind, (i - 1)::int as pos, 32 as slot, text[i] as token, length
  from (select *, unnest(range(1, n + 1)) as i from sized)
  union all
  select sid, 'audio', (n + (k % t))::int, (k // t)::int, audio[k + 1], length
  from (select *, unnest(range(0, 32 * t)) as k from sized)
  union all
  select sid, 'end', (n + t)::int, s::int, 0, length
  from (select *, unnest(range(0, 32)) as s from sized))"""


_WRITTEN: dict[tuple[str, str, str], str] = {}


def written_once(spark: SparkSession, sf: str, label: str, write: Callable[[str], None]) -> str:
    """The folder ``write`` filled, writing it on first use."""
    key = (spark.sparkContext.applicationId, sf, label)
    if key not in _WRITTEN:
        path = new_scratch(spark, label)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def _le(value: Column, n_bytes: int) -> Column:
    """Little-endian hex digits of a non-negative number."""
    parts = [F.lpad(F.hex(F.shiftright(value, 8 * b).bitwiseAND(F.lit(255))), 2, "0") for b in range(n_bytes)]
    return F.concat(*parts)


def wav_bytes(pcm: Column, channels: Column, rate: Column) -> Column:
    """16-bit PCM samples (interleaved) as the bytes of a WAV file, by native expressions."""
    data = F.concat_ws("", F.transform(pcm, lambda v: _le(F.pmod(v, F.lit(65536)).cast("int"), 2)))
    size = (F.size(pcm) * 2).cast("int")
    ascii_hex = {"RIFF": "52494646", "WAVEfmt ": "57415645666D7420", "data": "64617461"}
    header = F.concat(
        F.lit(ascii_hex["RIFF"]),
        _le(size + 36, 4),
        F.lit(ascii_hex["WAVEfmt "]),
        F.lit("10000000" + "0100"),
        _le(channels, 2),
        _le(rate, 4),
        _le(rate * channels * 2, 4),
        _le(channels * 2, 2),
        F.lit("1000"),
        F.lit(ascii_hex["data"]),
        _le(size, 4),
    )
    return F.unhex(F.concat(header, data))


def audio_cell(
    raw: Column | None = None, array: Column | None = None, channels: Column | None = None, rate: Column | None = None
) -> Column:
    """An audio struct; parts not given are null."""
    given = {"bytes": raw, "array": array, "channels": channels, "sampling_rate": rate}
    parts = [
        (F.lit(None) if given[f.name] is None else given[f.name]).cast(f.dataType).alias(f.name)
        for f in AUDIO_CELL.fields
    ]
    return F.struct(*parts)


def spoken(spark: SparkSession, sf: str) -> DataFrame:
    """Dialogue rows with audio: the transcript's bytes are the waveform.

    System turns have no audio; turns of a length divisible by 7 have bytes no decoder knows.
    """
    rows = dialogue(spark, sf)
    text = F.coalesce(F.col("text"), F.lit(""))
    wave = F.transform(X.utf8_ids(text), lambda b: ((b - 128) / 128.0).cast("float"))
    good = audio_cell(array=wave, channels=F.lit(1), rate=F.lit(CFG.sample_rate))
    junk = audio_cell(raw=F.encode(text, "UTF-8"))
    cell = F.when(F.col("speaker") == "system", audio_cell()).when(F.length(text) % 7 == 0, junk).otherwise(good)
    return rows.withColumn("audio", cell)


def corpus_dir(spark: SparkSession, sf: str) -> str:
    """Spoken dialogue as ``{split}-*.parquet``, one file per ``file_no`` and split."""

    def write(path: str) -> None:
        rows = spoken(spark, sf)
        for split in ("train", "validation", "test"):
            (
                rows.where(F.col("split") == split)
                .drop("split")
                .repartitionById(N_FILES, F.col("file_no"))
                .sortWithinPartitions("sid")
                .write.mode("append")
                .option(H.OUTPUT_BASENAME, split)
                .option(GROUP_BYTES, CORPUS_GROUP)
                .parquet(path)
            )

    return written_once(spark, sf, "corpus", write)


def corpus_schema(spark: SparkSession, sf: str):
    return spoken(spark, sf).drop("split").schema


def early_corpus_dir(spark: SparkSession, sf: str) -> str:
    """The corpus at an earlier time: its files have the same names, but file 3 is not there yet and
    files 1 and 2 hold the first half of their rows only."""

    def write(path: str) -> None:
        rows = spoken(spark, sf).where("file_no < 3")
        one = W.partitionBy("split", "file_no")
        rows = rows.withColumn("__row", F.row_number().over(one.orderBy("sid"))).withColumn("__rows", F.count(F.lit(1)).over(one))
        rows = rows.where("file_no = 0 or 2 * __row <= __rows").drop("__row", "__rows")
        for split in ("train", "validation", "test"):
            own = rows.where(F.col("split") == split).drop("split")
            folder = new_scratch(spark, "early")
            own = own.repartitionById(N_FILES, F.col("file_no")).sortWithinPartitions("sid")
            own.write.option(H.OUTPUT_BASENAME, split).option(GROUP_BYTES, CORPUS_GROUP).parquet(folder)
            names = {p.rsplit("/", 1)[-1][: len(split) + 6]: p.rsplit("/", 1)[-1] for p in S.split_files(spark, corpus_dir(spark, sf), split)}
            for file in S.split_files(spark, folder, split):
                rename_file(spark, file, f"{path}/{names[file.rsplit('/', 1)[-1][: len(split) + 6]]}")

    return written_once(spark, sf, "early", write)


def damaged_chunk_dir(spark: SparkSession, sf: str) -> str:
    """Chunk files in which every 50th sample's codes changed after their sum was written: the files are
    sound Parquet, and only the sums tell."""

    def write(path: str) -> None:
        group = ("dataset", "split")
        placed = H.assign_chunks(samples(spark, sf), "file_no", "sid", group, 1, CFG).withColumn("cells", H.content_sum())
        bent = F.transform("audio", lambda v: (v + 1).cast("int"))
        placed = placed.withColumn("audio", F.when(F.col("sid") % 50 == DAMAGED, bent).otherwise(F.col("audio")))
        with staged(placed, "damaged") as rows:
            for dataset, split, n in rows.groupBy(*group).count().collect():
                part = rows.where((F.col("dataset") == dataset) & (F.col("split") == split)).drop(*group)
                H.write_chunks(part, n, f"{path}/{dataset}", split, None, 1, CFG)

    return written_once(spark, sf, "damaged", write)


def chunk_dir(spark: SparkSession, sf: str) -> str:
    """Samples as chunk files: one directory per dataset, every split in each, and a broken file."""

    def write(path: str) -> None:
        # Another tool's file, there before the first run.
        put_bytes(spark, f"{path}/user/train_part_broken.parquet", b"not a table")
        group = ("dataset", "split")
        # Lines are numbered and dealt out as text; their arrays, several times as large, are made beside the writing.
        placed = H.assign_chunks(spoken_lines(spark, sf), "file_no", "sid", group, 1, CFG)
        folder = new_scratch(spark, "placed")
        placed.write.partitionBy(*group).parquet(folder)
        lines = spark.read.parquet(folder)
        for dataset, split, n in lines.groupBy(*group).count().collect():
            part = lines.where((F.col("dataset") == dataset) & (F.col("split") == split))
            part = with_arrays(part, "file_no", "sid", "position", "chunk_no").withColumn("cells", H.content_sum())
            H.write_chunks(part, n, f"{path}/{dataset}", split, None, 1, CFG)

    return written_once(spark, sf, "chunks", write)

