"""Files: scanning corpora, writing and reading chunks, whole tokenisation runs."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from voxloom.catalog.audio_queries import lattice_sql
from voxloom.catalog.tables import (
    CFG,
    DAMAGED,
    DIALOGUE,
    N_DIVISIONS,
    PROSE,
    SAMPLES,
    chunk_dir,
    corpus_dir,
    corpus_schema,
    damaged_chunk_dir,
    early_corpus_dir,
    prose,
    table,
    written_once,
)
from voxloom.functions.audio import HOP
from voxloom.operators import index as I
from voxloom.operators import stats as ST
from voxloom.operators import tokenize as K
from voxloom.operators.position import exclusive_sums
from voxloom.plans.tokenize import tokenize_corpus as run_tokenize_corpus
from voxloom.sources import chunks as H
from voxloom.sources import corpus as S
from voxloom.sources.catalogue import catalogue, files_per_dataset, next_chunks, readable
from voxloom.sources.commits import left_over
from voxloom.streaming.tokenize import stream_samples, tokenize_stream

QUERIES, ORACLE = {}, {}


def scan_split(spark, sf):
    """All splits of a written corpus; ``val`` is another name for ``validation``."""
    root, schema = corpus_dir(spark, sf), corpus_schema(spark, sf)
    parts = [
        S.scan_split(spark, root, asked, schema).withColumn("split", F.lit(split))
        for asked, split in (("train", "train"), ("val", "validation"), ("test", "test"))
    ]
    rows = H.union_datasets(parts)
    return rows.select("split", "sid", "file_no", "row_index", F.length("text").alias("chars"))


ORACLE["scan_split"] = f"""with {DIALOGUE}
  select split, sid, file_no, (row_number() over (partition by split, file_no order by sid) - 1)::bigint as row_index,
    length(raw)::int as chars
  from dialogue"""


def scan_division(spark, sf):
    """The training files dealt out to three divisions, each division scanned on its own."""
    root, schema = corpus_dir(spark, sf), corpus_schema(spark, sf)
    parts = [
        S.scan_division(spark, root, "train", d, N_DIVISIONS, schema).withColumn("division", F.lit(d))
        for d in range(N_DIVISIONS)
    ]
    return H.union_datasets(parts).select("division", "sid", "file_no")


ORACLE["scan_division"] = f"""with {DIALOGUE}
  select (file_no % {N_DIVISIONS})::int as division, sid, file_no from dialogue where split = 'train'"""


def _with_division(rows):
    """Division of every row, from the place of its file in the sorted file list."""
    files = rows.select("path").distinct().withColumn("__one", F.lit(1))
    ordinals = exclusive_sums(files, "__one", ["path"], "file_ordinal").select("path", "file_ordinal")
    return rows.join(ordinals, "path").withColumn(
        "division", S.division_of(F.col("split"), F.col("file_ordinal"), N_DIVISIONS)
    )


DIVIDED = f"""{PROSE}, divided as (
  select *, (case when split = 'train' then (dense_rank() over (order by path) - 1) % {N_DIVISIONS} else 0 end)::int
    as division from prose)"""


def division_routing(spark, sf):
    rows = _with_division(prose(spark, sf).select("path", "split"))
    return rows.groupBy("division", "split", "path").agg(F.count(F.lit(1)).alias("n_rows"))


ORACLE["division_routing"] = f"""with {DIVIDED}
  select division, split, path, count(*)::bigint as n_rows from divided group by 1, 2, 3"""


def _kept_prose(spark, sf):
    return K.keep_long_enough(K.clean_rows(prose(spark, sf))).select("doc_id", "path", "split")


def chunk_assign(spark, sf):
    placed = H.assign_chunks(_kept_prose(spark, sf), "path", "doc_id", ("split",), 1, CFG)
    return placed.select("doc_id", "split", "position", "chunk_no")


CHUNKS = f"""{PROSE}, placed as (
  select doc_id, split, row_number() over (partition by split order by path, doc_id) - 1 as position
  from prose where length(txt) >= 10),
  chunked as (select *, position // {CFG.chunk_rows} + 1 as chunk_no from placed)"""
ORACLE["chunk_assign"] = f"""with {CHUNKS} select doc_id, split, position, chunk_no from chunked"""


def chunk_assign_div(spark, sf):
    rows = _with_division(_kept_prose(spark, sf))
    placed = H.assign_chunks(rows, "path", "doc_id", ("split", "division"), 1, CFG)
    return placed.select("doc_id", "split", "division", "position", "chunk_no")


ORACLE["chunk_assign_div"] = f"""with {DIVIDED}, placed as (
    select doc_id, split, division,
      row_number() over (partition by split, division order by path, doc_id) - 1 as position
    from divided where length(txt) >= 10)
  select *, position // {CFG.chunk_rows} + 1 as chunk_no from placed"""


def split_summary(spark, sf):
    return H.split_summary(chunk_assign(spark, sf))


ORACLE["split_summary"] = f"""with {CHUNKS}
  select split, count(distinct chunk_no)::bigint as n_chunks, count(*)::bigint as n_samples from chunked group by split"""


def next_chunk(spark, sf):
    """Chunk numbering per language, from file names of which some do not end in a number."""
    rows = table(spark, sf, "documents")
    tail = F.when(F.col("source") == "src3", F.concat(F.lit("copy"), F.col("doc_id"))).otherwise(
        F.lpad(F.col("doc_id").cast("string"), 9, "0")
    )
    stems = rows.select("lang", F.concat(F.lit("train_part_"), tail).alias("stem"))
    return stems.groupBy("lang").agg(H.next_number(F.col("stem")).alias("next_chunk"))


ORACLE["next_chunk"] = """with stems as (
    select lang, 'train_part_' || case when source = 'src3' then 'copy' || doc_id
      else lpad(doc_id::varchar, 9, '0') end as stem from documents)
  select lang, coalesce(max(try_cast(regexp_extract(stem, '_([^_]+)$', 1) as bigint)), 0)::bigint + 1 as next_chunk
  from stems group by lang"""


def existing_count(spark, sf):
    """Samples per dataset and split of a written chunk table, from file footers."""
    return H.sample_counts(spark, chunk_dir(spark, sf))


ORACLE["existing_count"] = f"""with {SAMPLES}
  select dataset, split, count(*)::bigint as n_samples from samples group by 1, 2"""


def _dataset(path):
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def file_index(spark, sf):
    """Files of the training split over all datasets, with the number of their first sample."""
    found = readable(catalogue(spark, chunk_dir(spark, sf), "train"))
    files = I.file_table(found.select("path", F.col("n_rows").alias("len")))
    return files.select(_dataset(F.col("path")).alias("dataset"), "start", "len")


ORACLE["file_index"] = f"""with {SAMPLES}, placed as (
    select dataset, (row_number() over (partition by dataset order by file_no, sid) - 1) // {CFG.chunk_rows} as chunk
    from samples where split = 'train'),
  counts as (select dataset, chunk, count(*) as len from placed group by 1, 2)
  select dataset, (sum(len) over (order by dataset, chunk) - len)::bigint as start, len::bigint as len from counts"""


def discover_datasets(spark, sf):
    return files_per_dataset(catalogue(spark, chunk_dir(spark, sf)))


ORACLE["discover_datasets"] = f"""with {SAMPLES}, counts as (
    select split, dataset, (count(*) + {CFG.chunk_rows - 1}) // {CFG.chunk_rows} as n from samples group by 1, 2
    union all select 'train', 'user', 1)
  select split, dataset, sum(n)::bigint as n_files from counts group by 1, 2"""


def corrupt_report(spark, sf):
    report = H.damaged_files(spark, catalogue(spark, chunk_dir(spark, sf)))
    return report.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
        _dataset(F.col("path")).alias("dataset"),
        "footer_rows",
        "read_rows",
    )


ORACLE["corrupt_report"] = """
  select 'train_part_broken.parquet' as file, role as dataset, 0::bigint as footer_rows, 0::bigint as read_rows
  from conversations where role = 'user' group by role"""


def union_chunks(spark, sf):
    """All datasets and splits as one table, arrays included."""
    root = chunk_dir(spark, sf)
    parts = [
        H.scan_chunks(spark, H.sound_files(spark, root, s)).withColumn("split", F.lit(s)) for s in S.SPLITS
    ]

    def total(column):
        return F.sum(F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + x)).cast("bigint")

    rows = H.union_datasets(parts).withColumn("dataset", _dataset(F.col("path")))
    return rows.groupBy("dataset", "split").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum("length").cast("bigint").alias("frames"),
        total("audio").alias("audio_sum"),
        total("text").alias("text_sum"),
    )


ORACLE["union_chunks"] = f"""with {SAMPLES}
  select dataset, split, count(*)::bigint as n_samples, sum(length)::bigint as frames,
    sum(list_sum(audio))::bigint as audio_sum, sum(list_sum(text))::bigint as text_sum
  from samples group by 1, 2"""


def _weighted(column):
    place = F.zip_with(column, F.sequence(F.lit(1), F.size(column)), lambda v, i: v.cast("bigint") * i)
    return F.aggregate(place, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _token_rows(rows, numbers=("chunk_no", "position")):
    return rows.select(
        "split",
        F.regexp_extract("file_name", r"-(\d{5})-", 1).cast("int").alias("file_no"),
        "row_index",
        *[c for c in numbers if c in rows.columns],
        "length",
        _weighted("audio").alias("audio_sum"),
        _weighted("text").alias("text_sum"),
    )


TOKENS = f"""{DIALOGUE}, rows as (
    select *, row_number() over (partition by split, file_no order by sid) - 1 as row_index from dialogue),
  good as (
    select * from rows where length(txt) >= 10 and speaker <> 'system' and length(raw) % 7 <> 0),
  wave as (
    select sid, h, generate_subscripts(h, 1) - 1 as s, unnest(h) as b
    from (select sid, list_transform(regexp_extract_all(hex(encode(raw)), '..'), lambda x: ('0x' || x)::int) as h from good)),
  sums as (
    select sid, s // {HOP} as frame, (s % {HOP}) // {HOP // 16} as block, sum((b - 128) / 128.0::double) as t
    from wave group by 1, 2, 3),
  sizes as (select sid, (strlen(raw) + {HOP - 1}) // {HOP} as n_frames from good),
  grid as (
    select sid, frame, block from (select sid, unnest(range(0, n_frames)) as frame from sizes),
      (select unnest(range(0, 16)) as block)),
  means as (
    select g.*, coalesce(t, 0.0::double) / {HOP // 16}.0::double as m from grid g left join sums using (sid, frame, block)),
  {lattice_sql("means", "sid")},
  audio as (
    select sid, sum(code::bigint * (codebook * n_frames + frame + 1))::bigint as audio_sum
    from codes join sizes using (sid) group by sid),
  ids as (select sid, regexp_extract_all(hex(encode('[' || speaker || ']' || txt)), '..') as h from good),
  words as (
    select sid, sum(('0x' || x)::bigint * i)::bigint as text_sum, count(*) as n_text
    from (select sid, unnest(h) as x, generate_subscripts(h, 1) as i from ids) group by sid),
  tokens as (
    select g.split, g.file_no, g.row_index,
      row_number() over (partition by g.split order by g.file_no, g.row_index) - 1 as position,
      (n_frames + n_text + 1)::int as length, audio_sum, text_sum
    from good g join sizes using (sid) join audio using (sid) join words using (sid))"""


def token_dir(spark, sf):
    """Chunk files of a whole run in two sittings; the second, over an unchanged corpus, must find
    nothing to do."""

    def write(path):
        root, schema = corpus_dir(spark, sf), corpus_schema(spark, sf)
        run_tokenize_corpus(spark, root, path, schema, CFG)
        again = run_tokenize_corpus(spark, root, path, schema, CFG)
        if any(c.skipped != c.seen or c.written for c in again.values()):
            raise RuntimeError(f"rows were done twice: {again}")

    return written_once(spark, sf, "tokens", write)


def tokenize_corpus(spark, sf):
    """A whole run from corpus files to chunk files."""
    return _token_rows(spark.read.parquet(token_dir(spark, sf)))


ORACLE["tokenize_corpus"] = f"""with {TOKENS}
  select split, file_no, row_index, position // {CFG.chunk_rows} + 1 as chunk_no, position, length, audio_sum, text_sum
  from tokens"""


def stream_dir(spark, sf):
    """The same corpus tokenised incrementally, two files per micro-batch, each split in turn."""

    def write(path):
        root, schema = corpus_dir(spark, sf), corpus_schema(spark, sf)
        for split in S.SPLITS:
            tokenize_stream(spark, root, f"{path}/{split}", split, schema, CFG, files_per_batch=2).awaitTermination()

    return written_once(spark, sf, "stream", write)


def _streamed(spark, sf):
    return H.union_datasets([stream_samples(spark, f"{stream_dir(spark, sf)}/{split}") for split in S.SPLITS])


def stream_tokenize(spark, sf):
    """Samples of an incremental run."""
    return _token_rows(_streamed(spark, sf).drop("chunk_no", "position"))


def stream_chunks(spark, sf):
    """Chunks numbered through over all micro-batches of a split: none is larger than allowed, and
    together they hold every sample. Which files share a micro-batch is up to the source."""
    chunks = _streamed(spark, sf).groupBy("split", "chunk_no").agg(F.count(F.lit(1)).alias("n"))
    return chunks.groupBy("split").agg(
        F.sum("n").cast("bigint").alias("n_samples"),
        (F.max("chunk_no") == F.count(F.lit(1))).alias("numbered_through"),
        (F.max("n") <= CFG.chunk_rows).alias("within_size"),
    )


ORACLE["stream_tokenize"] = f"""with {TOKENS}
  select split, file_no, row_index, length, audio_sum, text_sum from tokens"""
ORACLE["stream_chunks"] = f"""with {TOKENS}
  select split, count(*)::bigint as n_samples, true as numbered_through, true as within_size from tokens group by split"""


def duplicate_ids(spark, sf):
    """Samples that two writers put out: the batch run and the stream read the same corpus."""
    stream = stream_dir(spark, sf)
    both = [spark.read.parquet(token_dir(spark, sf))]
    both += [spark.read.parquet(f"{stream}/{split}/samples") for split in S.SPLITS]
    rows = I.duplicate_ids(H.union_datasets([b.select("sample_id") for b in both]))
    name = F.col("sample_id")
    return rows.select(
        F.regexp_extract(name, r"/([a-z]+)-\d{5}-", 1).alias("split"),
        F.regexp_extract(name, r"-(\d{5})-", 1).cast("int").alias("file_no"),
        F.regexp_extract(name, r"#(\d+)$", 1).cast("bigint").alias("row_index"),
        "n_copies",
    )


ORACLE["duplicate_ids"] = f"""with {TOKENS} select split, file_no, row_index, 2::bigint as n_copies from tokens"""


class Killed(RuntimeError):
    """Ends a run between two moves."""


def divided_dir(spark, sf):
    """Three divisions of one corpus at the same time, into one folder. The second is killed when its first
    file is in place, and run again when the others are done."""

    def write(path):
        root, schema = corpus_dir(spark, sf), corpus_schema(spark, sf)

        def run(division, moved=None):
            return run_tokenize_corpus(spark, root, path, schema, CFG, division=division, n_divisions=N_DIVISIONS, moved=moved)

        def die(name):
            raise Killed(name)

        with ThreadPoolExecutor(N_DIVISIONS) as pool:
            runs = [pool.submit(run, d, die if d == 1 else None) for d in range(N_DIVISIONS)]
        if not isinstance(runs[1].exception(), Killed) or not left_over(spark, path, H.CHUNKS):
            raise RuntimeError("the second division was not killed between its files and their commit")
        for other in (runs[0], runs[2]):
            other.result()
        again = run(1)
        if any(c.skipped for c in again.values()):
            raise RuntimeError(f"rows of a killed run count as done: {again}")

    return written_once(spark, sf, "divided", write)


def tokenize_divided(spark, sf):
    """Samples of divisions that ran together: what the killed run left in the folder is not among them."""
    columns = "split string, division int, file_name string, row_index bigint, length int, audio array<int>, text array<int>"
    rows = H.committed_samples(spark, divided_dir(spark, sf), columns)
    return _token_rows(rows, ("division", "chunk_no"))


ORACLE["tokenize_divided"] = f"""with {TOKENS}, divided as (
    select *, case when split = 'train' then file_no % {N_DIVISIONS} else 0 end as division from tokens)
  select split, division::int as division, file_no, row_index,
    ((row_number() over (partition by split, division order by file_no, row_index) - 1) // {CFG.chunk_rows} + 1)::bigint as chunk_no,
    length, audio_sum, text_sum
  from divided"""


def resumed_dir(spark, sf):
    """A run over the corpus as it was, and another over the corpus as it is. Files that were finished are
    not opened again, half-done files are looked up in bitmaps, new files are read whole."""

    def write(path):
        schema = corpus_schema(spark, sf)
        first = run_tokenize_corpus(spark, early_corpus_dir(spark, sf), path, schema, CFG, dataset="corpus")
        second = run_tokenize_corpus(spark, corpus_dir(spark, sf), path, schema, CFG, dataset="corpus")
        if any(second[s].skipped != first[s].seen for s in first) or not all(c.seen for c in first.values()):
            raise RuntimeError(f"{second} does not go on from {first}")

    return written_once(spark, sf, "resumed", write)


def resume_partial(spark, sf):
    """Samples of a run that was taken up again, each once."""
    columns = "split string, file_name string, row_index bigint, length int, audio array<int>, text array<int>"
    return _token_rows(H.committed_samples(spark, resumed_dir(spark, sf), columns).drop("chunk_no"))


ORACLE["resume_partial"] = f"""with {TOKENS}
  select split, file_no, row_index, length, audio_sum, text_sum from tokens"""


def chunk_catalogue(spark, sf):
    """Every committed chunk file by data set, split and chunk number, with what its footer says."""
    files = catalogue(spark, chunk_dir(spark, sf))
    return files.select("dataset", "split", "division", "chunk_no", "n_rows", "has_sums")


ORACLE["chunk_catalogue"] = f"""with {SAMPLES}, placed as (
    select dataset, split, (row_number() over (partition by dataset, split order by file_no, sid) - 1) // {CFG.chunk_rows} + 1 as chunk_no
    from samples)
  select dataset, split, null::int as division, chunk_no::bigint as chunk_no, count(*)::bigint as n_rows, true as has_sums
  from placed group by dataset, split, chunk_no
  union all select 'user', 'train', null, null, null, null"""


def next_chunks_of_files(spark, sf):
    """Where the numbering of every data set and split goes on, as a run asks before it writes."""
    return next_chunks(catalogue(spark, chunk_dir(spark, sf)))


ORACLE["next_chunks"] = f"""with {SAMPLES}
  select dataset, split, null::int as division, ((count(*) + {CFG.chunk_rows - 1}) // {CFG.chunk_rows} + 1)::bigint as next_chunk
  from samples group by dataset, split"""


def damaged_report(spark, sf):
    """Files whose arrays do not have the sums that were written with them, and how many rows do."""
    files = catalogue(spark, damaged_chunk_dir(spark, sf))
    bad = H.damaged_files(spark, files)
    named = files.select(F.col("uri").alias("path"), "dataset", "split", "chunk_no")
    return bad.join(named, "path").select("dataset", "split", "chunk_no", "footer_rows", "read_rows")


ORACLE["damaged_report"] = f"""with {SAMPLES}, placed as (
    select dataset, split, sid, (row_number() over (partition by dataset, split order by file_no, sid) - 1) // {CFG.chunk_rows} + 1 as chunk_no
    from samples)
  select dataset, split, chunk_no::bigint as chunk_no, count(*)::bigint as footer_rows,
    count(*) filter (sid % 50 <> {DAMAGED})::bigint as read_rows
  from placed group by dataset, split, chunk_no having bool_or(sid % 50 = {DAMAGED})"""


def duration_estimate(spark, sf):
    """Documents as recordings of one second per character, a subset per source."""
    recordings = table(spark, sf, "documents").select(F.col("source").alias("subset"), F.col("n_chars").alias("seconds"))
    return ST.duration_estimate(recordings)


ORACLE["duration_estimate"] = """with hours as (
    select case when grouping(source) = 1 then 'TOTAL' else source end as subset,
      sum(n_chars)::double / 3600.0::double as audio_hours
    from documents group by rollup (source)),
  est as (select *, audio_hours * (12.53::double / 1084.69::double) as est_hours from hours)
  select subset, audio_hours, est_hours, est_hours / 24.0::double as est_days from est"""

QUERIES.update(
    scan_split=scan_split,
    scan_division=scan_division,
    division_routing=division_routing,
    chunk_assign=chunk_assign,
    chunk_assign_div=chunk_assign_div,
    split_summary=split_summary,
    next_chunk=next_chunk,
    existing_count=existing_count,
    file_index=file_index,
    discover_datasets=discover_datasets,
    corrupt_report=corrupt_report,
    union_chunks=union_chunks,
    tokenize_corpus=tokenize_corpus,
    stream_tokenize=stream_tokenize,
    stream_chunks=stream_chunks,
    duplicate_ids=duplicate_ids,
    tokenize_divided=tokenize_divided,
    resume_partial=resume_partial,
    chunk_catalogue=chunk_catalogue,
    next_chunks=next_chunks_of_files,
    damaged_report=damaged_report,
    duration_estimate=duration_estimate,
)
