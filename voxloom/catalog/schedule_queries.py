"""Index, batches, epochs and replicas."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.catalog.tables import (
    BINS,
    CFG,
    DIALOGUE,
    INDEXED,
    N_EPOCHS,
    N_REPLICAS,
    PROSE,
    SAMPLES,
    SCHEDULE,
    chunk_dir,
    indexed_lengths,
    lengths,
    numbered_samples,
    prose,
    written_once,
)
from voxloom.operators import frames as R
from voxloom.operators import index as I
from voxloom.operators import schedule as B
from voxloom.operators.permutation import sql_twin
from voxloom.operators.position import position_by_number
from voxloom.plans.serve import build_index, create_batches
from voxloom.plans.serve import fetch_samples as read_samples
from voxloom.streaming.schedule import read_schedule, write_schedule

QUERIES, ORACLE = {}, {}


def _prose_rows(spark, sf):
    """Documents as samples of the file named after their source."""
    rows = prose(spark, sf).select("path", "doc_id", F.col("n_chars").cast("int").alias("length"))
    return position_by_number(rows, "path", "doc_id", "row_index", ("path",), CFG.position_block)


def _prose_files(spark, sf):
    return I.file_table(I.file_counts(prose(spark, sf)))


FILES = f"""{PROSE}, counts as (select path, count(*) as len from prose group by path),
  files as (select path, (sum(len) over (order by path) - len)::bigint as start, len::bigint as len from counts)"""


def file_counts(spark, sf):
    return I.file_counts(prose(spark, sf))


ORACLE["file_counts"] = f"""with {PROSE} select path, count(*)::bigint as len from prose group by path"""


def index_totals(spark, sf):
    return I.index_totals(_prose_files(spark, sf))


ORACLE["index_totals"] = f"""with {FILES}
  select count(*)::bigint as n_files, sum(len)::bigint as n_samples from files"""


def global_index(spark, sf):
    return I.global_index(_prose_rows(spark, sf), _prose_files(spark, sf))


ORACLE["global_index"] = f"""with {FILES}
  select (row_number() over (order by path, doc_id) - 1)::bigint as idx, path,
    (row_number() over (partition by path order by doc_id) - 1)::bigint as row_index, n_chars::int as length
  from prose"""


def locate_index(spark, sf):
    """Every number of the index looked up, from the file table alone."""
    asked = prose(spark, sf).select(F.col("doc_id").alias("idx"))
    return I.locate(asked, _prose_files(spark, sf), CFG)


ORACLE["locate_index"] = f"""with {FILES}
  select p.doc_id as idx, f.path, (p.doc_id - f.start)::bigint as row_index
  from prose p join files f on p.doc_id >= f.start and p.doc_id < f.start + f.len"""


def _bins(spark, sf):
    return B.length_bins(indexed_lengths(spark, sf), CFG)


def _n_bins(spark, sf):
    return B.bin_count(indexed_lengths(spark, sf).count(), CFG)


def length_bins(spark, sf):
    return _bins(spark, sf)


ORACLE["length_bins"] = f"""with {BINS}
  select bin, slot_in_bin, idx, length from bins"""


def bin_pad_length(spark, sf):
    return R.pad_lengths(_bins(spark, sf))


ORACLE["bin_pad_length"] = f"""with {BINS} select bin, max(length) as pad_length from bins group by bin"""


def batch_plan(spark, sf):
    """The flagship: transcripts to length-sorted batches and the padding each of them needs."""
    return B.bin_stats(_bins(spark, sf))


ORACLE["batch_plan"] = f"""with {BINS}
  select bin, count(*)::bigint as n_samples, min(length) as min_length, max(length) as max_length,
    sum(length)::bigint as used_frames, (count(*) * max(length) - sum(length))::bigint as pad_frames
  from bins group by bin"""


def shuffle_bins(spark, sf):
    bins = _bins(spark, sf).select("bin").distinct()
    return B.shuffle_bins(bins, _n_bins(spark, sf), N_EPOCHS, CFG)


ORACLE["shuffle_bins"] = f"""with {SCHEDULE} select bin, epoch, pos from placed"""


def _schedule(spark, sf, **kw):
    return B.schedule(_bins(spark, sf), _n_bins(spark, sf), N_EPOCHS, N_REPLICAS, CFG, **kw)


def shuffle_within_bin(spark, sf):
    members = B.over_epochs(B.bin_members(_bins(spark, sf)), N_EPOCHS)
    mixed = members.select("epoch", "bin", F.posexplode(B.shuffle_members(CFG.seed)).alias("slot_in_bin", "m"))
    return mixed.select("epoch", "bin", "slot_in_bin", "m.idx")


ORACLE["shuffle_within_bin"] = f"""with {SCHEDULE} select epoch, bin, slot_in_bin, idx from schedule"""


def rank_stride(spark, sf):
    placed = shuffle_bins(spark, sf)
    return placed.select("epoch", "bin", "pos", B.rank_of(F.col("pos"), N_REPLICAS).alias("rank"))


ORACLE["rank_stride"] = f"""with {SCHEDULE}
  select epoch, bin, pos, (pos % {N_REPLICAS})::int as rank from placed"""


def epoch_schedule(spark, sf):
    return _schedule(spark, sf)


ORACLE["epoch_schedule"] = f"""with {SCHEDULE} select epoch, rank, pos, bin, slot_in_bin, idx, length from schedule"""


def epoch_schedule_even(spark, sf):
    """The same schedule when every replica must get equally many bins."""
    return _schedule(spark, sf, uneven="drop")


ORACLE["epoch_schedule_even"] = f"""with {SCHEDULE}
  select epoch, rank, pos, bin, slot_in_bin, idx, length from schedule
  where pos < (select count(distinct bin) // {N_REPLICAS} * {N_REPLICAS} from bins)"""


def eval_schedule(spark, sf):
    return _schedule(spark, sf, shuffle=False)


ORACLE["eval_schedule"] = f"""with {BINS}
  select 0 as epoch, (bin % {N_REPLICAS})::int as rank, bin as pos, bin, slot_in_bin, idx, length from bins"""


def _per_rank(spark, sf):
    return B.bins_per_rank(rank_stride(spark, sf), _n_bins(spark, sf), N_REPLICAS)


PER_RANK = f"""{SCHEDULE}, per_rank as (
  select epoch, (pos % {N_REPLICAS})::int as rank, count(*)::bigint as actual_bins,
    (select count(distinct bin) // {N_REPLICAS} from bins)::bigint as planned_bins
  from placed group by 1, 2)"""


def bins_per_rank(spark, sf):
    return _per_rank(spark, sf)


ORACLE["bins_per_rank"] = f"""with {PER_RANK} select * from per_rank"""


def step_plan(spark, sf):
    return B.step_plan(_per_rank(spark, sf), N_EPOCHS, N_REPLICAS, CFG)


ORACLE["step_plan"] = f"""with {PER_RANK}
  select rank, sum(actual_bins)::bigint as actual_steps, (max(planned_bins) * {N_EPOCHS})::bigint as planned_steps,
    {CFG.batch_size * CFG.grad_acc_steps * N_REPLICAS}::bigint as effective_batch
  from per_rank group by rank"""


def _sum(column):
    return F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + x)


def fetch_samples(spark, sf):
    """The first sample of every batch, fetched by number."""
    asked = _bins(spark, sf).where(F.col("slot_in_bin") == 0).select("idx")
    found = I.fetch(asked, numbered_samples(spark, sf))
    return found.select("idx", "sid", "length", _sum("audio").alias("audio_sum"), _sum("text").alias("text_sum"))


ORACLE["fetch_samples"] = f"""with {BINS}
  select idx, sid, length, list_sum(audio)::bigint as audio_sum, list_sum(text)::bigint as text_sum
  from bins where slot_in_bin = 0"""


def bins_join_samples(spark, sf):
    joined = B.attach_samples(_bins(spark, sf), numbered_samples(spark, sf))
    return joined.select("bin", "slot_in_bin", "idx", "sid", F.size("audio").alias("n_audio"), _sum("text").alias("text_sum"))


ORACLE["bins_join_samples"] = f"""with {BINS}
  select bin, slot_in_bin, idx, sid, len(audio)::int as n_audio, list_sum(text)::bigint as text_sum from bins"""


def val_fallback(spark, sf):
    """Dialogue has validation rows and keeps them; prose lost its own, so its test rows step in."""
    talk = lengths(spark, sf).select(F.lit("dialogue").alias("corpus"), "split", F.col("sid").alias("row"))
    docs = prose(spark, sf).select(
        F.lit("prose").alias("corpus"),
        F.when(F.col("split") == "validation", "train").otherwise(F.col("split")).alias("split"),
        F.col("doc_id").alias("row"),
    )

    def held_out(rows):
        return B.validation_or_test(
            rows.where(F.col("split") == "validation"), rows.where(F.col("split") == "test")
        )

    return held_out(talk).unionByName(held_out(docs))


ORACLE["val_fallback"] = f"""with {SAMPLES}, {PROSE}, rows as (
    select 'dialogue' as corpus, split, sid as row from samples
    union all
    select 'prose', case when split = 'validation' then 'train' else split end, doc_id from prose)
  select * from rows where split = 'validation'
  union all
  select * from rows r where split = 'test'
    and not exists (select 1 from rows v where v.corpus = r.corpus and v.split = 'validation')"""

def served_schedule(spark, sf):
    """Schedules as a trainer asks for them: from chunk files, shuffled training batches over all
    replicas and evaluation batches in order."""
    train, held_out = create_batches(spark, chunk_dir(spark, sf), N_EPOCHS, N_REPLICAS, CFG)
    return train.withColumn("use", F.lit("train")).unionByName(held_out.withColumn("use", F.lit("eval")))


def fetch_files(spark, sf):
    """The first sample of every training batch, read from chunk files by number."""
    root = chunk_dir(spark, sf)
    index = build_index(spark, root, "train")
    asked = B.length_bins(index.index, CFG).where(F.col("slot_in_bin") == 0).select("idx")
    found = read_samples(spark, root, "train", asked, CFG)
    return found.select("idx", "length", _sum("audio").alias("audio_sum"), _sum("text").alias("text_sum"))


ORACLE["fetch_files"] = f"""with {SAMPLES}, numbered as (
    select *, row_number() over (order by dataset, file_no, sid) - 1 as idx from samples where split = 'train'),
  ranked as (select *, row_number() over (order by length, idx) - 1 as rnk from numbered)
  select idx, length, list_sum(audio)::bigint as audio_sum, list_sum(text)::bigint as text_sum
  from ranked where rnk % {CFG.batch_size} = 0"""


def _served(use, split, epochs, pos, slot):
    return f"""{use}_indexed as (
    select row_number() over (order by dataset, file_no, sid) - 1 as idx, length from samples where split = '{split}'),
  {use}_ranked as (select *, row_number() over (order by length, idx) - 1 as rnk from {use}_indexed),
  {use}_bins as (select rnk // {CFG.batch_size} as bin, (rnk % {CFG.batch_size}) as place, * from {use}_ranked),
  {use}_placed as (
    select epoch, bin, {pos} as pos
    from (select distinct bin from {use}_bins), (select unnest(range(0, {epochs}))::int as epoch)),
  {use} as (
    select p.epoch, (p.pos % {N_REPLICAS})::int as rank, p.pos, b.bin, ({slot})::int as slot_in_bin, b.idx, b.length,
      '{use}' as use
    from {use}_placed p join {use}_bins b using (bin))"""


_SHUFFLED_BINS = f"row_number() over (partition by epoch order by md5('{CFG.seed}:' || epoch || ':' || bin), bin) - 1"
_SHUFFLED_SLOTS = f"""row_number() over (partition by p.epoch, b.bin
      order by md5('{CFG.seed}:' || p.epoch || ':' || b.idx), b.idx) - 1"""
ORACLE["served_schedule"] = f"""with {SAMPLES},
  {_served("train", "train", N_EPOCHS, _SHUFFLED_BINS, _SHUFFLED_SLOTS)},
  {_served("eval", "validation", 1, "bin", "b.place")}
  select * from train union all select * from eval"""



def epoch_permutation(spark, sf):
    """Every bin's place in every epoch by formula, and the bin that the formula finds at that place."""
    n_bins = _n_bins(spark, sf)
    placed = B.permute_bins(_bins(spark, sf).select("bin").distinct(), n_bins, N_EPOCHS, CFG)
    return B.bin_at(placed.withColumnRenamed("bin", "number"), n_bins, CFG)


PERMUTED = f"""{BINS}, epochs as (select unnest(range(0, {N_EPOCHS}))::int as epoch),
  asked as (select epoch, bin as number from (select distinct bin from bins), epochs),
  {sql_twin("asked", "select count(distinct bin) from bins", CFG.seed)}"""
ORACLE["epoch_permutation"] = f"""with {PERMUTED} select epoch, number, place as pos, number as bin from placed"""


def formula_schedule(spark, sf):
    """The whole schedule when places are computed instead of sorted."""
    return _schedule(spark, sf, shuffle="formula")


PERMUTED_SCHEDULE = f"""{PERMUTED}
  select p.epoch, (p.place % {N_REPLICAS})::int as rank, p.place as pos, b.bin, b.idx, b.length,
    (row_number() over (partition by p.epoch, b.bin
      order by md5('{CFG.seed}:' || p.epoch || ':' || b.idx), b.idx) - 1)::int as slot_in_bin
  from placed p join bins b on b.bin = p.number"""
ORACLE["formula_schedule"] = f"""with {PERMUTED_SCHEDULE}"""


def stream_schedule_dir(spark, sf):
    """The endless schedule, stopped and taken up twice: each start goes on for one batch of places."""

    def write(path):
        n_bins = _n_bins(spark, sf)
        B.bin_members(_bins(spark, sf)).write.parquet(f"{path}/members")
        members = spark.read.parquet(f"{path}/members")
        for _ in range(3):
            rows = read_schedule(spark, members, n_bins, N_REPLICAS, CFG, bins_per_batch=n_bins * N_EPOCHS // 3 + 1)
            write_schedule(rows, path).awaitTermination()

    return written_once(spark, sf, "stream_schedule", write)


def schedule_stream(spark, sf):
    """The first epochs of a schedule that a stream hands out over two restarts."""
    rows = spark.read.parquet(f"{stream_schedule_dir(spark, sf)}/places").where(F.col("epoch") < N_EPOCHS)
    return rows.select("epoch", F.col("rank").cast("int").alias("rank"), "pos", "bin", "slot_in_bin", "idx", "length")


ORACLE["schedule_stream"] = f"""with {PERMUTED_SCHEDULE}"""

QUERIES.update(
    epoch_permutation=epoch_permutation,
    fetch_files=fetch_files,
    formula_schedule=formula_schedule,
    schedule_stream=schedule_stream,
    file_counts=file_counts,
    index_totals=index_totals,
    global_index=global_index,
    locate_index=locate_index,
    length_bins=length_bins,
    bin_pad_length=bin_pad_length,
    batch_plan=batch_plan,
    shuffle_bins=shuffle_bins,
    shuffle_within_bin=shuffle_within_bin,
    rank_stride=rank_stride,
    epoch_schedule=epoch_schedule,
    epoch_schedule_even=epoch_schedule_even,
    eval_schedule=eval_schedule,
    bins_per_rank=bins_per_rank,
    step_plan=step_plan,
    fetch_samples=fetch_samples,
    bins_join_samples=bins_join_samples,
    val_fallback=val_fallback,
    served_schedule=served_schedule,
)
