"""Frame layout, masks, targets and dense batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.catalog.tables import (
    BINS,
    CFG,
    FRAMES,
    chunk_dir,
    indexed_lengths,
    numbered_samples,
    samples,
    written_once,
)
from voxloom.operators import frames as R
from voxloom.operators import schedule as B
from voxloom.plans import serve as S

QUERIES, ORACLE = {}, {}
KEYS = ["sid"]


def _frames(spark, sf):
    return R.sparse_frames(samples(spark, sf), KEYS)


def frames_sparse(spark, sf):
    return _frames(spark, sf)


ORACLE["frames_sparse"] = f"""with {FRAMES} select sid, kind, pos, slot, token from frames"""


def frames_text(spark, sf):
    return R.text_frames(_frames(spark, sf))


def frames_audio(spark, sf):
    return R.audio_frames(_frames(spark, sf))


def frames_end(spark, sf):
    return R.end_frames(_frames(spark, sf))


for _kind in ("text", "audio", "end"):
    ORACLE[f"frames_{_kind}"] = f"with {FRAMES} select sid, pos, slot, token from frames where kind = '{_kind}'"


def frames_mask(spark, sf):
    return R.frame_mask(samples(spark, sf), KEYS)


ORACLE["frames_mask"] = f"""with {FRAMES}
  select sid, pos, bool_or(slot < 32) as audio_valid, bool_or(slot = 32) as text_valid from frames group by sid, pos"""


def frame_checksum(spark, sf):
    """Cells and position-weighted checksum per sample."""
    total = R.weighted_sum(F.col("token"), F.col("pos"), F.col("slot"))
    return _frames(spark, sf).groupBy("sid").agg(F.count(F.lit(1)).alias("n_cells"), total.alias("checksum"))


ORACLE["frame_checksum"] = f"""with {FRAMES}
  select sid, count(*)::bigint as n_cells, sum(token::bigint * (pos * 33 + slot + 1))::bigint as checksum
  from frames group by sid"""


def target_frames(spark, sf):
    return R.target_frames(_frames(spark, sf)).drop("kind")


ORACLE["target_frames"] = f"""with {FRAMES} select sid, pos, slot, token from frames where slot < 32"""


def valid_positions(spark, sf):
    return R.valid_positions(_frames(spark, sf), KEYS)


ORACLE["valid_positions"] = f"""with {FRAMES} select distinct sid, pos from frames where slot in (0, 32)"""


def context_pairs(spark, sf):
    return R.context_pairs(samples(spark, sf), KEYS)


ORACLE["context_pairs"] = f"""with {FRAMES}
  select distinct sid, pos - 1 as context_pos, pos as target_pos from frames where slot < 32"""


def target_split(spark, sf):
    total = R.weighted_sum(F.col("token"), F.col("pos"), F.col("slot"))
    parts = R.split_targets(_frames(spark, sf))
    return parts.groupBy("sid", "part").agg(F.count(F.lit(1)).alias("n_cells"), total.alias("checksum"))


ORACLE["target_split"] = f"""with {FRAMES}
  select sid, case when slot = 0 then 'first' else 'rest' end as part, count(*)::bigint as n_cells,
    sum(token::bigint * (pos * 33 + slot + 1))::bigint as checksum
  from frames where slot < 32 group by 1, 2"""


def _batched(spark, sf):
    bins = B.length_bins(indexed_lengths(spark, sf), CFG)
    return bins.drop("length").join(numbered_samples(spark, sf), "idx")


def frame_subsample(spark, sf):
    return R.subsample_frames(_batched(spark, sf), 0, CFG)


ORACLE["frame_subsample"] = f"""with {BINS}, target as (
    select bin, idx, unnest(range(len(text), len(text) + len(audio) // 32 + 1))::int as pos from bins),
  picked as (
    select *, row_number() over (partition by bin order by md5('{CFG.seed}:0:' || idx || ':' || pos), idx, pos)::int as pick,
      count(*) over (partition by bin) // 16 as quota from target)
  select bin, idx, pos, pick from picked where pick <= quota"""


def pad_cells(spark, sf):
    """Cells a dense batch has, and how many of them carry a token."""
    bins = B.bin_stats(B.length_bins(indexed_lengths(spark, sf), CFG))
    width = CFG.frame_width
    return bins.select(
        "bin",
        (F.col("n_samples") * F.col("max_length") * width).cast("bigint").alias("dense_cells"),
        (F.col("pad_frames") * width).cast("bigint").alias("pad_cells"),
    )


ORACLE["pad_cells"] = f"""with {BINS}
  select bin, (count(*) * max(length) * 33)::bigint as dense_cells,
    ((count(*) * max(length) - sum(length)) * 33)::bigint as pad_cells
  from bins group by bin"""


def batch_dense(spark, sf):
    """Padded tensors of every batch."""
    bins = R.with_pad_length(B.length_bins(indexed_lengths(spark, sf), CFG))
    batched = bins.drop("length").join(numbered_samples(spark, sf), "idx")
    return R.dense_sums(R.dense_batches(batched, CFG), CFG)


DENSE = f"""{FRAMES}, sums as (
    select sid, count(*)::bigint as n_valid, sum(token::bigint * (pos * 33 + slot + 1))::bigint as checksum
    from frames group by sid),
  indexed as (select *, row_number() over (order by {{order}}) - 1 as idx from samples {{where}}),
  ranked as (select *, row_number() over (order by length, idx) - 1 as rnk from indexed),
  bins as (select rnk // {CFG.batch_size} as bin, (rnk % {CFG.batch_size})::int as slot_in_bin, * from ranked),
  padded as (select *, max(length) over (partition by bin) as pad from bins)
  select bin, slot_in_bin, idx, pad::int as n_frames, (pad * 33)::int as n_cells, n_valid, checksum
  from padded join sums using (sid)"""
ORACLE["batch_dense"] = "with " + DENSE.format(order="file_no, sid", where="")


def export_batches(spark, sf):
    """From chunk files to exported training batches, read back from the exported files."""

    def write(path):
        S.export_batches(spark, chunk_dir(spark, sf), "train", path, CFG, bins_per_file=32)

    return R.dense_sums(spark.read.parquet(written_once(spark, sf, "export", write)), CFG)


ORACLE["export_batches"] = "with " + DENSE.format(order="dataset, file_no, sid", where="where split = 'train'")

QUERIES.update(
    frames_sparse=frames_sparse,
    frames_text=frames_text,
    frames_audio=frames_audio,
    frames_end=frames_end,
    frames_mask=frames_mask,
    frame_checksum=frame_checksum,
    target_frames=target_frames,
    valid_positions=valid_positions,
    context_pairs=context_pairs,
    target_split=target_split,
    frame_subsample=frame_subsample,
    pad_cells=pad_cells,
    batch_dense=batch_dense,
    export_batches=export_batches,
)
