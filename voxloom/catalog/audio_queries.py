"""Waveform stages over ``embeddings``: its vectors are the samples of short recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.catalog.tables import CFG, audio_cell, table, wav_bytes
from voxloom.config import PipelineConfig
from voxloom.functions.arrays import bind
from voxloom.functions.audio import HOP, LOWPASS_WIDTH, ROLLOFF, LatticeEncoder
from voxloom.operators import audio as A

QUERIES, ORACLE = {}, {}
HOLD = 75  # each vector entry is held for this many samples: 64 * 75 samples make 2.5 frames
PPM = 1_000_000


def _ppm(value):
    """Millionths, rounded the same way on both sides."""
    return F.floor(value * PPM + 0.5).cast("bigint")


def decode_audio(spark, sf):
    """Vectors written as mono or stereo WAV bytes, then decoded: every PCM value must come back."""
    rows = table(spark, sf, "embeddings").withColumn("n_channels", F.col("label") % 2 + 1)
    pcm = F.transform("embedding", lambda x: F.floor(x.cast("double") * 32767).cast("int"))
    cell = audio_cell(raw=bind(pcm, lambda p: wav_bytes(p, F.col("n_channels"), F.lit(8000))))
    decoded = A.decode_channels(rows.select("vec_id", cell.alias("audio")))
    channels = decoded.select("vec_id", F.posexplode("channels_data").alias("channel", "wave"))
    return channels.select("vec_id", "channel", F.posexplode("wave").alias("i", "x")).select(
        "vec_id", "channel", "i", F.round(F.col("x").cast("double") * 32768).cast("int").alias("pcm")
    )


ORACLE["decode_audio"] = """with cells as (
    select vec_id, label % 2 + 1 as c, generate_subscripts(embedding, 1) - 1 as k, unnest(embedding)::double as x
    from embeddings)
  select vec_id, (k % c)::int as channel, (k // c)::int as i, floor(x * 32767)::int as pcm from cells"""


def downmix(spark, sf):
    """Vectors as two channels of 32 samples."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    mixed = table(spark, sf, "embeddings").select("vec_id", F.posexplode(A.downmix_planar(wide, 2)).alias("i", "x"))
    return mixed.select("vec_id", "i", _ppm(F.col("x")).alias("ppm"))


ORACLE["downmix"] = f"""with cells as (
    select vec_id, generate_subscripts(embedding, 1) - 1 as k, unnest(embedding)::double as x from embeddings)
  select a.vec_id, a.k::int as i, floor((a.x + b.x) / 2.0::double * {PPM} + 0.5::double)::bigint as ppm
  from cells a join cells b on a.vec_id = b.vec_id and b.k = a.k + 32"""


def resample(spark, sf):
    """Vectors as 16 kHz recordings, brought to 24 kHz."""
    cell = audio_cell(array=F.col("embedding"), channels=F.lit(1), rate=F.lit(16_000))
    rows = table(spark, sf, "embeddings").select("vec_id", cell.alias("audio"))
    waves = A.standardise_audio(rows, CFG).select("vec_id", F.posexplode("waveform").alias("i", "x"))
    return waves.select("vec_id", "i", _ppm(F.col("x")).alias("ppm"))


# 16 kHz to 24 kHz is 2 to 3: output j stands at j / 3, input i at i / 2.
ORACLE["resample"] = f"""with cells as (
    select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as x from embeddings),
  spans as (
    select i, j, (i / 2.0::double - j / 3.0::double) * (2 * {ROLLOFF}::double) as d
    from (select unnest(range(0, 64)) as i), (select unnest(range(0, 96)) as j)),
  taps as (
    select i, j, (case when d = 0 then 1 else sin(pi() * d) / (pi() * d) end)
      * cos(pi() * d / {2 * LOWPASS_WIDTH}) * cos(pi() * d / {2 * LOWPASS_WIDTH}) * {ROLLOFF}::double as w
    from spans where abs(d) < {LOWPASS_WIDTH})
  select vec_id, j::int as i, floor(sum(x * w) * {PPM} + 0.5::double)::bigint as ppm
  from cells join taps using (i) group by vec_id, j"""


def resample_blocks(spark, sf):
    """The same recordings at 16 and 24 samples a second, each in four blocks that know nothing of each other."""
    cell = audio_cell(array=F.col("embedding"), channels=F.lit(1), rate=F.lit(16))
    rows = table(spark, sf, "embeddings").select("vec_id", cell.alias("audio"))
    blocks = A.resample_in_blocks(rows, PipelineConfig(sample_rate=24), seconds=1)
    waves = blocks.select("vec_id", "first", F.posexplode("waveform").alias("i", "x"))
    return waves.select("vec_id", (F.col("first") + F.col("i")).cast("int").alias("i"), _ppm(F.col("x")).alias("ppm"))


ORACLE["resample_blocks"] = ORACLE["resample"]


def encode_audio(spark, sf):
    """Vectors held to 4,800 samples each, encoded to 32 codebooks by 3 frames."""
    held = F.flatten(F.transform("embedding", lambda x: F.array_repeat(x, HOLD)))
    cell = audio_cell(array=held, channels=F.lit(1), rate=F.lit(CFG.sample_rate))
    coded = A.encode_audio(table(spark, sf, "embeddings").select("vec_id", cell.alias("audio")), CFG)
    books = coded.select("vec_id", F.posexplode("codes").alias("codebook", "row"))
    return books.select("vec_id", "codebook", F.posexplode("row").alias("frame", "code"))


def lattice_sql(means: str, key: str) -> str:
    """CTEs from block means ``(key, frame, block, m)`` to ``codes (key, codebook, frame, code)``."""
    levels = LatticeEncoder.LEVELS
    rounds = [
        f"""r0 as (select {key}, frame, block,
          least(greatest((m + 1.0::double) / 2.0::double, 0.0::double), 1.0::double - pow(2.0::double, -40)) * {levels} as s
          from {means})"""
    ]
    for r in range(1, 4):
        rounds.append(f"r{r} as (select {key}, frame, block, (s - floor(s)) * {levels} as s from r{r - 1})")
    digits = " union all ".join(f"select *, {r} as round, floor(s)::int as d from r{r}" for r in range(4))
    return f"""{", ".join(rounds)}, digits as ({digits}),
      codes as (
      select {key}, (a.round * 8 + a.block // 2)::int as codebook, a.frame::int as frame, (a.d * {levels} + b.d)::int as code
      from digits a join digits b using ({key}, frame, round) where a.block % 2 = 0 and b.block = a.block + 1)"""


# A block mean takes every held value by its share of the block: values k and blocks overlap in at most HOLD samples.
ORACLE["encode_audio"] = f"""with shares as (
    select k, frame, block,
      least({HOLD} * (k + 1), frame * {HOP} + (block + 1) * {HOP // 16}) - greatest({HOLD} * k, frame * {HOP} + block * {HOP // 16}) as n
    from (select unnest(range(0, 64)) as k), (select unnest(range(0, 3)) as frame), (select unnest(range(0, 16)) as block)),
  cells as (select vec_id, generate_subscripts(embedding, 1) - 1 as k, unnest(embedding)::double as x from embeddings),
  sums as (select vec_id, frame, block, sum(x * n) as t from cells join shares using (k) where n > 0 group by 1, 2, 3),
  grid as (
    select vec_id, frame, block
    from embeddings, (select unnest(range(0, 3)) as frame), (select unnest(range(0, 16)) as block)),
  means as (
    select g.*, coalesce(t, 0.0::double) / {HOP // 16}.0::double as m
    from grid g left join sums using (vec_id, frame, block)),
  {lattice_sql("means", "vec_id")}
  select * from codes"""

QUERIES.update(
    decode_audio=decode_audio, downmix=downmix, resample=resample, resample_blocks=resample_blocks, encode_audio=encode_audio
)
