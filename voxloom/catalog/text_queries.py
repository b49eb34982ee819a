"""Text cleaning, speaker labels, run outcomes, codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.catalog.tables import BYTES, CFG, DIALOGUE, PROSE, SAMPLES, dialogue, prose, samples, spoken
from voxloom.functions import codes as C
from voxloom.functions import text as X
from voxloom.operators import stats as ST
from voxloom.operators import tokenize as K
from voxloom.plans.tokenize import outcomes
from voxloom.session import staged

QUERIES, ORACLE = {}, {}


def strip_text(spark, sf):
    rows = prose(spark, sf).withColumn("stripped", X.strip_text(F.col("text")))
    return rows.select(
        "doc_id",
        F.length("text").alias("raw_chars"),
        F.length("stripped").alias("chars"),
        F.md5("stripped").alias("digest"),
    )


ORACLE["strip_text"] = f"""with {PROSE}
  select doc_id, length(raw)::int as raw_chars, length(txt)::int as chars, md5(txt) as digest from prose"""


def min_text_filter(spark, sf):
    kept = K.keep_long_enough(K.clean_rows(prose(spark, sf)))
    return kept.select("doc_id", F.length("text").alias("chars"))


ORACLE["min_text_filter"] = f"""with {PROSE}
  select doc_id, length(txt)::int as chars from prose where length(txt) >= 10"""


def speaker_default(spark, sf):
    """A corpus without the column, and one where some rows have no speaker."""
    absent = K.clean_rows(prose(spark, sf)).select(F.col("doc_id").alias("row"), F.lit("prose").alias("corpus"), "speaker")
    partly = dialogue(spark, sf).withColumn("speaker", F.when(F.col("speaker") != "system", F.col("speaker")))
    present = K.clean_rows(partly).select(F.col("sid").alias("row"), F.lit("dialogue").alias("corpus"), "speaker")
    return absent.unionByName(present)


ORACLE["speaker_default"] = f"""with {PROSE}, {DIALOGUE}
  select doc_id as row, 'prose' as corpus, '999' as speaker from prose
  union all select sid, 'dialogue', case when speaker = 'system' then '999' else speaker end from dialogue"""


def speaker_prefix(spark, sf):
    return K.clean_rows(dialogue(spark, sf)).select("sid", "tagged_text")


ORACLE["speaker_prefix"] = f"""with {DIALOGUE}
  select sid, '[' || speaker || ']' || txt as tagged_text from dialogue"""

OUTCOME = f"""{DIALOGUE}, fate as (
  select *, case when length(txt) < 10 then 'short_text'
    when speaker = 'system' then 'no_audio'
    when length(raw) % 7 = 0 then 'unsupported_container' end as reason from dialogue)"""


def _staged(spark, sf):
    return outcomes(spoken(spark, sf), CFG, keys=("sid",))


def quarantine(spark, sf):
    """Rows that fall out, with stage and reason: decoding runs, the good rows go on."""
    _, bad = K.split_outcome(_staged(spark, sf), ("sid",))
    return bad


ORACLE["quarantine"] = f"""with {OUTCOME}
  select sid, case when reason = 'short_text' then 'text' else 'audio' end as stage, reason
  from fate where reason is not null"""


def run_counters(spark, sf):
    """Rows per outcome as the job that writes them counts them; what it wrote is not read."""
    watched, counted = ST.observed_outcomes(_staged(spark, sf))
    with staged(watched, "counted"):
        rows = [(status, n) for status, n in counted.get.items() if n]
    return spark.createDataFrame(rows, "status string, n_rows bigint")


ORACLE["run_counters"] = f"""with {OUTCOME}
  select case when reason is null then 'written' when reason = 'short_text' then 'dropped_short'
    else 'quarantined' end as status, count(*)::bigint as n_rows
  from fate group by 1"""


def encode_text_bytes(spark, sf):
    """Every byte of every whole document; long texts cost time in proportion to their length."""
    ids = prose(spark, sf).select("doc_id", X.utf8_ids(F.col("text")).alias("ids"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return ids.select("doc_id", F.size("ids").alias("n_ids"), F.md5(listed).alias("digest"))


ORACLE["encode_text_bytes"] = f"""with {PROSE}, coded as (select doc_id, {BYTES.format("raw")} as ids from prose)
  select doc_id, len(ids)::int as n_ids, md5(array_to_string(ids, ',')) as digest from coded"""


def flatten_codes(spark, sf):
    nested = samples(spark, sf).withColumn("codes", C.reshape_codes(F.col("audio")))
    return nested.select("sid", F.posexplode(C.flatten_codes(F.col("codes"))).alias("i", "token"))


ORACLE["flatten_codes"] = f"""with {SAMPLES}
  select sid, (generate_subscripts(audio, 1) - 1)::int as i, unnest(audio) as token from samples"""


def sample_length(spark, sf):
    rows = samples(spark, sf)
    ok = C.is_consistent(F.col("audio"), F.col("text"), F.col("length"))
    return rows.select("sid", C.sample_length(F.col("audio"), F.col("text")).alias("length"), ok.alias("consistent"))


ORACLE["sample_length"] = f"""with {SAMPLES}
  select sid, (len(audio) // 32 + len(text) + 1)::int as length, true as consistent from samples"""


def reshape_codes(spark, sf):
    rows = samples(spark, sf).select("sid", F.posexplode(C.reshape_codes(F.col("audio"))).alias("codebook", "row"))
    return rows.select("sid", "codebook", F.posexplode("row").alias("frame", "token"))


ORACLE["reshape_codes"] = f"""with {SAMPLES},
  flat as (select sid, len(audio) // 32 as t, generate_subscripts(audio, 1) - 1 as i, unnest(audio) as token from samples)
  select sid, (i // t)::int as codebook, (i % t)::int as frame, token from flat"""


def without_short_or_done(spark, sf):
    """What is left to do when an earlier run finished the first two files and every held-out row."""
    rows = K.keep_long_enough(K.clean_rows(dialogue(spark, sf)))
    done = rows.where((F.col("file_no") < 2) | (F.col("split") != "train")).select("sid")
    return K.without_done(rows, done, "sid").select("sid", "file_no", "split")


QUERIES["resume_anti"] = without_short_or_done
ORACLE["resume_anti"] = f"""with {DIALOGUE}, kept as (select * from dialogue where length(txt) >= 10)
  select sid, file_no, split from kept
  where sid not in (select sid from kept where file_no < 2 or split <> 'train')"""

QUERIES.update(
    strip_text=strip_text,
    min_text_filter=min_text_filter,
    speaker_default=speaker_default,
    speaker_prefix=speaker_prefix,
    quarantine=quarantine,
    run_counters=run_counters,
    encode_text_bytes=encode_text_bytes,
    flatten_codes=flatten_codes,
    sample_length=sample_length,
    reshape_codes=reshape_codes,
)
