"""Quality rules: counts of words, symbols, repeated lines and windows, and a band of perplexity for each language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.kneser_ney import Scorer, blocked, delete_steps, filed, fitted, keyed, levels_of
from voxloom.llm.words import _PLACE_VALUE, SPACED, _byte_class, mix, window_hashes, words_of
from voxloom.session import materialize, scratch_paths

ORDER = 5
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # of 100 words
#: Quartile distances by which a long text's log perplexity may lie beyond the quartiles of its language.
BAND = 3.0
#: Texts of this many words may lie the square root of two times as far; shorter ones scatter more.
SCATTER = 100
#: Splits of the input that one task reads, where tasks are left for all cores: the more texts a block has, the fewer n-grams are told again.
SPLITS = 8
SYMBOLS = _byte_class(lambda b: chr(b) in "#*$%&|<>")
LINE = _byte_class(lambda b: b != 0x0A)
_HEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])


def _per_row(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][edges])


def _features(w, lines) -> tuple[np.ndarray, ...]:
    inside = SPACED[w.data]
    edges = w.byte_edges
    word_chars = _per_row(inside & _HEAD[w.data], edges)
    n_symbols = _per_row(SYMBOLS[w.data], edges)
    told = np.r_[0, np.cumsum(inside)]
    worded = told[lines.ends] > told[lines.starts]
    row = lines.row_of_word[worded]
    keys = np.unique(mix(lines.hashes()[worded] + row.astype(np.uint64) * _PLACE_VALUE[50]), return_index=True)[1]
    n = len(w.rows)
    n_dup_lines = np.bincount(row, minlength=n) - np.bincount(row[keys], minlength=n)
    starts = w.window_starts(WINDOW)
    own = w.row_of_word[starts]
    _, back, times = np.unique(mix(window_hashes(w.hashes(), WINDOW)[starts] + own.astype(np.uint64) * _PLACE_VALUE[51]), return_inverse=True, return_counts=True)
    again = starts[times[back] > 1]
    edge = np.zeros(w.starts.size + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    n_repeat = _per_row(np.cumsum(edge)[:-1] > 0, w.first)
    return w.counts, word_chars, n_symbols, n_dup_lines, n_repeat


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``doc_id, lang``, the counts, ``base_failed`` and ``log_perplexity`` (per word, null without words).

    A model for each language (null is one of its own) is counted over the whole texts of ``docs``, with
    single spaces between words, so n-grams reach across words. Null text has no words; null and repeated
    keys stay.
    """
    grouped = docs.select("doc_id", "lang", "text", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("__group"))
    blocks = blocked(grouped, "text", "__group", SPACED, False, True, order)
    top = blocks.where("__gram is not null").groupBy(F.col("__own").alias("grp"), F.col("__gram").alias("gram")).agg(F.sum("__c").alias("c"))
    with scratch_paths() as steps:
        levels = levels_of(top, order)
    with scratch_paths() as models:
        model = fitted(levels, modified=True)
    delete_steps(docs.sparkSession, steps)
    with scratch_paths() as steps:
        weights = keyed(model.counted(), True, order)
    delete_steps(docs.sparkSession, models)
    root, n_groups = filed(blocks, weights), min(len(model.groups), 1)
    delete_steps(docs.sparkSession, steps)

    def run(batches):
        scorer = Scorer(root, n_groups, SPACED, False, True, order)
        for b in batches:
            for part, w, scores, chars in scorer(b, 2, 4, 3):
                (lines,) = words_of(part.column(2), LINE)  # the same slice
                counts = [pa.array(x.astype(np.int64)) for x in _features(w, lines)]
                loss = -scores[:, 0] / np.maximum(w.counts, 1) if n_groups else np.zeros(chars.size)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *counts, pa.array(loss, mask=chars == 0)], names=["doc_id", "lang", *_COUNTS, "log_perplexity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = blocks.where("__gram is null").select("doc_id", "lang", "text", "__group", "__block").mapInArrow(run, f"doc_id {kind}, lang string, {', '.join(f'{c} long' for c in _COUNTS)}, log_perplexity double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def judged(rows: DataFrame, band: float = BAND) -> DataFrame:
    """Adds ``kept``: not failed by counts, and log perplexity within the band of the language (null is a language of its own)."""
    quartiles = F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.75)), 1000)
    bands = rows.where("not base_failed").groupBy("lang").agg(quartiles.alias("__q"))
    out = rows.alias("r").join(F.broadcast(bands).alias("b"), F.expr("r.lang <=> b.lang"), "left")  # a row for each language
    low, high = F.col("__q")[0], F.col("__q")[1]
    reach = band * F.greatest(high - low, F.lit(0.01)) * F.sqrt(1 + SCATTER / F.greatest("n_words", F.lit(1)))
    inside = F.col("log_perplexity").between(low - reach, high + reach)
    return out.select("r.*", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tasks = docs.rdd.getNumPartitions()
    docs = docs.coalesce(max(spark.sparkContext.defaultParallelism, tasks // SPLITS))
    with scratch_paths() as steps:
        scored = measured(docs)
    rows = materialize(scored, "quality")
    delete_steps(spark, steps)
    return judged(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


QUERIES = {"op4_quality": op4_quality}
ORACLE: dict[str, str] = {}
