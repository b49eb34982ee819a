"""Language identification: one interpolated Kneser-Ney character model per language, least cross-entropy wins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.kneser_ney import Scorer, answers, blocked, train
from voxloom.llm.words import _byte_class
from voxloom.session import materialize

#: Bytes of words for this purpose: ASCII letters, and everything beyond ASCII.
LETTERS = _byte_class(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
ORDER = 4
UNKNOWN = "und"
#: A text is rejected when its cross-entropy is over this many times the 99th percentile of its language's training texts.
REJECT_RATIO = 2.0
#: Evidence of more characters than this does not make a prediction more certain.
FULL_EVIDENCE = 100
ADDED = ("lang_pred", "score", "cross_entropy", "rejected")


def identify(docs: DataFrame, training: DataFrame, order: int = ORDER) -> DataFrame:
    """``docs`` with ``lang_pred, score, cross_entropy, rejected`` added.

    ``training`` has ``text`` and ``lang``; rows with a null in either teach nothing. Null text and text
    without a letter is ``und`` with score 0 and rejected; so is all text when there is nothing to learn
    from. Ties go to the first language by name. Other columns, null keys and repeated rows stay.
    Columns of ``docs`` that are called like an added one are replaced.
    """
    model = train(training.select("text", "lang"), "lang", "text", LETTERS, True, order, modified=False)
    rest = [c for c in docs.columns if c not in ADDED]
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    whole = docs.select(*[F.col(f"`{c}`") for c in rest], lettered.alias("__lettered"))
    blocks = blocked(whole, "text", None, LETTERS, True, False, order)
    root, groups = answers(blocks, model, own=False) if model.groups else "", model.groups

    def run(batches):
        scorer = Scorer(root, len(groups), LETTERS, True, False, order)
        names = np.array([*groups, UNKNOWN], dtype=object)
        for b in batches:
            for part, _, scores, chars in scorer(b, rest.index("text"), len(rest) + 1):
                lettered = part.column(len(rest)).to_numpy(zero_copy_only=False).astype(bool)
                known = lettered & (chars > 0) & (scores.shape[1] > 0)
                if scores.shape[1]:
                    best = np.where(known, scores.argmax(axis=1), len(names) - 1)
                    tempered = scores * np.minimum(1.0, FULL_EVIDENCE / np.maximum(chars, 1))[:, None]
                    tempered = np.exp(tempered - tempered.max(axis=1, keepdims=True))
                    share = np.where(known, tempered.max(axis=1) / tempered.sum(axis=1), 0.0)
                    entropy = -scores.max(axis=1) / np.maximum(chars, 1)
                else:
                    best, share, entropy = np.zeros(chars.size, dtype=int), np.zeros(chars.size), np.zeros(chars.size)
                own = [part.column(i) for i in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(names[best].tolist(), pa.string()), pa.array(share), pa.array(entropy, mask=~known)], names=[*rest, *ADDED[:3]])

    schema = docs.select(*[F.col(f"`{c}`") for c in rest], F.lit("").cast("string").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy")).schema
    for field in schema.fields:
        field.nullable = True
    return blocks.where("__gram is null").select(*whole.columns, "__block").mapInArrow(run, schema)


def calibrated(predicted: DataFrame, taught: str) -> DataFrame:
    """Adds ``rejected``, with a limit for each language from the rows where column ``taught`` is true."""
    limits = predicted.where(F.col(taught)).groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", 0.99, 1000).alias("__limit"))
    out = predicted.join(F.broadcast(limits), "lang_pred", "left")  # a row for each learned language
    over = F.col("cross_entropy") > REJECT_RATIO * F.col("__limit")
    return out.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | F.coalesce(over, F.lit(False))).drop("__limit")


def held_out(key: str = "doc_id"):
    """Documents kept from learning; a null number is none of them, and teaches nothing either."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 3 == 1, F.lit(False))


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    training = docs.where("doc_id is not null and lang is not null").where(~held_out())
    rows = docs.select("doc_id", held_out().alias("held_out"), F.expr("lang is not null and doc_id is not null").alias("taught"), "text")
    predicted = materialize(identify(rows, training).drop("text"), "languages")
    out = calibrated(predicted.withColumn("taught", F.expr("taught and not held_out")), "taught")
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


QUERIES = {"op8_language": op8_language}
ORACLE: dict[str, str] = {}
