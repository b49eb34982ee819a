"""A corpus from documents to token ids, in stages that are written and read again.

Each stage works on all that the one before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.bpe import round_trip
from voxloom.llm.jaccard import similar
from voxloom.llm.language import ADDED, calibrated, held_out, identify
from voxloom.llm.secrets import masked
from voxloom.llm.winnow import decontaminated
from voxloom.session import delete_path, materialize, scratch_paths, ship_package


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no learned language explains: no letters, or far too high a cross-entropy."""
    ship_package(spark)
    training = docs.where("doc_id is not null and lang is not null").where(~held_out())
    own = {c: f"__own_{c}" for c in docs.columns if c in ADDED}  # the documents' columns stay what they are
    taught = docs.withColumnsRenamed(own).withColumn("__taught", ~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    judged = calibrated(identify(taught, training), "__taught")
    return judged.where("not rejected").select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest number of each group of near copies; documents without a number stay.

    Rows that share a number are judged each by its text.
    """
    ship_package(spark)
    others = similar(docs).where("component_id <> doc_id").select("doc_id", "text_hash").distinct()
    same = F.expr("d.doc_id = o.doc_id and xxhash64(d.text) = o.text_hash")
    return docs.alias("d").join(others.alias("o"), same, "left_anti")


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are contaminated by the benchmark."""
    ship_package(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; the documents stay."""
    return masked(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text."""
    ship_package(spark)
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


_LEFT: dict[str, list[str]] = {}


def _tidy(stage):
    """``stage``, deleting first the step tables of the stage before: its result is written by then."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        for path in _LEFT.pop(app, []):
            delete_path(spark, path)
        with scratch_paths() as paths:
            out = stage(spark, docs, sf_dir)
        _LEFT[app] = paths
        return out

    return run_stage


#: ``docs`` of a stage is a table: what the stage before returned, written and read again.
STAGES = [
    ("language", _tidy(known_language)),
    ("near copies", _tidy(one_of_each)),
    ("benchmark", _tidy(no_benchmark)),
    ("secrets", _tidy(no_secrets)),
    ("token ids", _tidy(token_ids)),
]

#: Language models, and byte pair merges, are beyond SQL. Tests hold near copies, secrets and token ids against
#: brute force; language and benchmark are held on small cases only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
