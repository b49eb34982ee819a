"""Jobs for ``spark-submit``: ``python -m voxloom.jobs <job> --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.config import SUBSET_HOURS, PipelineConfig
from voxloom.operators.schedule import bin_count, bin_members, length_bins
from voxloom.operators.stats import duration_estimate, real_time_factor
from voxloom.plans.serve import build_index, create_batches, export_batches
from voxloom.plans.tokenize import tokenize_corpus
from voxloom.schemas import AUDIO_CELL
from voxloom.session import ship_package
from voxloom.sources.catalogue import catalogue
from voxloom.sources.chunks import CHUNKS
from voxloom.sources.commits import left_over
from voxloom.sources.files import glob_paths
from voxloom.streaming.schedule import read_schedule, write_schedule
from voxloom.streaming.tokenize import tokenize_stream


def corpus_schema(with_speaker: bool) -> T.StructType:
    fields = [T.StructField("text", T.StringType()), T.StructField("audio", AUDIO_CELL)]
    return T.StructType(fields + ([T.StructField("speaker", T.StringType())] if with_speaker else []))


def run_tokenize(spark: SparkSession, args: argparse.Namespace) -> None:
    cfg = PipelineConfig(omit_speaker=args.omit_speaker)
    schema = corpus_schema(args.with_speaker)
    counts = tokenize_corpus(
        spark,
        args.corpus,
        args.out,
        schema,
        cfg,
        division=args.division,
        n_divisions=args.num_divisions,
        retry_quarantine=args.retry_quarantine,
    )
    for split, c in counts.items():
        print(f"{split}: {c}")


def run_stream(spark: SparkSession, args: argparse.Namespace) -> None:
    cfg = PipelineConfig(omit_speaker=args.omit_speaker)
    schema = corpus_schema(args.with_speaker)
    query = tokenize_stream(
        spark, args.corpus, args.out, args.split, schema, cfg, files_per_batch=args.files_per_batch
    )
    query.awaitTermination()


def run_schedule(spark: SparkSession, args: argparse.Namespace) -> None:
    cfg = PipelineConfig(batch_size=args.batch_size, seed=args.seed)
    shuffle = "formula" if args.order == "formula" else True
    train, held_out = create_batches(
        spark, args.tokens, args.epochs, args.replicas, cfg, args.first_epoch, args.rank, args.uneven, args.check, shuffle
    )
    train.write.partitionBy("epoch", "rank").parquet(f"{args.out}/train")
    held_out.write.partitionBy("rank").parquet(f"{args.out}/eval")


def run_endless(spark: SparkSession, args: argparse.Namespace) -> None:
    """Hand out the next batch of places; called again, it goes on."""
    cfg = PipelineConfig(batch_size=args.batch_size, seed=args.seed)
    members, total = f"{args.out}/members", f"{args.out}/bins"
    if not glob_paths(spark, f"{total}/_SUCCESS"):
        index = build_index(spark, args.tokens, args.split, args.check)
        bin_members(length_bins(index.index, cfg)).write.mode("overwrite").parquet(members)
        spark.range(1).select(F.lit(bin_count(index.n_samples, cfg)).alias("n_bins")).write.mode("overwrite").json(total)
    n_bins = spark.read.json(total).first()["n_bins"]
    rows = read_schedule(spark, spark.read.parquet(members), n_bins, args.replicas, cfg, args.bins_per_batch)
    write_schedule(rows, args.out).awaitTermination()


def run_files(spark: SparkSession, args: argparse.Namespace) -> None:
    catalogue(spark, args.tokens, args.split).orderBy("dataset", "path").show(1000, truncate=False)


def run_leftovers(spark: SparkSession, args: argparse.Namespace) -> None:
    for path in left_over(spark, args.tokens, CHUNKS):
        print(path)


def run_export(spark: SparkSession, args: argparse.Namespace) -> None:
    cfg = PipelineConfig(batch_size=args.batch_size)
    export_batches(spark, args.tokens, args.split, args.out, cfg, args.bins_per_file)


def run_estimate(spark: SparkSession, args: argparse.Namespace) -> None:
    hours = [(name, round(h * 3600)) for name, h in SUBSET_HOURS.items()]
    subsets = spark.createDataFrame(hours, "subset string, seconds bigint")
    duration_estimate(subsets).orderBy("subset").show(truncate=False)
    print(f"{real_time_factor():.2f} hours of audio per hour")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="voxloom.jobs")
    jobs = top.add_subparsers(required=True)

    def job(name, run, *needed):
        sub = jobs.add_parser(name)
        for argument in needed:
            sub.add_argument(f"--{argument}", required=True)
        sub.set_defaults(run=run)
        return sub

    def checked(sub):
        sub.add_argument("--full-check", dest="check", action="store_const", const="full", default=True, help="read all arrays before they are indexed")

    for name, run in (("tokenize", run_tokenize), ("stream", run_stream)):
        sub = job(name, run, "corpus", "out")
        sub.add_argument("--with-speaker", action="store_true", help="the corpus has a speaker column")
        sub.add_argument("--omit-speaker", action="store_true", help="leave the speaker out of the text")
        if name == "tokenize":
            sub.add_argument("--division", type=int, help="index of this share of the training files")
            sub.add_argument("--num-divisions", type=int, default=1)
            sub.add_argument("--retry-quarantine", action="store_true", help="try rows again that were set aside")
        else:
            sub.add_argument("--split", default="train")
            sub.add_argument("--files-per-batch", type=int, default=100)
    sub = job("schedule", run_schedule, "tokens", "out")
    for name, default in (("epochs", 1), ("replicas", 1), ("first-epoch", 0), ("batch-size", 8), ("seed", 42)):
        sub.add_argument(f"--{name}", type=int, default=default)
    sub.add_argument("--rank", type=int, help="only this replica's share")
    sub.add_argument("--uneven", default="keep", choices=("keep", "drop"), help="bins that do not divide by the replicas")
    sub.add_argument("--order", default="sort", choices=("sort", "formula"), help="shuffle by sorting, or by the formula of 'endless'")
    checked(sub)
    sub = job("endless", run_endless, "tokens", "out")
    sub.add_argument("--split", default="train")
    for name, default in (("replicas", 1), ("batch-size", 8), ("seed", 42), ("bins-per-batch", 100_000)):
        sub.add_argument(f"--{name}", type=int, default=default)
    checked(sub)
    sub = job("files", run_files, "tokens")
    sub.add_argument("--split")
    job("leftovers", run_leftovers, "tokens")
    sub = job("export", run_export, "tokens", "out")
    sub.add_argument("--split", default="train")
    sub.add_argument("--batch-size", type=int, default=8)
    sub.add_argument("--bins-per-file", type=int, default=512)
    job("estimate", run_estimate)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("voxloom").getOrCreate()
    ship_package(spark)
    args.run(spark, args)


if __name__ == "__main__":
    main()
