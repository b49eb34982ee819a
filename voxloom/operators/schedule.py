"""Length-sorted batches, their shuffled order per epoch, and their share per replica."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.config import DEFAULT, PipelineConfig
from voxloom.functions.arrays import int_div
from voxloom.functions.ordering import key_cell, shuffle_key
from voxloom.operators.permutation import permuted
from voxloom.operators.position import cell_counts, dense_position, position_by_number


def length_bins(index: DataFrame, cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """``(bin, slot_in_bin, idx, length)``: samples by length, ties by ``idx``, cut every batch.

    The last bin may be short. Rows are ranked in cells of one length and one block of sample
    numbers, so a length that a third of the corpus shares still spreads over many tasks.
    """
    ranked = position_by_number(
        index.select("idx", "length"),
        "length",
        "idx",
        "length_rank",
        block=cfg.position_block,
    )
    return ranked.select(
        int_div(F.col("length_rank"), cfg.batch_size).alias("bin"),
        (F.col("length_rank") % cfg.batch_size).cast("int").alias("slot_in_bin"),
        "idx",
        "length",
    )


def bin_count(n_samples: int, cfg: PipelineConfig = DEFAULT) -> int:
    """Number of batches for a number of samples."""
    return -(-n_samples // cfg.batch_size)


def bin_members(bins: DataFrame) -> DataFrame:
    """One row per bin with its samples in order; a group never exceeds the batch size."""
    members = F.sort_array(F.collect_list(F.struct("slot_in_bin", "idx", "length")))
    return bins.groupBy("bin").agg(members.alias("members"))


def bin_stats(bins: DataFrame) -> DataFrame:
    """Size, shortest and longest sample of every bin, and the padding a batch needs."""
    stats = bins.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.sum("length").cast("bigint").alias("used_frames"),
    )
    pad = F.col("n_samples") * F.col("max_length") - F.col("used_frames")
    return stats.withColumn("pad_frames", pad.cast("bigint"))


def over_epochs(bins: DataFrame, n_epochs: int, first: int = 0) -> DataFrame:
    """Every row once per epoch, without a join. Order is a pure function of the epoch number, so
    an endless schedule is one that is asked for epoch after epoch."""
    if n_epochs <= 0:
        return bins.withColumn("epoch", F.lit(first)).where(F.lit(False))
    epochs = F.sequence(F.lit(first), F.lit(first + n_epochs - 1))
    return bins.withColumn("epoch", F.explode(epochs))


def _bin_key(seed: int) -> Column:
    return shuffle_key(seed, F.col("epoch"), F.col("bin"))


def shuffle_bins(
    bins: DataFrame, n_bins: int, n_epochs: int, cfg: PipelineConfig = DEFAULT, first: int = 0
) -> DataFrame:
    """Add ``epoch`` and ``pos``, the place of each bin in the shuffled order of that epoch.

    Bins are numbered 0 .. n_bins-1, so the counts the position needs come from the numbers alone
    and the table of bins is read once. Digests spread evenly: no cell can be hot.
    """

    def keyed(df: DataFrame) -> DataFrame:
        with_key = over_epochs(df, n_epochs, first).withColumn("__key", _bin_key(cfg.seed))
        return with_key.withColumn("__cell", key_cell(F.col("__key")))

    numbers = keyed(bins.sparkSession.range(n_bins).withColumnRenamed("id", "bin"))
    counts = cell_counts(numbers, ["__cell"], ["epoch"])
    placed = dense_position(keyed(bins), ["__cell"], ["__key", "bin"], "pos", ["epoch"], counts)
    return placed.drop("__key", "__cell")


def permute_bins(
    bins: DataFrame, n_bins: int, n_epochs: int, cfg: PipelineConfig = DEFAULT, first: int = 0
) -> DataFrame:
    """Add ``epoch`` and ``pos`` like ``shuffle_bins``, by a formula (``operators.permutation``): no exchange
    and no count, and ``bin_at`` gives the bin of any place without the others."""
    return permuted(over_epochs(bins, n_epochs, first), "bin", n_bins, cfg.seed, "pos")


def bin_at(places: DataFrame, n_bins: int, cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """Add ``bin`` to rows of ``epoch`` and ``pos``: the inverse of ``permute_bins``."""
    return permuted(places, "pos", n_bins, cfg.seed, "bin", back=True)


def keep_bin_order(bins: DataFrame) -> DataFrame:
    """Evaluation order: one epoch, bins from short to long."""
    return bins.withColumn("epoch", F.lit(0)).withColumn("pos", F.col("bin"))


def shuffle_members(seed: int) -> Column:
    """The ``members`` of a bin in the shuffled order of the row's epoch; needs no shuffle of rows."""
    keyed = F.transform(
        "members",
        lambda m: F.struct(
            shuffle_key(seed, F.col("epoch"), m["idx"]).alias("key"),
            m["idx"].alias("idx"),
            m["length"].alias("length"),
        ),
    )
    return F.sort_array(keyed)


def rank_of(pos: Column, n_replicas: int) -> Column:
    """Replica that takes the bin at ``pos``: bins are dealt out one by one."""
    return (pos % n_replicas).cast("int")


def drop_uneven(placed: DataFrame, n_bins: int, n_replicas: int) -> DataFrame:
    """Leave out the last bins of an epoch that would give some replicas one bin more."""
    return placed.where(F.col("pos") < n_bins // n_replicas * n_replicas)


def bins_per_rank(placed: DataFrame, n_bins: int, n_replicas: int) -> DataFrame:
    """Bins each replica gets in an epoch, next to the number a trainer plans with."""
    actual = placed.groupBy("epoch", "rank").agg(F.count(F.lit(1)).alias("actual_bins"))
    return actual.withColumn("planned_bins", F.lit(n_bins // n_replicas).cast("bigint"))


def step_plan(per_rank: DataFrame, n_epochs: int, n_replicas: int, cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """Steps of a whole run per replica, and samples per optimiser step."""
    steps = per_rank.groupBy("rank").agg(
        F.sum("actual_bins").cast("bigint").alias("actual_steps"), F.max("planned_bins").alias("planned")
    )
    effective = cfg.batch_size * cfg.grad_acc_steps * n_replicas
    return steps.select(
        "rank",
        "actual_steps",
        (F.col("planned") * n_epochs).cast("bigint").alias("planned_steps"),
        F.lit(effective).cast("bigint").alias("effective_batch"),
    )


def schedule(
    bins: DataFrame,
    n_bins: int,
    n_epochs: int,
    n_replicas: int = 1,
    cfg: PipelineConfig = DEFAULT,
    shuffle: bool | str = True,
    uneven: str = "keep",
    first: int = 0,
) -> DataFrame:
    """``(epoch, rank, pos, bin, slot_in_bin, idx, length)`` for all epochs and replicas at once.

    Sample order inside a bin is settled on the array of its members; only one row per bin and
    epoch is ever shuffled, and with ``shuffle="formula"`` not even that one: places are computed.
    """
    if uneven not in ("keep", "drop"):
        raise ValueError("uneven must be 'keep' or 'drop'")
    if shuffle not in (True, False, "formula"):
        raise ValueError("shuffle must be True, False or 'formula'")
    members = bin_members(bins)
    if shuffle == "formula":
        placed, order = permute_bins(members, n_bins, n_epochs, cfg, first), shuffle_members(cfg.seed)
    elif shuffle:
        placed, order = shuffle_bins(members, n_bins, n_epochs, cfg, first), shuffle_members(cfg.seed)
    else:
        placed, order = keep_bin_order(members), F.col("members")
    if uneven == "drop":
        placed = drop_uneven(placed, n_bins, n_replicas)
    return in_order(placed, order, n_replicas)


def in_order(placed: DataFrame, order: Column, n_replicas: int) -> DataFrame:
    """A row per sample from bins with ``epoch``, ``pos`` and members; ``order`` gives the members' order."""
    return placed.select(
        "epoch",
        rank_of(F.col("pos"), n_replicas).alias("rank"),
        "pos",
        "bin",
        F.posexplode(order).alias("slot_in_bin", "m"),
    ).select("epoch", "rank", "pos", "bin", "slot_in_bin", "m.idx", "m.length")


def attach_samples(bins: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples next to their place in a batch; one shuffle of the samples, on a unique key."""
    return bins.select("bin", "slot_in_bin", "idx").join(samples, "idx")


def validation_or_test(validation: DataFrame, test: DataFrame) -> DataFrame:
    """The validation samples, or the test samples when there is no validation sample at all."""
    return validation.unionByName(test.where(~validation.exists()))
