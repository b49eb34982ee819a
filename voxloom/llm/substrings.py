"""Repeated word sequences across documents, found in full-text indexes, one per shard.

Every window of ``WINDOW`` words is named by the smallest hash among its grams of ``GRAM`` words, so
equal windows have equal names. Only names that two documents have can belong to a shared window; a
filter of bounded size tells them from the rest (a name let through by chance costs time, nothing
else). Stretches of windows with one name go to the shard of the name. Each shard indexes its distinct
stretches, streams them through backward search, and reports for every window the smallest document
that has it. Windows of very common names are sent one by one, to the shard of the whole window, so
that no name fills a shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.fmindex import FMIndex
from voxloom.llm.winnow import _windows_at
from voxloom.llm.words import Words, mix, window_hashes, words_of
from voxloom.session import materialize

WINDOW = 13
GRAM = 5
#: The filter has 2^FILTER_BITS bits (32 MB), whatever the corpus.
FILTER_BITS = 28
#: A name in more than one of so many documents is common (and in at least that many).
COMMON = 1000
#: Names a task counts together before they are sent, and words of a shard's index.
GATHER = 1_000_000
SHARD_WORDS = 200_000


def _named(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one name: first word, number of windows, name."""
    starts = w.window_starts(WINDOW)
    if not starts.size:
        return starts, starts, np.zeros(0, dtype=np.uint64)
    grams = window_hashes(hashes, GRAM)
    least, place = grams[starts], starts.copy()
    for j in range(1, WINDOW - GRAM + 1):
        other = grams[starts + j]
        take = other <= least
        least, place = np.where(take, other, least), np.where(take, starts + j, place)
    row = np.searchsorted(w.first, starts, "right")
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    return starts[new], np.diff(np.r_[new, starts.size]), least[new]


def _slot(names: np.ndarray) -> np.ndarray:
    return mix(names) >> np.uint64(64 - FILTER_BITS)


def name_counts(docs: DataFrame) -> DataFrame:
    """``name, docs`` for the names that several documents have (``docs`` counts rows, and may count one twice)."""

    def run(batches):
        held, size = [], 0

        def flush():
            names, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, names))
            names, ids = names[order], ids[order]
            first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
            last = np.r_[first[1:], names.size] - 1
            new = np.r_[True, (names[1:] != names[:-1]) | (ids[1:] != ids[:-1])]
            n = np.add.reduceat(new.astype(np.int64), first)
            return pa.RecordBatch.from_arrays([pa.array(names[first].view(np.int64)), pa.array(ids[first]), pa.array(ids[last]), pa.array(n)], names=["name", "lo", "hi", "n"])

        for b in batches:
            ids = b.column(0).to_numpy()
            for w in words_of(b.column(1)):
                first, _, names = _named(w, w.hashes())
                if names.size:
                    held.append((names, ids[w.rows.start : w.rows.stop][w.row_of_word[first]]))
                    size += names.size
                    if size > GATHER:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    rows = docs.mapInArrow(run, "name long, lo long, hi long, n long")
    totals = rows.groupBy("name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("docs"))
    return totals.where("lo < hi").select("name", "docs")


def _filter(names: DataFrame) -> np.ndarray:
    """The bits of the filter, put together by Spark as 64-bit words."""

    def run(batches):
        for b in batches:
            slot = _slot(b.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    rows = names.select("name").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _stretches(w: Words, hashes: np.ndarray, bits: np.ndarray, common: np.ndarray):
    """What goes to shards: first word, number of windows, shard key, hash of the words."""
    first, n, names = _named(w, hashes)
    slot = _slot(names)
    may = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    first, n, names = first[may], n[may], names[may]
    at = np.minimum(np.searchsorted(common, names), max(0, common.size - 1))
    hot = common[at] == names if common.size else np.zeros(names.size, dtype=bool)
    if hot.any():  # window by window
        k = n[hot]
        each = np.arange(int(k.sum())) + np.repeat(first[hot] - (np.cumsum(k) - k), k)
        first, n = np.r_[first[~hot], each], np.r_[n[~hot], np.ones(each.size, dtype=n.dtype)]
        names = np.r_[names[~hot], _windows_at(hashes, each, WINDOW)]
    # hashes of words laid out by their places give one for any stretch
    total = np.zeros(first.size, dtype=np.uint64)
    for size in np.unique(n).tolist():
        own = n == size
        total[own] = _windows_at(hashes, first[own], int(size) + WINDOW - 1)
    return first, n, names, total


def shard_rows(docs: DataFrame, bits, common) -> DataFrame:
    """``shard, stretch, doc_id, words``: each distinct stretch once per few thousand documents, with its smallest document."""

    def run(batches):
        seen: dict[int, int] = {}
        for b in batches:
            ids = b.column(0).to_numpy()
            for w in words_of(b.column(1)):
                first, n, names, total = _stretches(w, w.hashes(), bits.value, common.value)
                if not first.size:
                    continue
                own = ids[w.rows.start : w.rows.stop][w.row_of_word[first]]
                order = np.lexsort((own, total))
                order = order[np.r_[True, total[order][1:] != total[order][:-1]]]
                keep = [k for k, t, d in zip(order.tolist(), total[order].tolist(), own[order].tolist(), strict=True) if seen.get(t, d + 1) > d]
                if len(seen) > GATHER:
                    seen.clear()
                seen.update(zip(total[keep].tolist(), own[keep].tolist(), strict=True))
                raw = w.data.tobytes()
                spans = [raw[s:e] for s, e in zip(w.starts[first[keep]].tolist(), w.ends[first[keep] + n[keep] + WINDOW - 2].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[keep].view(np.int64)), pa.array(total[keep].view(np.int64)), pa.array(own[keep]), pa.array(spans, pa.binary()).cast(pa.string())],
                    names=["shard", "stretch", "doc_id", "words"],
                )

    return docs.mapInArrow(run, "shard long, stretch long, doc_id long, words string")


def least_documents(rows: DataFrame) -> DataFrame:
    """``stretch, least``: for every distinct stretch the smallest document of each of its windows.

    A shard is a run of keys, whole ones, of about ``SHARD_WORDS`` words; it is indexed, searched and dropped.
    """
    spread = rows.repartition("shard").sortWithinPartitions("shard", "stretch", "doc_id")

    def solve(stretch: np.ndarray, docs: np.ndarray, words: pa.Array):
        new = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]])  # the smallest document comes first
        stretch, docs, words = stretch[new], docs[new], words.take(pa.array(new))
        parts = [(w.hashes(), w.counts) for w in words_of(words)]
        hashes, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        index = FMIndex(hashes, sizes, docs)
        k = sizes - WINDOW + 1
        stop = np.cumsum(sizes)
        ends = np.arange(int(k.sum())) + np.repeat(stop - sizes + WINDOW - 1 - (np.cumsum(k) - k), k)
        length, lo, hi = index.matching(hashes, ends, WINDOW)
        if (length < WINDOW).any():
            raise ValueError("a window is missing from its own shard")
        least = index.least_owner(lo, hi)
        return pa.RecordBatch.from_arrays([pa.array(stretch), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(k)], pa.int32()), pa.array(least))], names=["stretch", "least"])

    def run(batches):
        held: list[tuple] = []
        size = 0
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                keys = part.column(0).to_numpy()
                if size > SHARD_WORDS:  # end the shard where the key changes
                    edge = int(np.searchsorted(keys, held[-1][0][-1], "right"))
                    held.append((keys[:edge], part.column(1).to_numpy()[:edge], part.column(2).to_numpy()[:edge], part.column(3).slice(0, edge)))
                    if edge == part.num_rows:
                        continue
                    yield solve(*(np.concatenate([h[i] for h in held]) for i in (1, 2)), pa.concat_arrays([h[3] for h in held]))
                    held, size = [], 0
                    part, keys = part.slice(edge), keys[edge:]
                held.append((keys, part.column(1).to_numpy(), part.column(2).to_numpy(), part.column(3)))
                size += part.num_rows * 18
        if held:
            yield solve(*(np.concatenate([h[i] for h in held]) for i in (1, 2)), pa.concat_arrays([h[3] for h in held]))

    return spread.mapInArrow(run, "stretch long, least array<long>")


def occurrences(docs: DataFrame, bits, common) -> DataFrame:
    """``row, doc_id, start, stretch`` of every stretch of every document."""

    def run(batches):
        for b in batches:
            ids, keys = b.column(0).to_numpy(), b.column(2).to_numpy()
            for w in words_of(b.column(1)):
                first, _, _, total = _stretches(w, w.hashes(), bits.value, common.value)
                row = w.row_of_word[first]
                own = slice(w.rows.start, w.rows.stop)
                yield pa.RecordBatch.from_arrays([pa.array(keys[own][row]), pa.array(ids[own][row]), pa.array(first - w.first[row], pa.int32()), pa.array(total.view(np.int64))], names=["row", "doc_id", "start", "stretch"])

    return docs.mapInArrow(run, "row long, doc_id long, start int, stretch long")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` for each row; ``kept`` is the text that is left, words joined by one space.

    A word goes when a window around it also starts in a document with a smaller number. Null texts have
    no words. Rows without a number keep everything and take nothing from others; rows that repeat a
    number are compared with smaller numbers only. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    told = docs.where("doc_id is not null and text is not null")
    names = materialize(name_counts(told.select("doc_id", "text")), "shared-names")
    n_docs = docs.count()
    common = names.where(F.col("docs") > max(COMMON, n_docs // COMMON)).select("name").toArrow()["name"].to_numpy()
    bits = spark.sparkContext.broadcast(_filter(names))
    hot = spark.sparkContext.broadcast(np.sort(common.view(np.uint64)))
    least = materialize(least_documents(shard_rows(told, bits, hot)), "least-documents")
    # only windows that have another document in front can make anyone lose words
    found = occurrences(told, bits, hot).join(least, "stretch")
    starts = F.filter(F.transform("least", lambda m, i: F.when(m < F.col("doc_id"), F.col("start") + i)), lambda s: s.isNotNull())
    gone = found.select("row", starts.alias("starts")).where(F.size("starts") > 0)
    gone = gone.groupBy("row").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    def run(batches):
        for b in batches:
            for w in words_of(b.column(1)):
                at = b.column(2).slice(w.rows.start, len(w.rows))
                edge = np.zeros(w.starts.size + 1, dtype=np.int64)
                counts = np.array([len(x) if x is not None else 0 for x in at.to_pylist()], dtype=np.int64) if at.null_count < len(at) else np.zeros(len(at), dtype=np.int64)
                if counts.any():
                    first = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(w.first[:-1], counts)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + WINDOW, -1)
                removed = np.cumsum(edge)[:-1] > 0
                n_removed = np.diff(np.r_[0, np.cumsum(removed)][w.first])
                raw, kept = w.data.tobytes(), []
                for s, e, a, z, k in zip(w.byte_edges[:-1].tolist(), w.byte_edges[1:].tolist(), w.first[:-1].tolist(), w.first[1:].tolist(), n_removed.tolist(), strict=True):
                    words = raw[s:e].split()
                    if k:
                        words = [x for x, gone in zip(words, removed[a:z].tolist(), strict=True) if not gone]
                    kept.append(b" ".join(words))
                digest = [hashlib.sha256(k).hexdigest() for k in kept]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(w.rows.start, len(w.rows)), pa.array(w.counts), pa.array(n_removed), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    rows = docs.join(gone, "row", "left").select("doc_id", "text", "starts")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


QUERIES = {"op3_substrings": op3_substrings}
ORACLE = {
    "op3_substrings": rf"""
with d as materialized (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
k as materialized (
  select r, doc_id, p, array_to_string(w[p : p + {WINDOW - 1}], ' ') as g
  from (select r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as p from d where len(w) >= {WINDOW})),
m as (select g, min(doc_id) as least from k group by g),
x as (select distinct r, unnest(range(p, p + {WINDOW})) as p from k join m on k.g = m.g where least < doc_id),
e as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
l as (
  select e.r, string_agg(word, ' ' order by e.p) filter (x.p is null) as kept, count(x.p) as n_removed
  from e left join x on x.r = e.r and x.p = e.p group by e.r)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join l using (r)
"""
}
