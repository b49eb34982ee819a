"""Benchmark contamination by winnowing.

A fingerprint is the smallest hash of ``GRAM`` words among the ``WINDOW - GRAM + 1`` grams of a window;
equal windows have equal fingerprints at equal places, so any window that a document shares with a
benchmark item shows up as a shared fingerprint. Hits are then extended: each window around a hit is
compared with the windows of the items. Items of fewer words than a window are one window of their own
length, looked up wherever their first word occurs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.words import _PLACE_VALUE, ALPHANUMERIC, Words, mix, window_hashes, words_of
from voxloom.session import materialize

WINDOW = 13
GRAM = 5
#: Windows of the benchmark up to which its tables are sent to every task (24 bytes each); beyond, they are joined.
BROADCAST_WINDOWS = 2_000_000
FINGERPRINT = 0  # stands in the column of window lengths
_EMPTY = hashlib.sha256(b"").hexdigest()


def fingerprint_places(grams: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Places of the smallest gram of each window, the last one of equals; ``starts`` are the windows' first words."""
    if not starts.size:
        return starts
    least, place = grams[starts], starts.copy()
    for j in range(1, span):
        other = grams[starts + j]
        take = other <= least
        least, place = np.where(take, other, least), np.where(take, starts + j, place)
    return place[np.r_[True, place[1:] != place[:-1]]]


def _windows_at(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(starts.size, dtype=np.uint64)
    for j in range(size):
        total += hashes[starts + j] * _PLACE_VALUE[j]
    return mix(total + np.uint64(size))


@dataclass
class Table:
    """What is known of the benchmark: fingerprints, and windows by hash with their items."""

    fingerprints: np.ndarray  # sorted
    windows: np.ndarray  # sorted hashes, one entry for each item that has the window
    items: np.ndarray
    short: dict[int, np.ndarray]  # length -> marks, by 16 bits, of first words of short items

    @staticmethod
    def build(rows: pa.Table) -> Table:
        item, value, words, first = (np.array(rows[c].to_numpy()) for c in ("item_id", "hash", "words", "first"))
        value, first = value.view(np.uint64), first.view(np.uint64)
        whole = words != FINGERPRINT
        order = np.argsort(value[whole], kind="stable")
        short = {}
        for n in sorted(set(words[whole & (words < WINDOW)].tolist())):
            short[n] = np.zeros(1 << 16, dtype=bool)
            short[n][(first[words == n] & np.uint64(0xFFFF)).astype(np.int64)] = True
        return Table(np.unique(value[~whole]), value[whole][order], item[whole][order], short)


def _in(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not sorted_.size:
        return np.zeros(values.size, dtype=bool)
    at = np.searchsorted(sorted_, values)
    return sorted_[np.minimum(at, sorted_.size - 1)] == values


def _candidates(w: Words, hashes: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    """First words of the windows that hold a shared fingerprint."""
    starts = w.window_starts(WINDOW)
    span = WINDOW - GRAM + 1
    grams = window_hashes(hashes, GRAM)
    places = fingerprint_places(grams, starts, span)
    hits = places[_in(grams[places], fingerprints)]
    if not hits.size:
        return hits
    around = np.unique((hits[:, None] - np.arange(span)).ravel())
    return around[_in(around, starts)]


def _own_rows(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """All windows and fingerprints of benchmark items: row, hash, length or FINGERPRINT, hash of the first word."""
    starts, places = w.window_starts(WINDOW), None
    grams = window_hashes(hashes, GRAM)
    places = fingerprint_places(grams, starts, WINDOW - GRAM + 1)
    row = w.row_of_word
    out = [(row[starts], _windows_at(hashes, starts, WINDOW), np.full(starts.size, WINDOW), hashes[starts])]
    out.append((row[places], grams[places], np.full(places.size, FINGERPRINT), hashes[places]))
    for n in range(1, WINDOW):
        at = w.first[:-1][w.counts == n]
        out.append((row[at], _windows_at(hashes, at, n), np.full(at.size, n), hashes[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def benchmark_table(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, hash, words, first``: every distinct window and fingerprint of the items. Items without a number are left out."""
    schema = pa.schema([("item_id", pa.int64()), ("hash", pa.int64()), ("words", pa.int32()), ("first", pa.int64())])

    def run(batches):
        for b in batches:
            ids = np.array(b.column(0), dtype=np.int64)
            for w in words_of(b.column(1), ALPHANUMERIC):
                row, value, words, first = _own_rows(w, w.hashes(lower=True))
                own = ids[w.rows.start : w.rows.stop][row]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(value.view(np.int64)), pa.array(words, pa.int32()), pa.array(first.view(np.int64))], schema=schema)

    items = benchmark.select(F.col(f"`{item}`").cast("long").alias("item_id"), F.col(f"`{text}`").alias("text"))
    items = items.where("item_id is not null and text is not null")
    return items.mapInArrow(run, "item_id long, hash long, words int, first long").distinct()


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def _found(w: Words, hashes: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that items have: first word, length, and place in the table's windows."""
    out = []
    candidates = [(WINDOW, _candidates(w, hashes, table.fingerprints))]
    for n, marks in table.short.items():
        starts = w.window_starts(n)
        candidates.append((n, starts[marks[(hashes[starts] & np.uint64(0xFFFF)).astype(np.int64)]]))
    for n, starts in candidates:
        value = _windows_at(hashes, starts, n)
        lo, hi = np.searchsorted(table.windows, value, "left"), np.searchsorted(table.windows, value, "right")
        n_items = hi - lo
        at = np.arange(int(n_items.sum())) + np.repeat(lo - (np.cumsum(n_items) - n_items), n_items)
        out.append((np.repeat(starts, n_items), np.full(at.size, n), at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _covered(w: Words, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words of each text inside any of the windows."""
    edge = np.zeros(w.starts.size + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + sizes, -1)
    inside = np.r_[0, np.cumsum(np.cumsum(edge)[:-1] > 0)]
    return inside[w.first[1:]] - inside[w.first[:-1]]


_RESULT = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"}


def _by_table(docs: DataFrame, rows: DataFrame, carried: list[str], mark: str = "") -> DataFrame:
    """The columns ``carried``, and the result's, whose names begin with ``mark``."""
    n = len(carried)
    table = docs.sparkSession.sparkContext.broadcast(Table.build(rows.toArrow()))

    def run(batches):
        for b in batches:
            known = table.value
            for w in words_of(b.column(n), ALPHANUMERIC):
                hashes = w.hashes(lower=True)
                starts, sizes, at = _found(w, hashes, known)
                n_hit = _covered(w, starts, sizes)
                n_items, digest = np.zeros(len(w.rows), dtype=np.int64), [_EMPTY] * len(w.rows)
                row = w.row_of_word[starts]
                for r in np.unique(row).tolist():
                    own = np.unique(known.items[at[row == r]]).tolist()
                    n_items[r], digest[r] = len(own), _digest(own)
                flagged = (n_hit > 0) & (20 * n_hit >= w.counts)
                own = [b.column(i).slice(w.rows.start, len(w.rows)) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(w.counts), pa.array(n_hit), pa.array(n_items), pa.array(digest, pa.string()), pa.array(flagged)],
                    names=[*carried, *[mark + c for c in _RESULT]],
                )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select(*[F.col(f"`{c}`") for c in carried], F.col("text").alias("__text")).mapInArrow(run, f"{kinds}, {', '.join(f'{mark}{c} {t}' for c, t in _RESULT.items())}")


def _by_join(docs: DataFrame, rows: DataFrame, keep_hash: bool = False) -> DataFrame:
    """The same where the benchmark is too large for every task: fingerprints and windows meet in joins."""
    lengths = sorted(r.words for r in rows.where(f"words between 1 and {WINDOW - 1}").select("words").distinct().collect())
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    key = ["doc_id", "text_hash"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def grams(batches):
        for b in batches:
            for w in words_of(b.column(1), ALPHANUMERIC):
                hashes = w.hashes(lower=True)
                all_ = window_hashes(hashes, GRAM)
                places = fingerprint_places(all_, w.window_starts(WINDOW), WINDOW - GRAM + 1)
                row = pa.array(w.row_of_word[places] + w.rows.start)
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(2).take(row), pa.array(all_[places].view(np.int64))], names=[*key, "hash"])

    shared = rows.where(f"words = {FINGERPRINT}").select("hash").distinct()
    hits = docs.mapInArrow(grams, f"doc_id {kind}, text_hash long, hash long").distinct().join(shared, "hash", "left_semi")
    hits = hits.groupBy(*key).agg(F.collect_set("hash").alias("hashes"))
    same = docs.alias("d").join(hits.alias("h"), F.expr("d.doc_id <=> h.doc_id and d.text_hash = h.text_hash"), "left").select("d.doc_id", "d.text", "d.text_hash", "h.hashes")

    def windows(batches):
        for b in batches:
            for w in words_of(b.column(1), ALPHANUMERIC):
                hashes, own = w.hashes(lower=True), b.column(3).slice(w.rows.start, len(w.rows))
                known = np.unique(own.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                parts = [(WINDOW, _candidates(w, hashes, known))] + [(n, w.window_starts(n)) for n in lengths]
                starts, sizes = np.concatenate([s for _, s in parts]), np.repeat([n for n, _ in parts], [s.size for _, s in parts])
                value = np.concatenate([_windows_at(hashes, s, n) for n, s in parts])
                row = w.row_of_word[starts]
                at = pa.array(row + w.rows.start)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(starts - w.first[row]), pa.array(sizes, pa.int32()), pa.array(value.view(np.int64))], names=[*key, "start", "words", "hash"])

    found = same.mapInArrow(windows, f"doc_id {kind}, text_hash long, start long, words int, hash long").distinct()
    found = found.join(rows.where("words > 0").select("item_id", "hash", "words"), ["hash", "words"])
    per_doc = found.groupBy(*key).agg(F.collect_set("item_id").alias("items"), F.collect_set(F.struct("start", "words")).alias("runs"))
    per_doc = per_doc.select(
        *key,
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        F.expr("aggregate(array_sort(runs), named_struct('n', 0L, 'end', 0L), (a, r) -> named_struct('n', a.n + greatest(r.start + r.words - greatest(r.start, a.end), 0L), 'end', greatest(a.end, r.start + r.words)), a -> a.n)").alias("n_hit"),
    )

    def counts(batches):
        for b in batches:
            for w in words_of(b.column(1), ALPHANUMERIC):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.rows.start, len(w.rows)), b.column(2).slice(w.rows.start, len(w.rows)), pa.array(w.counts)], names=[*key, "n_words"])

    sizes = docs.mapInArrow(counts, f"doc_id {kind}, text_hash long, n_words long").alias("d")
    out = sizes.join(per_doc.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.text_hash = f.text_hash"), "left")
    n_hit, n_words = F.coalesce("n_hit", F.lit(0)), F.col("n_words")
    return out.select(
        "d.doc_id", *(["d.text_hash"] if keep_hash else []), n_words, n_hit.cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(_EMPTY)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Null and empty texts have no words and no hits. Rows that repeat are judged each for itself; other
    columns are not read. The benchmark's tables go to every task when they hold at most ``most`` rows,
    else everything is joined; the result is the same.
    """
    rows = materialize(benchmark_table(benchmark), "benchmark-windows")
    return _by_table(docs, rows, ["doc_id"]) if rows.count() <= most else _by_join(docs.select("doc_id", "text"), rows)


def decontaminated(docs: DataFrame, benchmark: DataFrame, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, whatever their names."""
    rows = materialize(benchmark_table(benchmark), "benchmark-windows")
    if rows.count() <= most:
        return _by_table(docs, rows, docs.columns, "__winnow_").where("not __winnow_contaminated").select(*[F.col(f"`{c}`") for c in docs.columns])
    bad = _by_join(docs.select("doc_id", "text"), rows, keep_hash=True).where("contaminated").select("doc_id", "text_hash").distinct()
    both = F.expr("d.doc_id <=> b.doc_id and xxhash64(d.text) = b.text_hash")
    return docs.alias("d").join(bad.alias("b"), both, "left_anti")


def op7_winnow(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERIES = {"op7_winnow": op7_winnow}
ORACLE = {
    "op7_winnow": f"""
with d as materialized (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as materialized (select item_id, {_WORDS} as w from benchmark where item_id is not null and text is not null),
bw as materialized (
  select distinct item_id, n, array_to_string(w[s : s + n - 1], ' ') as k
  from (select item_id, w, least(len(w), {WINDOW}) as n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) as s from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (
  select r, n, s, array_to_string(w[s : s + n - 1], ' ') as k
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n)),
hit as materialized (select r, dw.n, s, item_id from dw join bw on dw.k = bw.k and dw.n = bw.n),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from (select distinct r, s, n from hit)) group by r),
items as (
  select r, count(*) as n_items, sha256(string_agg(i, ',' order by i)) as items_sha256
  from (select distinct r, item_id::varchar as i from hit) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (r) left join items using (r)
"""
}
