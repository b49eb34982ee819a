"""Repeated byte strings across and within documents, by a distributed merge sort of suffixes.

A suffix is sorted where it can matter. Every string of ``length`` bytes is known by an anchor: the gram
in it with the least hash. Equal strings have their anchors at the same offset, so only anchors whose gram
occurs again can belong to a repeated string, and text around other anchors is never moved. Each block of
documents sorts what follows its anchors, and, backwards, what comes before them, and sends both as
front-coded runs to the shard of the gram. A shard merges the runs with loser trees that never compare a
known prefix again; the shared prefixes of neighbours say which strings are equal on either side of the
anchor, and the string that starts ``d`` bytes before an anchor is repeated when another one is equal on
both sides.

A gram that meets too many different texts (a line that a third of the documents have) is cut up: its
strings are known by themselves, and those that occur again are sorted whole. Texts are not shuffled; blocks
lie in the shared folder and are opened beside what came back for them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.blocks import by_keys, load_block, new_block, save_block
from voxloom.llm.losertree import front_code, front_decode, merge
from voxloom.llm.words import byte_sums, mix, stretch_hashes, text_bytes
from voxloom.session import materialize, new_scratch

LENGTH = 400
GRAM = 48
#: Bytes of a block, and positions that are hashed at once.
BLOCK = 8 << 20
STEP = 1 << 19
#: Different texts around one gram, of all blocks together, up to which they are merged in one shard.
HOT = 4096
#: Texts that a shard merges, on average.
SHARD = 8192
#: Tasks of a step, however many blocks or shards there are.
MOST_TASKS = 10_000
_PLACE = np.uint64((1 << 20) - 1)
#: What a row that goes to a block is about: a stretch (by its gram or its entry), a string known by its
#: hash, or a gram whose stretches are cut up into strings.
STRETCH, STRING, CUT_UP = 0, 1, 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n = values.size - width + 1
    rows = -(-values.size // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: values.size] = values
    grid = padded.reshape(rows, width)
    up = np.minimum.accumulate(grid, axis=1).ravel()
    down = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def anchored(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Stretches of strings with one anchor: first start, number of strings, anchor, and hashes of gram and text.

    The anchor is the first of the least grams, so it depends on the bytes of the string alone.
    """
    found: dict[str, list] = {k: [] for k in ("first", "n", "anchor", "name", "text")}
    inside = np.zeros(data.size + 1, dtype=np.int8)  # a string may start here
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    starts_here = np.cumsum(inside, dtype=np.int8)[:-1] > 0
    for c in range(0, max(0, data.size - length + 1), STEP):
        part = data[c : c + STEP + length - 1]
        n = part.size - length + 1
        ok = starts_here[c : c + n]
        if not ok.any():
            continue
        sums = byte_sums(part)
        at = np.arange(part.size - gram + 1)
        grams = stretch_hashes(sums, at, at + gram)
        place = (_least((grams & ~_PLACE) | at.astype(np.uint64), length - gram + 1) & _PLACE).astype(np.int64)
        begin = np.ones(n, dtype=bool)
        begin[1:] = (place[1:] != place[:-1]) | ~ok[:-1]
        first = np.flatnonzero(begin & ok)
        run = np.cumsum(begin & ok) - 1
        count = np.bincount(run[ok], minlength=first.size)
        found["first"].append(first + c)
        found["n"].append(count)
        found["anchor"].append(place[first] + c)
        found["name"].append(mix(grams[place[first]]))
        found["text"].append(stretch_hashes(sums, first, first + count - 1 + length) + (place[first] - first).astype(np.uint64))
    kinds = {"name": np.uint64, "text": np.uint64}
    return {k: np.concatenate(v) if v else np.zeros(0, dtype=kinds.get(k, np.int64)) for k, v in found.items()}


def string_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64 bits for the string at each of the (ascending) starts."""
    out = np.zeros(starts.size, dtype=np.uint64)
    edges = np.searchsorted(starts, np.arange(0, data.size + STEP, STEP))
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if b > a:
            c = k * STEP
            own = starts[a:b] - c
            out[a:b] = mix(stretch_hashes(byte_sums(data[c : c + STEP + length - 1]), own, own + length) + np.uint64(length))
    return out


def _many(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first, first + 1, ..`` of ``n`` numbers for every row."""
    stop = np.cumsum(n)
    return np.arange(int(stop[-1]) if n.size else 0) + np.repeat(first - (stop - n), n)


def _starts_at(grams: np.ndarray, name: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All starts in the stretches of the grams, in order."""
    own = np.flatnonzero(np.isin(name, grams))
    return _many(first[own], n[own].astype(np.int64))


def _kept_blocks(folder: str, length: int, gram: int):
    """Texts into blocks in the folder; rows name the grams of each block's anchors."""
    schema = pa.schema([("block", pa.int64()), ("name", pa.int64()), ("copies", pa.int64()), ("kinds", pa.int64())])

    def flush(keys: list[pa.Array], parts: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        data = np.concatenate(parts)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        ids = pa.concat_arrays(keys)
        s = anchored(data, offsets, length, gram)
        both = np.stack([s["name"], s["text"]], axis=1)
        entries, first_of, entry = np.unique(both, axis=0, return_index=True, return_inverse=True)
        block = new_block()
        save_block(
            folder, block, data=data, offsets=offsets, key=np.array(ids.fill_null(0)), known=np.array(ids.is_valid()).astype(np.uint8),
            first=s["first"], n=s["n"].astype(np.int32), anchor=s["anchor"], name=s["name"].view(np.int64), entry=entry.ravel().astype(np.int32),
        )
        names, at, copies = np.unique(s["name"], return_inverse=True, return_counts=True)
        kinds = np.bincount(np.searchsorted(names, entries[:, 0]), minlength=names.size) if names.size else np.zeros(0, dtype=np.int64)
        own = [pa.array(np.full(names.size + 1, block)), pa.array(np.append(names.view(np.int64), 0), mask=np.arange(names.size + 1) == names.size)]
        return pa.RecordBatch.from_arrays([*own, pa.array(np.append(copies, 0)), pa.array(np.append(kinds, 0))], schema=schema)

    def run(batches):
        keys, parts, sizes, total = [], [], [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            row = 0
            while row < batch.num_rows:
                end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK - total, "right")) - 1)
                keys.append(batch.column(0).slice(row, end - row))
                parts.append(data[offsets[row] : offsets[end]].copy())
                sizes.append(np.diff(offsets[row : end + 1]))
                total += parts[-1].size
                row = end
                if total >= BLOCK // 2:
                    yield flush(keys, parts, sizes)
                    keys, parts, sizes, total = [], [], [], 0
        if keys:
            yield flush(keys, parts, sizes)

    return run


def _again(names: DataFrame) -> DataFrame:
    """Rows whose name occurs more than once anywhere, with whether it meets too many texts."""
    same = Window.partitionBy("name")
    counted = names.select("block", "name", F.sum("copies").over(same).alias("all"), F.sum("kinds").over(same).alias("texts"))
    return counted.where("all > 1").select("block", "name", (F.col("texts") > HOT).alias("hot"))


def _hot_strings(folder: str, length: int):
    """For every block, the strings of its stretches at hot grams, known by themselves."""
    schema = pa.schema([("block", pa.int64()), ("name", pa.int64()), ("copies", pa.int64()), ("kinds", pa.int64())])

    def run(batches):
        for (block,), rows in by_keys(batches, ["block"]):
            data, first, n, name = load_block(folder, block, "data", "first", "n", "name")
            cut = _starts_at(np.array(rows.column("name")), name, first, n)
            found, copies = np.unique(string_hashes(data, cut, length), return_counts=True)
            ones = np.ones(found.size, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ones * block), pa.array(found.view(np.int64)), pa.array(copies), pa.array(ones)], schema=schema)

    return run


_HEAD = np.dtype("<i8")


def packed(ids: np.ndarray, kind: np.ndarray, lo: np.ndarray, hi: np.ndarray, copies: np.ndarray, right: list[bytes], left: list[bytes]) -> bytes:
    """A run: entries ordered by what follows the anchor, front-coded, and what comes before, in its own order."""
    order = sorted(range(len(right)), key=right.__getitem__)
    back = sorted(range(len(order)), key=lambda i: left[order[i]])
    shared, sizes, rests = front_code([right[i] for i in order])
    shared2, sizes2, rests2 = front_code([left[order[i]] for i in back])
    numbers = [a[order] for a in (ids, kind, lo, hi, copies)] + [shared, sizes, np.array(back, dtype=np.int64), shared2, sizes2]
    head = np.array([len(order), len(rests), len(rests2)], dtype=_HEAD).tobytes()
    body = b"".join(a.astype("<i8" if i == 0 else "<i4").tobytes() for i, a in enumerate(numbers))
    return head + body + rests + rests2


def unpacked(run: bytes) -> tuple[list[np.ndarray], bytes, bytes]:
    n, size, size2 = np.frombuffer(run, dtype=_HEAD, count=3).tolist()
    arrays, at = [], 24
    for i in range(10):
        kind = np.dtype("<i8" if i == 0 else "<i4")
        arrays.append(np.frombuffer(run, dtype=kind, count=n, offset=at))
        at += n * kind.itemsize
    return arrays, run[at : at + size], run[at + size : at + size + size2]


def _sorted_runs(folder: str, length: int, n_shards: int):
    """The runs of a block, one for each shard it has entries for."""
    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("run", pa.binary())])

    def run(batches):
        for (block,), rows in by_keys(batches, ["block"]):
            data, first, n, anchor, name, entry = load_block(folder, block, "data", "first", "n", "anchor", "name", "entry")
            asked, what = np.array(rows.column("name")), np.array(rows.column("what"))
            stretch = np.flatnonzero(np.isin(name, asked[what == STRETCH]))
            ids, at, copies = np.unique(entry[stretch], return_index=True, return_counts=True)
            rep = stretch[at]
            start, stop, mid, key = first[rep], first[rep] + n[rep] - 1, anchor[rep], name[rep]
            kind = np.full(ids.size, STRETCH)
            if (what == STRING).any():
                cut = _starts_at(asked[what == CUT_UP], name, first, n)
                strings, place, times = np.unique(string_hashes(data, cut, length).view(np.int64), return_index=True, return_counts=True)
                own = np.flatnonzero(np.isin(strings, asked[what == STRING]))
                where = cut[place[own]]
                ids, copies = np.concatenate([ids, strings[own]]), np.concatenate([copies, times[own]])
                start, stop, mid = (np.concatenate([a, where]) for a in (start, stop, mid))
                key, kind = np.concatenate([key, strings[own]]), np.concatenate([kind, np.full(own.size, STRING)])
            raw = data.tobytes()
            shard = (mix(key.astype(np.int64).view(np.uint64)) % np.uint64(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = order[a:b]
                s, e, m = start[own].tolist(), stop[own].tolist(), mid[own].tolist()
                right = [raw[x : y + length] for x, y in zip(m, e, strict=True)]
                left = [raw[x:y][::-1] for x, y in zip(s, m, strict=True)]
                body = packed(ids[own], kind[own], mid[own] - stop[own], mid[own] - start[own], copies[own], right, left)
                yield pa.RecordBatch.from_pydict({"shard": [int(shard[own[0]])], "block": [block], "run": [body]}, schema=schema)

    return run


def _ranked(runs: list, sizes: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every string of the runs (laid end to end), and shared bytes by rank."""
    base = np.cumsum([0, *sizes])[:-1].tolist()
    rank, shared = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for place, (run, share) in enumerate(merge(runs)):
        rank[base[run]] = place
        base[run] += 1
        shared[place] = share
    return rank, shared


def repeated(length: int, lo: np.ndarray, hi: np.ndarray, copies: np.ndarray, right, left) -> list[np.ndarray]:
    """For every entry, which of its strings (``lo`` to ``hi`` bytes before the anchor) occur again.

    ``right`` and ``left`` are ranks and shared bytes of what follows and what comes before.
    """
    n = lo.size
    base = np.concatenate([[0], np.cumsum(hi - lo + 1)])
    flat = np.repeat(copies > 1, hi - lo + 1)
    for d in range(int(lo.min()), int(hi.max()) + 1):
        own = np.flatnonzero((lo <= d) & (d <= hi))
        if not own.size:
            continue
        after = np.cumsum(right[1] < length - d)[right[0][own]]
        before = np.cumsum(left[1] < d)[left[0][own]]
        pair = after * (n + 1) + before
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        twice = np.zeros(own.size, dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        flat[base[own] + d - lo[own]] |= twice
    return [flat[base[i] : base[i + 1]] for i in range(n)]


def _merged(length: int):
    """Merge the runs of a shard and report the repeated strings of every entry, as bits."""
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("bits", pa.binary())])

    def run(batches):
        for _, rows in by_keys(batches, ["shard"]):
            parts = [unpacked(r.as_py()) for r in rows.column("run")]
            blocks = np.repeat(np.array(rows.column("block")), [p[0][0].size for p in parts])
            ids, kind, lo, hi, copies = (np.concatenate([p[0][i] for p in parts]).astype(np.int64) for i in range(5))
            sizes = [p[0][0].size for p in parts]
            right = _ranked([front_decode(p[0][5], p[0][6], p[1]) for p in parts], sizes, ids.size)
            rank, shared = _ranked([front_decode(p[0][8], p[0][9], p[2]) for p in parts], sizes, ids.size)
            own = np.concatenate([p[0][7].astype(np.int64) + b for p, b in zip(parts, np.cumsum([0, *sizes])[:-1], strict=True)])
            back = np.zeros(ids.size, dtype=np.int64)
            back[own] = rank
            flags = repeated(length, lo, hi, copies, right, (back, shared))
            hit = [i for i, f in enumerate(flags) if f.any()]
            if hit:
                bits = pa.array([np.packbits(flags[i]).tobytes() for i in hit], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(blocks[hit]), pa.array(kind[hit], pa.int32()), pa.array(ids[hit]), bits], schema=schema)

    return run


_SPANS = "array<struct<start:long,stop:long>>"


def _marked(folder: str, length: int):
    """Open every block beside its repeated strings: spans to remove and what stays."""
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])

    def run(batches):
        for (block,), rows in by_keys(batches, ["block"]):
            names = ("data", "offsets", "key", "known", "first", "n", "anchor", "name", "entry")
            data, offsets, key, known, first, n, anchor, name, entry = load_block(folder, block, *names)
            starts = np.zeros(data.size + 1, dtype=bool)
            kind, ids, bits = (rows.column(c).to_pylist() for c in ("kind", "id", "bits"))
            order = np.argsort(entry, kind="stable")
            edge = np.searchsorted(entry[order], np.arange(int(entry.max(initial=-1)) + 2))
            strings, cut_up = [], []
            for k, i, b in zip(kind, ids, bits, strict=True):
                if k == STRING:
                    strings.append(i)
                elif k == CUT_UP:
                    cut_up.append(i)
                elif k == STRETCH:
                    own = order[edge[i] : edge[i + 1]]
                    low = int(anchor[own[0]] - first[own[0]] - n[own[0]] + 1)
                    d = low + np.flatnonzero(np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=int(n[own[0]])))
                    starts[(anchor[own][:, None] - d).ravel()] = True
            if strings:
                cut = _starts_at(np.array(cut_up), name, first, n)
                starts[cut[np.isin(string_hashes(data, cut, length).view(np.int64), np.array(strings))]] = True
            so_far = np.cumsum(starts[:-1], dtype=np.int64)
            covered = so_far > 0
            covered[length:] = so_far[length:] > so_far[:-length]
            edges = np.zeros(data.size + 1, dtype=bool)
            edges[1:-1] = covered[1:] != covered[:-1]
            edges[offsets] = True
            at = np.flatnonzero(edges)
            runs = np.flatnonzero(covered[at[:-1]]) if data.size else np.zeros(0, dtype=np.int64)
            a, b = at[runs], at[runs + 1] if runs.size else at[runs]
            doc = np.searchsorted(offsets, a, "right") - 1
            per = np.bincount(doc, minlength=key.size)
            left = np.concatenate([[0], np.cumsum(~covered)])
            kept, stays = data[~covered], left[offsets]
            done = 0
            for c in range(0, key.size, 2048):
                e = min(key.size, c + 2048)
                m = int(per[c:e].sum())
                spans = pa.StructArray.from_arrays([pa.array(x[done : done + m] - np.repeat(offsets[c:e], per[c:e])) for x in (a, b)], names=["start", "stop"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per[c:e])]).astype(np.int32)), spans)
                done += m
                place = (stays[c : e + 1] - stays[c]).astype(np.int32)
                texts = pa.Array.from_buffers(pa.binary(), e - c, [None, pa.py_buffer(place.tobytes()), pa.py_buffer(kept[stays[c] : stays[e]].tobytes())])
                keys = pa.array(key[c:e], mask=known[c:e] == 0)
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(offsets[c : e + 1])), lists, texts], schema=schema)

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for every row of ``docs`` (``doc_id`` long, ``text``).

    ``spans`` are the maximal runs of bytes covered by a string of ``length`` bytes that also starts anywhere
    else (start, and stop exclusive); ``kept`` are the other bytes. Strings do not cross documents. Null text
    is empty; rows that repeat a ``doc_id``, or have none, are documents of their own; a table without rows
    gives none. Other columns are not read.
    """
    if not 0 < length <= STEP:
        raise ValueError(f"length must be between 1 and {STEP}")
    spark = docs.sparkSession
    folder = new_scratch(spark, "suffix-blocks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = "block long, name long, copies long, kinds long"
    names = materialize(texts.mapInArrow(_kept_blocks(folder, length, min(gram, length)), rows), "suffix-names")
    again = materialize(_again(names.where("name is not null")), "suffix-again")
    n_tasks = max(1, min(MOST_TASKS, names.where("name is null").count()))

    def beside(df: DataFrame) -> DataFrame:
        """Rows of one block together, a task for every block or so: the rows are few, the blocks are not."""
        return df.repartition(n_tasks, "block").sortWithinPartitions("block")

    strings = _again(beside(again.where("hot")).mapInArrow(_hot_strings(folder, length), rows))
    what = F.when(F.col("hot"), CUT_UP).otherwise(STRETCH)
    wanted = again.select("block", "name", what.alias("what")).unionByName(strings.select("block", "name", F.lit(STRING).alias("what")))
    n_shards = max(1, -(-again.count() // SHARD))
    runs = beside(wanted).mapInArrow(_sorted_runs(folder, length, n_shards), "shard long, block long, run binary")
    merged = runs.repartitionById(min(MOST_TASKS, n_shards), F.pmod("shard", F.lit(min(MOST_TASKS, n_shards))).cast("int")).sortWithinPartitions("shard", "block").mapInArrow(_merged(length), "block long, kind int, id long, bits binary")
    nothing = F.lit(None).cast("binary").alias("bits")
    listed = names.where("name is null").select("block", F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("id"), nothing)
    cut_up = again.where("hot").select("block", F.lit(CUT_UP).alias("kind"), F.col("name").alias("id"), nothing)
    return beside(merged.unionByName(listed).unionByName(cut_up)).mapInArrow(_marked(folder, length), f"doc_id long, n_bytes long, spans {_SPANS}, kept binary")


def op12_suffixes(spark, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that also start anywhere else."""
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op12_suffixes": op12_suffixes}
ORACLE = {
    "op12_suffixes": f"""
with d as materialized (
  select r, doc_id, encode(t) as b, strlen(t) as n from (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents)),
w as materialized (
  select r, s, md5(b[s + 1 : s + {LENGTH}]) as k from (select r, b, unnest(range(0, n - {LENGTH - 1})) as s from d where n >= {LENGTH})),
rep as materialized (select r, s from w where k in (select k from w group by k having count(*) > 1)),
runs as (
  select r, s, sum(new) over (partition by r order by s) as g
  from (select r, s, case when s - lag(s) over (partition by r order by s) <= {LENGTH} then 0 else 1 end as new from rep)),
spans as materialized (select r, min(s) as a, max(s) + {LENGTH} as z from runs group by r, g),
gaps as (
  select r, z as lo, coalesce(lead(a) over (partition by r order by a), n) as hi from spans join d using (r)
  union all select r, 0, min(a) from spans group by r),
kept as (select r, unhex(string_agg(hex(b)[2 * lo + 1 : 2 * hi], '' order by lo)) as bytes from gaps join d using (r) where lo < hi group by r),
removed as (select r, sum(z - a) as n_removed, count(*) as n_spans from spans group by r)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  case when n_spans is null then sha256(b) when bytes is null then sha256('') else sha256(bytes) end as kept_sha256
from d left join removed using (r) left join kept using (r)
"""
}
