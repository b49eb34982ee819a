"""Jaccard join of word n-gram sets over a prefix tree, and the groups that its links make.

Every set is ordered by one global order of n-grams. What two sets share must show up early: if a pair
is similar enough, their beginnings share an n-gram, and the place of the first shared one bounds what
can still follow. The tree's upper level is spread over the cluster, a list of sets for each n-gram
that begins a branch; below it, the ordered sets of a branch lie next to each other in a task, so that
sets with the same beginning share the overlap counted so far, and a branch is left as soon as what
remains of its sets cannot reach the least overlap.

The order has rare n-grams first. Rarity is known for a fixed part of each set (its ``REGION`` smallest
hashes), and all bounds below are those of this part; the final count is over whole sets. Equal sets
are one set here. Links are followed to components, so in a group of thousands of near copies only the
links that join different components are looked for once a group has a centre.
"""

from __future__ import annotations


from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.components import components
from voxloom.llm.words import mix, window_hashes, words_of
from voxloom.session import materialize

WORDS = 5
#: Two sets link when PART * intersection >= SHARE * union.
SHARE, PART = 75, 100
#: Part of a set, in hundredths, whose n-grams are compared before the whole sets are.
REGION = 40
#: An n-gram in more than one of so many sets is common: known to every task, and last in the order.
COMMON = 1000
#: Hashes that a task looks at together before they are sent.
GATHER = 1_000_000
#: Sets of a list that are compared in one task; longer lists are cut, and every two cuts compared.
CUT = 1024
#: Sets are held against centres, then along the likeliest pairs of each list, before all that is left is compared.
STEPS = ("centre", "forest", "all")


def region(n):
    """How many of the smallest hashes of a set of ``n`` are in its region."""
    return n * REGION // 100 + 1


def least_overlap(a, b):
    """The smallest intersection that links sets of sizes ``a`` and ``b``."""
    return -(-(SHARE * (a + b)) // (SHARE + PART))


@lru_cache(maxsize=1 << 16)
def least_shared(n: int) -> int:
    """How many n-grams of its region a set of ``n`` shares at least with any set that it links with.

    Of the intersection, what lies beyond the end of the region that ends first is no more than that set
    has there.
    """
    own = n - region(n)
    sizes = np.arange(-(-SHARE * n // PART), PART * n // SHARE + 1)
    rest = np.maximum(own, sizes - np.minimum(region(sizes), sizes))
    return max(1, int((least_overlap(n, sizes) - rest).min()))


def _sets(column: pa.Array):
    """For each slice: its rows, and for each row the sorted hashes of the distinct n-grams."""
    for w in words_of(column):
        hashes = w.hashes(lower=True)
        grams = window_hashes(hashes, WORDS)
        out, first = [], w.first.tolist()
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= WORDS:
                out.append(np.unique(grams[a : b - WORDS + 1]))
            elif b > a:  # the whole sequence; windows of another length have other hashes
                out.append(window_hashes(hashes[a:b], b - a))
            else:
                out.append(grams[:0])
        yield w.rows, out


def _signature(own: np.ndarray) -> int:
    return int(mix(np.array([np.bitwise_xor.reduce(mix(own)) + np.uint64(own.size)], dtype=np.uint64)).view(np.int64)[0])


def members(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, sig`` of every row; equal sets have equal ``sig``.

    In the same pass, rows with ``gram`` and ``n`` instead: n-grams that come more than once in the regions of a
    few thousand texts of rows with a number.
    """
    names = ["doc_id", "text_hash", "n_shingles", "sig", "gram", "n"]

    def repeated(held):
        values, n = np.unique(np.concatenate(held), return_counts=True)
        values, n = values[n > 1].view(np.int64), n[n > 1]
        return pa.RecordBatch.from_arrays([*[pa.nulls(n.size, pa.int64())] * 4, pa.array(values), pa.array(n)], names=names)

    def run(batches):
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for rows, sets in _sets(b.column(1)):
                own = [b.column(i).slice(rows.start, len(rows)) for i in (0, 2)]
                counts = [pa.array([s.size for s in sets], pa.int64()), pa.array([_signature(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*own, *counts, *[pa.nulls(len(rows), pa.int64())] * 2], names=names)
                for s, numbered in zip(sets, known[rows.start : rows.stop].tolist(), strict=True):
                    if numbered and s.size:
                        held.append(s[: region(s.size)])
                        size += held[-1].size
                if size > GATHER:
                    yield repeated(held)
                    held, size = [], 0
        if held:
            yield repeated(held)

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _regions(docs: DataFrame, rows, schema: str, fields: list[str]) -> DataFrame:
    """``rows`` gets hash, signature and size for the regions of many texts at once, ``GATHER`` hashes or a few more."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            for _, sets in _sets(b.column(0)):
                sets = [s for s in sets if s.size]
                if not sets:
                    continue
                sizes = np.array([s.size for s in sets])
                keep = np.minimum(region(sizes), sizes)
                tokens = np.concatenate([s[:k] for s, k in zip(sets, keep.tolist(), strict=True)]).view(np.int64)
                sig = np.repeat(np.array([_signature(s) for s in sets], dtype=np.int64), keep)
                held.append((tokens, sig, np.repeat(sizes, keep)))
                if sum(h[0].size for h in held) > GATHER:
                    yield from rows(*(np.concatenate(x) for x in zip(*held, strict=True)), fields)
                    held = []
        if held:
            yield from rows(*(np.concatenate(x) for x in zip(*held, strict=True)), fields)

    return docs.select("text").mapInArrow(run, schema)


def common_grams(repeated: DataFrame, n_docs: int) -> np.ndarray:
    """N-grams of more than one of ``COMMON`` documents, by the counts ``gram, n`` of those that repeat in ``members``.

    A region has a bounded mean size, so there are at most ``COMMON`` times that many.
    """
    most = repeated.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > max(CUT, n_docs // COMMON))
    return np.sort(np.array(most.select("gram").toArrow()["gram"].to_numpy(), dtype=np.int64))


def shared_grams(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """``sig, n, gram, sets`` for every n-gram of a region that several sets have; common ones have the largest number.

    Common n-grams go straight to their set. The others meet by n-gram, sorted, in one pass over each
    partition that holds one n-gram at a time.
    """
    known = docs.sparkSession.sparkContext.broadcast(common)
    fields = ["gram", "sig", "n", "common"]

    def rows(tokens, sig, sizes, fields):
        _, at = np.unique(mix(tokens.view(np.uint64)) ^ mix(sig.view(np.uint64) + np.uint64(1)), return_index=True)  # copies side by side
        tokens, sig, sizes = tokens[at], sig[at], sizes[at]
        place = np.searchsorted(known.value, tokens)
        place = np.minimum(place, max(0, known.value.size - 1))
        hot = known.value[place] == tokens if known.value.size else np.zeros(tokens.size, dtype=bool)
        yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(sig), pa.array(sizes, pa.int32()), pa.array(hot)], names=fields)

    all_ = _regions(docs, rows, "gram long, sig long, n int, common boolean", fields)
    key = F.when(F.col("common"), F.xxhash64("gram", "sig")).otherwise(F.col("gram"))
    spread = all_.repartition(key).sortWithinPartitions("gram")  # one number, most of them alone

    def groups(batches):
        held: list[tuple] = []  # rows of the n-gram that the last batch ended with

        def told(gram, sig, n, hot):
            edge = np.r_[True, gram[1:] != gram[:-1], True]
            kept = np.flatnonzero(~(edge[1:] & edge[:-1]) | hot)
            kept = kept[np.lexsort((sig[kept], gram[kept]))]
            gram, sig, n, hot = gram[kept], sig[kept], n[kept], hot[kept]
            new = np.ones(gram.size, dtype=bool)
            new[1:] = (gram[1:] != gram[:-1]) | (sig[1:] != sig[:-1])
            gram, sig, n, hot = gram[new], sig[new], n[new], hot[new]
            _, back, sets = np.unique(gram, return_inverse=True, return_counts=True)
            sets = np.where(hot, 1 << 40, sets[back])
            keep = sets > 1
            return pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(n[keep], pa.int32()), pa.array(gram[keep]), pa.array(sets[keep])], names=["sig", "n", "gram", "sets"])

        for b in batches:
            if not b.num_rows:
                continue
            parts = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            last = int(np.searchsorted(parts[0], parts[0][-1], "left"))
            if last or (held and held[0][0][0] != parts[0][0]):
                yield told(*(np.concatenate([*(h[i] for h in held), parts[i][:last]]) for i in range(4)))
                held = []
            held.append(tuple(p[last:] for p in parts))
        if held:
            yield told(*(np.concatenate([h[i] for h in held]) for i in range(4)))

    return spread.mapInArrow(groups, "sig long, n int, gram long, sets long")


def ordered_regions(shared: DataFrame) -> DataFrame:
    """``sig, n, grams``: for each set what its region shares with any other set, rare first."""
    per_set = shared.groupBy("sig").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("sets", "gram"))).alias("grams"))
    return per_set.select("sig", "n", F.transform("grams", lambda x: x["gram"]).alias("grams"))


def branches(ordered: DataFrame) -> DataFrame:
    """``gram, sig, n, tail``: for each set the n-grams that its branches of the tree begin with.

    N-grams of one set only come first in the order and begin no branch with another set. ``tail`` is what
    the region still holds from this n-gram on, the bound on what can be shared.
    """

    def run(batches):
        for b in batches:
            grams = b.column(2)
            token = grams.flatten().to_numpy()
            k = np.diff(grams.offsets.to_numpy()).tolist()
            out, at = [], 0
            for sig, n, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), k, strict=True):
                whole = min(region(n), n)
                alone = whole - size
                first = max(0, min(size, whole - least_shared(n) + 1 - alone))
                out.append((token[at : at + first], sig, n, whole - alone - np.arange(first)))
                at += size
            sizes = [o[0].size for o in out]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([o[0] for o in out])), pa.array(np.repeat(np.array([o[1] for o in out], dtype=np.int64), sizes)), pa.array(np.repeat([o[2] for o in out], sizes), pa.int32()), pa.array(np.concatenate([o[3] for o in out]), pa.int32())],
                    names=["gram", "sig", "n", "tail"],
                )

    return ordered.select("sig", "n", "grams").mapInArrow(run, "gram long, sig long, n int, tail int")


def _lists(tree: DataFrame, label: DataFrame | None) -> DataFrame:
    """Branches with the component of each set and the cut of the list it is in; lists within one component are left out.

    Once there are components, of lists of the very same sets only the first in the order is left (its sets have the
    largest tails): pairs are compared in the list of the first n-gram they share, and they share that one.
    """
    if label is None:
        rows = tree.withColumn("component", F.col("sig"))
    else:
        rows = tree.join(label.withColumnRenamed("id", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    same = [] if label is None else [F.bit_xor(F.xxhash64("sig")).alias("one"), F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("two"), F.max("tail").alias("tail")]
    sizes = rows.groupBy("gram").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"), *same).where("lo <> hi")
    if same:
        sizes = sizes.groupBy("m", "one", "two").agg(F.max_by("gram", "tail").alias("gram"))
    rows = rows.join(sizes.select("gram", "m"), "gram")
    cuts = F.ceil(F.col("m") / CUT).cast("int")
    return rows.select("gram", "sig", "n", "tail", "component", cuts.alias("cuts"), F.pmod(F.xxhash64("sig"), cuts).cast("int").alias("cut"))


_LIST = ["gram", "one", "two", "sig", "n", "tail", "component", "cut"]


def _in_lists(rows: DataFrame, each, schema: str) -> DataFrame:
    """Apply ``each`` to the rows of every list (or pair of cuts), which lie together in a partition."""
    spread = rows.repartition("gram", "one", "two").sortWithinPartitions("gram", "one", "two", "sig").select(*_LIST)

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            parts = [b.column(i).to_numpy() for i in range(len(_LIST))]
            if held is not None:
                parts = [np.concatenate([h, p]) for h, p in zip(held, parts, strict=True)]
            edge = np.flatnonzero(np.r_[False, (parts[0][1:] != parts[0][:-1]) | (parts[1][1:] != parts[1][:-1]) | (parts[2][1:] != parts[2][:-1])])
            if edge.size:
                yield from each([p[: edge[-1]] for p in parts], np.r_[0, edge])
                parts = [p[edge[-1] :] for p in parts]
            held = parts
        if held is not None:
            yield from each(held, np.array([0, held[0].size]))

    return spread.mapInArrow(run, schema)


def _feasible(n, m, tail, tail_m):
    """Whether sets of sizes ``n`` and ``m`` can still link when at most the smaller tail is shared in their regions."""
    big, small = np.maximum(n, m), np.minimum(n, m)
    rest = np.maximum(n - np.minimum(region(n), n), m - np.minimum(region(m), m))
    return (PART * small >= SHARE * big) & (np.minimum(tail, tail_m) >= least_overlap(n, m) - rest)


def centre_pairs(lists: DataFrame) -> DataFrame:
    """``a, b``: each set with the centre it meets most often, a centre being the set of a list with the fewest n-grams of its own.

    In a family of copies that is the one they were made from, or the closest to it. Sets of the centre's
    own component are held against the first set of another one.
    """
    rows = lists.select("gram", F.col("cut").alias("one"), F.col("cut").alias("two"), "sig", "n", "tail", "component", "cut")

    def each(parts, edges):
        group = np.repeat(np.arange(edges.size - 1), np.diff(edges))
        order = np.lexsort((parts[3], -(parts[5] / parts[4]), group))
        sig, n, tail, component = (parts[i][order] for i in (3, 4, 5, 6))
        n = n.astype(np.int64)
        first = np.repeat(edges[:-1], np.diff(edges))
        # the first set of the list, or for its own component the first of another
        other = component != component[first]
        second = np.full(edges.size - 1, -1)
        at = np.flatnonzero(other)[::-1]
        second[group[at]] = at
        centre = np.where(other, first, second[group])
        ok = centre >= 0
        mine, centre = np.flatnonzero(ok), centre[ok]
        ok = _feasible(n[mine], n[centre], tail[mine], tail[centre])
        yield pa.RecordBatch.from_arrays([pa.array(sig[mine[ok]]), pa.array(sig[centre[ok]])], names=["x", "centre"])

    met = _in_lists(rows, each, "x long, centre long").groupBy("x", "centre").agg(F.count("*").alias("k"))
    best = met.groupBy("x").agg(F.max(F.struct("k", "centre"))["centre"].alias("centre"))
    return best.select(F.least("x", "centre").alias("a"), F.greatest("x", "centre").alias("b")).distinct()


def _cut_pairs(lists: DataFrame) -> DataFrame:
    """Rows of lists once for every two cuts that they are compared in."""
    cuts = F.col("cuts")
    other = F.when(cuts == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), cuts - 1))
    rows = lists.withColumn("other", F.explode(other))
    return rows.select("gram", F.least("cut", "other").alias("one"), F.greatest("cut", "other").alias("two"), "sig", "n", "tail", "component", "cut")


def possible_rows(rows: DataFrame) -> DataFrame:
    """``gram, one, two, sig``: rows that the tails leave a partner in another component."""

    def each(parts, edges):
        found = []
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            sig, n, tail, component, cut = (p[s:e] for p in parts[3:8])
            n, tail = n.astype(np.int64), tail.astype(np.int64)
            for at in range(0, e - s, 256):
                i = np.arange(at, min(at + 256, e - s))
                good = _feasible(n[i][:, None], n[None, :], tail[i][:, None], tail[None, :]) & (component[i][:, None] != component[None, :])
                if parts[1][s] != parts[2][s]:
                    good &= cut[i][:, None] != cut[None, :]
                keep = s + i[good.any(axis=1)]
                found.append(keep)
        keep = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([pa.array(p[keep]) for p in parts[:4]], names=_LIST[:4])

    return _in_lists(rows, each, "gram long, one int, two int, sig long")


def _in_several(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the values, and which of them come more than once: what one set alone has is in no count."""
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    return column, times[column] > 1


def _shared_counts(column: np.ndarray, row: np.ndarray, rows: int, step: int = 1024) -> np.ndarray:
    """How many columns every two rows have in common; a row has a column once."""
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    # Columns are numbered anew, without those that are not there.
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if column.size else column
    out = np.zeros((rows, rows), dtype=np.float32)
    for first in range(0, int(column.max(initial=-1)) + 1, step):
        own = slice(*np.searchsorted(column, [first, first + step]))
        width = min(step, int(column[-1]) + 1 - first)
        block = np.zeros((rows, width), dtype=np.float32)
        block[row[own], column[own] - first] = 1
        out += block @ block.T
    return out


def _forest(x: np.ndarray, y: np.ndarray, weight: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Places of the pairs, heaviest first, that join components not joined before."""
    parent = {c: c for c in component.tolist()}

    def find(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    kept, apart = [], len(parent)
    order = np.argsort(-weight, kind="stable")
    for k, a, b in zip(order.tolist(), component[x[order]].tolist(), component[y[order]].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[a] = b
            kept.append(k)
            apart -= 1
            if apart == 1:
                break
    return np.array(kept, dtype=np.int64)


def _solved(rows: DataFrame, grams: DataFrame, solve, schema: str) -> DataFrame:
    """``solve`` for each list or pair of cuts: rows ``gram, one, two, sig, n, component, cut`` with the ``grams`` of each set."""
    spread = rows.join(grams.select("sig", "grams"), "sig").repartition("gram", "one", "two")
    spread = spread.sortWithinPartitions("gram", "one", "two", "sig").select("gram", "one", "two", "sig", "n", "component", "cut", "grams")

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            while b.num_rows:
                key = held[0] if held else b
                same = np.ones(b.num_rows, dtype=bool)
                for i in range(3):
                    same &= b.column(i).to_numpy() == key.column(i)[0].as_py()
                end = int(np.argmin(same)) if not same.all() else b.num_rows
                if end:
                    held.append(b.slice(0, end))
                b = b.slice(end)
                if b.num_rows:
                    yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return spread.mapInArrow(run, schema)


def _open(t: pa.RecordBatch):
    """The parts of a list, and which of its pairs are in different components (and cuts, if there are two)."""
    sig, n, component, cut = (t.column(i).to_numpy() for i in range(3, 7))
    grams = t.column(7)
    sizes = np.diff(grams.offsets.to_numpy())
    apart = (component[:, None] != component[None, :]) & (sig[:, None] < sig[None, :])
    if t.column(1)[0].as_py() != t.column(2)[0].as_py():
        apart &= cut[:, None] != cut[None, :]
    return sig, n.astype(np.int64), component, sizes, grams.flatten().to_numpy(), np.repeat(np.arange(n.size), sizes), apart


def _by_regions(t: pa.RecordBatch) -> tuple:
    """Pairs of a list whose regions share enough for a link, in the list of the first n-gram they share.

    Every two sets walk their ordered regions together: what they share before the list's n-gram sends
    the pair to another list, and what they share in all is held against the least that a link needs.
    """
    sig, n, component, sizes, flat, row, apart = _open(t)
    at = np.flatnonzero(flat == t.column(0)[0].as_py())  # once in every row, and rows are in order
    before = np.arange(flat.size) < np.repeat(at, sizes)
    column, several = _in_several(flat)
    column, row, before = column[several], row[several], before[several]
    shared, earlier = _shared_counts(column, row, n.size), _shared_counts(column[before], row[before], n.size)
    x, y = np.nonzero(apart & (earlier == 0) & (shared > 0))
    good = _feasible(n[x], n[y], shared[x, y], shared[x, y])
    x, y = x[good], y[good]
    return sig, n, component, x, y, shared[x, y]


def forest_pairs(lists: DataFrame, ordered: DataFrame) -> DataFrame:
    """``a, b``: of the pairs that their regions leave possible the likeliest that would join all components of a list."""

    def solve(t):
        sig, n, component, x, y, shared = _by_regions(t)
        best = _forest(x, y, shared / (n[x] + n[y]), component)
        return pa.RecordBatch.from_arrays([pa.array(sig[x[best]]), pa.array(sig[y[best]])], names=["a", "b"])

    return _solved(_possible(lists), ordered, solve, "a long, b long")


def _possible(lists: DataFrame) -> DataFrame:
    rows = materialize(_cut_pairs(lists), "cross-lists")
    return rows.join(possible_rows(rows), ["gram", "one", "two", "sig"])


def cross_links(lists: DataFrame, ordered: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: every link that is left between components.

    First the rows whose regions leave a partner possible, then the whole sets of those. Only links leave
    a task, however many pairs of a list come close.
    """

    def near(t):
        sig, n, component, x, y, shared = _by_regions(t)
        keep = np.unique(np.r_[x, y])
        return pa.RecordBatch.from_arrays([t.column(i).take(pa.array(keep)) for i in range(7)], names=t.schema.names[:7])

    def link(t):
        sig, n, component, sizes, flat, row, apart = _open(t)
        column, several = _in_several(flat)
        shared = _shared_counts(column[several], row[several], n.size)
        x, y = np.nonzero(apart & (PART * shared >= SHARE * (n[:, None] + n[None, :] - shared)))
        return pa.RecordBatch.from_arrays([pa.array(sig[x]), pa.array(sig[y])], names=["a", "b"])

    rows = materialize(_solved(_possible(lists), ordered, near, "gram long, one int, two int, sig long, n int, component long, cut int"), "near-rows")
    return _solved(rows, sets, link, "a long, b long").distinct()


def overlaps(own: np.ndarray, others: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """The intersection of ``own`` with each of ``others``, or -1 where it stays under ``least``.

    ``others`` are ascending and lie in a tree: in lexical order, what two neighbours begin with is one
    path, and the overlap counted along it is shared. A path is left when the overlap so far and the
    rest of the set cannot reach the least overlap.
    """
    out = np.full(len(others), -1, dtype=np.int64)
    order = sorted(range(len(others)), key=lambda k: others[k][:8].tolist())
    before: np.ndarray | None = None
    counted = np.zeros(1, dtype=np.int64)
    for k in order:
        own_k = others[k]
        same = 0
        if before is not None:
            m = min(before.size, own_k.size, counted.size - 1)
            differ = np.flatnonzero(before[:m] != own_k[:m])
            same = int(differ[0]) if differ.size else m
        path = [counted[: same + 1]]
        at, total = same, int(counted[same])
        while at < own_k.size and total + own_k.size - at >= least[k]:
            step = own_k[at : at + 256]
            place = np.minimum(np.searchsorted(own, step), own.size - 1)
            path.append(total + np.cumsum(own[place] == step))
            at, total = at + step.size, int(path[-1][-1])
        counted = np.concatenate(path)
        before = own_k
        if at == own_k.size and total >= least[k]:
            out[k] = total
    return out


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets link, with their intersection: ``a, b, shared``."""
    left = sets.select(F.col("sig").alias("a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("sig").alias("b"), F.col("grams").alias("grams_b"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "grams_a", "grams_b")

    def run(batches):
        for b in batches:
            for piece in range(0, b.num_rows, 500):
                part = b.slice(piece, 500)
                a, other = part.column(0).to_numpy(), part.column(1).to_numpy()
                x, y = part.column(2), part.column(3)
                found = []
                for own in np.unique(a):
                    at = np.flatnonzero(a == own)
                    one = x[int(at[0])].values.to_numpy()
                    many = [y[int(k)].values.to_numpy() for k in at]
                    least = least_overlap(one.size, np.array([m.size for m in many]))
                    n = overlaps(one, many, least)
                    found += [(own, other[k], v) for k, v in zip(at[n >= 0], n[n >= 0].tolist(), strict=True)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["a", "b", "shared"])

    return rows.mapInArrow(run, "a long, b long, shared long")


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sig, grams`` (ascending) of the documents in ``wanted`` (``doc_id, sig``)."""

    def run(batches):
        for b in batches:
            for rows, sets in _sets(b.column(1)):
                sig = b.column(0).slice(rows.start, len(rows)).to_numpy()
                told = np.array([_signature(s) for s in sets], dtype=np.int64)
                at = np.flatnonzero(sig == told)  # another row may have the same number
                if at.size:
                    values = [sets[k].view(np.int64) for k in at]
                    flat = np.concatenate([np.sort(v) for v in values])
                    edges = np.cumsum([0, *(v.size for v in values)])
                    yield pa.RecordBatch.from_arrays([pa.array(told[at]), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat))], names=["sig", "grams"])

    rows = docs.select("doc_id", "text").join(wanted, "doc_id").select("sig", "text")
    return rows.mapInArrow(run, "sig long, grams array<long>").dropDuplicates(["sig"])


def similar(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_hash`` for each row of ``docs``.

    Null and empty texts have empty sets and link with nothing; their component is their own number.
    Rows may repeat; rows without a number are reported as they are and link nothing for others. Other
    columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = materialize(members(docs), "shingle-members")
    all_ = told.where("gram is null").drop("gram", "n")
    classes = all_.where("n_shingles > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    numbered = docs.where("doc_id is not null and text is not null")
    common = common_grams(told.where("gram is not null").select("gram", "n"), all_.count())
    ordered = materialize(ordered_regions(shared_grams(numbered, common)), "regions")
    tree = materialize(branches(ordered), "branches")
    # sets that meet no other in a list are done
    busy = tree.join(tree.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram"), "gram", "left_semi")
    wanted = classes.join(busy.select("sig").distinct(), "sig", "left_semi").select("doc_id", "sig")
    sets = materialize(whole_sets(numbered, wanted), "whole-sets")
    label, links = None, None
    for step in STEPS:
        lists = _lists(tree, label)
        if step == "all":
            found = cross_links(lists, ordered, sets)
        else:
            pairs = centre_pairs(lists) if step == "centre" else forest_pairs(lists, ordered).distinct()
            found = verified(pairs, sets).select("a", "b")
        found = materialize(found, "links")
        links = found if links is None else links.union(found)
        label = components(links)
    smallest = classes.join(label.withColumnRenamed("id", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    smallest = materialize(smallest, "classes")
    least = smallest.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = smallest.join(least, "component").select("sig", "component_id")
    out = all_.join(named, "sig", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), "text_hash")


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")


QUERIES = {"op2_jaccard": op2_jaccard}
ORACLE = {
    "op2_jaccard": rf"""
with recursive d as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (
  select distinct doc_id, array_to_string(w[p : p + {WORDS - 1}], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, least(len(w), 1)) + 1)) as p from d)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
i as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
l as materialized (
  select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where {PART} * k >= {SHARE} * (x.n + y.n - k)),
e as materialized (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from d union select r.a, e.b from r join e on e.a = r.b)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, min(r.b) as component_id
from d left join n using (doc_id) join r on r.a = d.doc_id group by all
"""
}
