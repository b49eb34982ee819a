"""Kneser-Ney models of characters, counted, smoothed and looked up by Spark.

A model is counted either over words, each of which stands for itself with a mark before and after it
(``train``: n-grams are taken from distinct words, weighted by their counts), or over whole texts, whose
contexts reach across words (``blocked`` with ``whole``, then ``fitted``). Lower orders count distinct
characters to the left (a beginning has none, so those n-grams keep their plain counts). One discount
gives interpolated Kneser-Ney, three (for counts of one, two, and more) the modified form.

A finished model is a table in the shared folder, with the log probability of each n-gram and the log
back-off weight of each context, and grows with the corpus; it is never sent to a task. Texts are put
into blocks that each know their distinct n-grams (``blocked``); those are joined with the model, and the
answers are kept as one file of sorted 64-bit hashes for each block (``answers``), which ``Scorer`` reads.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.blocks import new_block
from voxloom.llm.files import opened, written
from voxloom.llm.words import _BYTE_VALUE, _PLACE_VALUE, Words, mix, words_of
from voxloom.session import delete_path, materialize, new_scratch, scratch_paths, shuffles_dropped

HELD_WORDS = 300_000
#: A block of texts ends beyond this many bytes or distinct n-grams (and what one run of ``PENDING`` adds).
BLOCK_BYTES, BLOCK_GRAMS = 256 << 20, 1_000_000
PENDING = 250_000
#: Texts whose n-grams are taken at a time: some 100 bytes each character.
TOLD_BYTES = 1 << 18
#: Points whose n-grams are hashed at a time, so that the steps stay in the processor's cache.
HASHED = 1 << 15
#: Row groups of the table of blocks: each is read by one task.
GROUP_BYTES = 16 << 20
BEGIN, END = "\ue000", "\ue001"  # private characters


def _letters(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)


def _char_value(points: np.ndarray) -> np.ndarray:
    return mix(points * _BYTE_VALUE[7] + _BYTE_VALUE[11])


def gram_hashes(points: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """64 bits for the n-gram that ends at each point: ``order`` characters, or all from place 0 where there are fewer."""
    out = np.zeros(points.size, dtype=np.uint64)
    for start in range(0, points.size, HASHED):
        before = min(start, order - 1)
        values = _char_value(points[start - before : start + HASHED].astype(np.uint64))
        own = place[start : start + HASHED]
        short = np.flatnonzero(own < order - 1)
        total = np.zeros(values.size, dtype=np.uint64)
        for d in range(order):
            total[d:] += values[: max(0, values.size - d)] * _PLACE_VALUE[d]
            if d < order - 1:
                at = short[own[short] == d]
                out[start + at] = mix(total[before + at] + np.uint64(d + 1))
        short = out[start + short], short
        out[start : start + HASHED] = mix(total[before:] + np.uint64(order))
        out[start + short[1]] = short[0]
    return out


def _places(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _own_value(own: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(own.encode(), digest_size=8).digest(), "little"))


@dataclass
class Grams:
    """The n-grams of a list of texts or words, one for each character told (all but the mark at the beginning)."""

    points: np.ndarray  # characters of all texts with their marks
    ends: np.ndarray  # where in ``points`` each n-gram ends
    sizes: np.ndarray  # characters of each n-gram
    unit: np.ndarray  # the number of its text or word
    hashes: np.ndarray

    @staticmethod
    def of(units: list[str], order: int) -> Grams:
        sizes = np.array([len(u) + 2 for u in units], dtype=np.int64)
        points = _letters("".join([BEGIN + u + END for u in units]))
        place = _places(sizes)
        told = np.flatnonzero(place > 0)
        hashes = gram_hashes(points, place, order)[told]
        return Grams(points, told, np.minimum(place[told] + 1, order), np.repeat(np.arange(sizes.size), sizes - 1), hashes)

    def rows(self, at: np.ndarray, order: int) -> np.ndarray:
        """The characters of the n-grams ``at``, a row of ``order`` each that ends with them; anything may stand before shorter ones."""
        return self.points[np.maximum(self.ends[at][:, None] - np.arange(order - 1, -1, -1), 0)]

    def texts(self, at: np.ndarray) -> list[str]:
        order = int(self.sizes.max(initial=1))
        return gram_texts(self.rows(at, order), self.sizes[at]).to_pylist()


def gram_texts(rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings of the last ``sizes`` characters of each of ``rows``."""
    inside = np.arange(rows.shape[1]) >= rows.shape[1] - sizes[:, None]
    points = rows[inside]
    edges = np.r_[0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))]
    offsets = edges[np.r_[0, np.cumsum(sizes)]].astype(np.int32)
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(sizes.size, pa.py_buffer(offsets), pa.py_buffer(data))


class Held:
    """The distinct n-grams of a block as they come: hashes, what they are of, characters, sizes and counts."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.pending = self.size = 0

    def add(self, keys: np.ndarray, owns: np.ndarray, grams: Grams, order: int) -> None:
        """``keys`` and ``owns`` of each of ``grams``."""
        if not keys.size:
            return
        by_key = np.argsort(keys)
        first = np.flatnonzero(np.r_[True, keys[by_key[1:]] != keys[by_key[:-1]]])
        at = by_key[first]
        self.parts.append((keys[at], owns[at].astype(np.int32), grams.rows(at, order), grams.sizes[at].astype(np.int32), np.diff(np.r_[first, keys.size])))
        self.pending += at.size
        if self.pending > PENDING:
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        columns = list(zip(*self.parts, strict=True))
        self.parts = []
        counts, keys = np.concatenate(columns.pop()), np.concatenate(columns[0])
        by_key = np.argsort(keys)
        first = np.flatnonzero(np.r_[True, keys[by_key[1:]] != keys[by_key[:-1]]])
        at = by_key[first]
        out = [np.add.reduceat(counts[by_key], first)]
        while columns:
            out.append(np.concatenate(columns.pop())[at])
        out = tuple(out[::-1])
        self.parts, self.pending, self.size = [out], 0, at.size
        return out


def units_of(w: Words, lower: bool, whole: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """What is scored as one (texts that have words, with single spaces, or distinct words), and pairs of row and unit."""
    if not whole:
        _, at, back = np.unique(w.hashes(lower), return_index=True, return_inverse=True)
        return distinct_words(w, at, lower), w.row_of_word, back
    rows = np.flatnonzero(w.counts)
    data = w.data.tobytes()
    texts = [b" ".join(data[s:e].split()).decode("utf-8", "replace") for s, e in zip(w.byte_edges[rows].tolist(), w.byte_edges[rows + 1].tolist(), strict=True)]
    return [t.lower() for t in texts] if lower else texts, rows, np.arange(rows.size)


# counting


def word_counts(docs: DataFrame, group: str, text: str, kept: np.ndarray, lower: bool) -> DataFrame:
    """``grp, word, n`` over all texts; null groups and null texts are left out."""
    schema = pa.schema([("grp", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def flush(held):
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)

    def run(batches):
        held: dict[tuple[str, str], int] = {}
        for b in batches:
            groups = b.column(0).dictionary_encode()
            names, codes = groups.dictionary.to_pylist(), groups.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for w in words_of(b.column(1), kept):
                code = codes[w.rows.start : w.rows.stop][w.row_of_word]
                _, at, n = np.unique(w.hashes(lower) + code.astype(np.uint64) * _PLACE_VALUE[99], return_index=True, return_counts=True)
                for word, c, k in zip(distinct_words(w, at, lower), code[at].tolist(), n.tolist(), strict=True):
                    held[names[c], word] = held.get((names[c], word), 0) + k
                if len(held) > HELD_WORDS:
                    yield flush(held)
                    held = {}
        if held:
            yield flush(held)

    rows = docs.select(F.col(f"`{group}`").cast("string").alias("grp"), F.col(f"`{text}`").alias("text")).where("grp is not null and text is not null")
    return rows.mapInArrow(run, "grp string, word string, n long").groupBy("grp", "word").agg(F.sum("n").alias("n"))


def distinct_words(w: Words, at: np.ndarray, lower: bool) -> list[str]:
    """The text of the words at places ``at``."""
    data = w.data.tobytes()
    words = [data[s:e].decode("utf-8", "replace") for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]
    return [x.lower() for x in words] if lower else words


def gram_counts(words: DataFrame, order: int) -> list[DataFrame]:
    """For each length 1..order ``grp, gram, c``: plain counts at the top and at beginnings of words, else distinct left neighbours."""
    framed = words.select("grp", "n", F.concat(F.lit(BEGIN), "word", F.lit(END)).alias("w"))
    ends = framed.select("grp", "n", "w", F.explode(F.sequence(F.lit(2), F.length("w"))).alias("end"))
    start = F.greatest(F.lit(1), F.col("end") - (order - 1))
    top = ends.select("grp", "n", F.substring("w", start, F.col("end") - start + 1).alias("gram"))
    return levels_of(top.groupBy("grp", "gram").agg(F.sum("n").alias("c")), order)


def levels_of(top: DataFrame, order: int) -> list[DataFrame]:
    """The same from ``grp, gram, c`` of the longest n-grams and of the shorter ones at beginnings."""
    level = _step(top, "grams")
    out = []
    for k in range(order, 0, -1):
        whole = F.length("gram") == k
        out.append(level.where(whole))
        if k > 1:
            shorter = level.select("grp", F.when(whole, F.expr("substring(gram, 2)")).otherwise(F.col("gram")).alias("gram"), F.when(whole, 1).otherwise(F.col("c")).alias("c"))
            level = _step(shorter.groupBy("grp", "gram").agg(F.sum("c").alias("c")), "grams")
    return out[::-1]


def _step(df: DataFrame, label: str) -> DataFrame:
    """``materialize``; what its shuffles have on disk goes at once."""
    with shuffles_dropped(df.sparkSession):
        return materialize(df, label)


def delete_steps(spark, paths: list[str]) -> None:
    for path in paths:
        delete_path(spark, path)


def discounts(level: DataFrame, modified: bool) -> DataFrame:
    """``grp, d1, d2, d3`` from how many n-grams were seen once to four times."""
    n1, n2, n3, n4 = (F.sum((F.col("c") == i).cast("double")) for i in (1, 2, 3, 4))
    y = (n1 + 0.5) / (n1 + 2 * n2 + 1.0)  # half a count keeps small samples away from 0 and 1
    d1, d2, d3 = 1 - 2 * y * (n2 + 0.5) / (n1 + 0.5), 2 - 3 * y * (n3 + 0.5) / (n2 + 0.5), 3 - 4 * y * (n4 + 0.5) / (n3 + 0.5)
    if not modified:
        d1 = d2 = d3 = y
    held = lambda d, most: F.greatest(F.lit(0.05), F.least(d, F.lit(most)))
    return level.groupBy("grp").agg(held(d1, 0.95).alias("d1"), held(d2, 1.9).alias("d2"), held(d3, 2.85).alias("d3"))


def probabilities(levels: list[DataFrame], modified: bool) -> DataFrame:
    """``grp, len, kind, gram, weight, c``: ``kind`` 0 has log probabilities of n-grams, 1 log back-off weights of contexts."""
    below, parts = None, []
    for k, level in enumerate(levels, 1):
        d = F.broadcast(discounts(level, modified))  # a row for each group
        level = level.join(d, "grp").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        level = level.withColumn("ctx", F.expr("substring(gram, 1, length(gram) - 1)"))
        ctx = level.groupBy("grp", "ctx").agg(F.sum("c").alias("s"), F.sum("d").alias("taken"), F.count("*").alias("kinds"))
        p = level.join(ctx, ["grp", "ctx"])
        if below is None:
            p = p.withColumn("p", (F.col("c") - F.col("d")) / F.col("s") + F.col("taken") / F.col("s") / (F.col("kinds") + 1))
            ctx = ctx.withColumn("taken", F.col("taken") / (F.col("kinds") + 1))
        else:
            low = below.select("grp", F.col("gram").alias("rest"), F.col("p").alias("q"))
            p = p.withColumn("rest", F.expr("substring(gram, 2)")).join(low, ["grp", "rest"])
            p = p.withColumn("p", (F.col("c") - F.col("d")) / F.col("s") + F.col("taken") / F.col("s") * F.col("q"))
        below = _step(p.select("grp", "gram", "p", "c"), f"probabilities-{k}")
        parts.append(below.select("grp", F.lit(k).alias("len"), F.lit(0).alias("kind"), "gram", F.log("p").alias("weight"), "c"))
        parts.append(ctx.select("grp", F.lit(k).alias("len"), F.lit(1).alias("kind"), F.col("ctx").alias("gram"), F.log(F.col("taken") / F.col("s")).alias("weight"), F.col("s").alias("c")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fitted(levels: list[DataFrame], modified: bool) -> Model:
    with scratch_paths() as steps:
        rows = _step(probabilities(levels, modified).select("grp", "kind", "gram", "weight"), "model")
    delete_steps(rows.sparkSession, steps[:-1])  # all but the model itself
    return Model(sorted(r.grp for r in levels[0].select("grp").distinct().collect()), len(levels), rows)


def train(docs: DataFrame, group: str, text: str, kept: np.ndarray, lower: bool, order: int, modified: bool) -> Model:
    """Count the words of ``docs`` and smooth."""
    with scratch_paths() as steps:
        levels = gram_counts(word_counts(docs, group, text, kept, lower), order)
    model = fitted(levels, modified)
    delete_steps(docs.sparkSession, steps)
    return model


# scoring


@dataclass
class Model:
    """``rows``: ``grp, kind, gram, weight`` as ``probabilities`` has them, all of them, in the shared folder."""

    groups: list[str]
    order: int
    rows: DataFrame

    def counted(self) -> DataFrame:
        """``own, gram, weight`` of the n-grams that ``blocked`` tells of the texts the model was counted over."""
        told = (F.length("gram") == self.order) | F.col("gram").startswith(BEGIN)
        return self.rows.where("kind = 0").where(told).select(F.col("grp").alias("own"), "gram", "weight")

    def weights(self, asked: DataFrame) -> DataFrame:
        """``grp, gram, weight`` for distinct ``grp, gram``: the log probability, by way of shorter n-grams where it must be."""
        known = self.rows.where("kind = 0").select("grp", F.col("gram").alias("rest"), "weight")
        contexts = self.rows.where("kind = 1").select("grp", F.col("gram").alias("ctx"), F.col("weight").alias("back"))
        left = asked.select("grp", "gram", F.col("gram").alias("rest"), F.lit(0.0).alias("total"))
        out = None
        for n in range(self.order, 0, -1):
            looked = _step(left.join(known, ["grp", "rest"], "left"), f"looked-{n}")
            done = looked.where("weight is not null").select("grp", "gram", F.expr("total + weight").alias("weight"))
            out = done if out is None else out.unionByName(done)
            missed = looked.where("weight is null")
            if missed.isEmpty():
                break
            missed = missed.withColumn("ctx", F.expr("substring(rest, 1, length(rest) - 1)")).join(contexts, ["grp", "ctx"], "left")
            missed = _step(missed.select("grp", "gram", F.expr("substring(rest, 2)").alias("rest"), F.expr("total + coalesce(back, 0D)").alias("total")), f"missed-{n}")
            out = out.unionByName(missed.where("rest = ''").select("grp", "gram", F.col("total").alias("weight")))
            left = missed.where("rest <> ''")
        return out

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each of a few words under each group, and its number of characters with the end mark."""
        grams = Grams.of(words, self.order)
        texts = grams.texts(np.arange(grams.ends.size))
        spark = self.rows.sparkSession
        asked = spark.createDataFrame([(g, t) for g in self.groups for t in sorted(set(texts))], "grp string, gram string")
        found = {(r.grp, r.gram): r.weight for r in self.weights(asked).collect()}
        out = np.zeros((len(words), len(self.groups)))
        for k, g in enumerate(self.groups):
            out[:, k] = np.bincount(grams.unit, weights=[found[g, t] for t in texts], minlength=len(words))
        return out, np.bincount(grams.unit, minlength=len(words))


def blocked(docs: DataFrame, text: str, own: str | None, kept: np.ndarray, lower: bool, whole: bool, order: int) -> DataFrame:
    """``docs`` in blocks, written: a row for each document, and one for each distinct n-gram of each block.

    Adds ``__block``; rows of n-grams have ``__gram``, in ``__c`` how often ``units_of`` has it there, in ``__own`` the
    value of column ``own`` of its texts ('' without one), and in ``__key`` the hash of both. Documents have nulls there.
    """
    names = docs.columns
    at_text, at_own = names.index(text), names.index(own) if own else -1
    arrow = pa.schema([("__block", pa.int64()), ("__own", pa.string()), ("__gram", pa.string()), ("__c", pa.int64()), ("__key", pa.int64())])

    def run(batches):
        def told():
            keys, owns, rows, sizes, counts = held.merge()
            by_text = np.lexsort((*rows.T[::-1], owns))  # neighbours begin alike, which compresses
            for i in range(0, keys.size, 100_000):
                at = by_text[i : i + 100_000]
                own = pa.DictionaryArray.from_arrays(pa.array(owns[at]), pa.array(list(known), pa.string())).cast(pa.string())
                new = [pa.array(np.full(at.size, block)), own, gram_texts(rows[at], sizes[at]), pa.array(counts[at].astype(np.int64)), pa.array(keys[at].view(np.int64))]
                yield pa.RecordBatch.from_arrays([*[pa.nulls(at.size, t) for t in kinds], *new], names=[*names, *arrow.names])

        block, size, held, known, kinds = new_block(), 0, Held(), {}, []
        for b in batches:
            kinds = b.schema.types
            for w in words_of(b.column(at_text), kept, TOLD_BYTES):
                part = b.slice(w.rows.start, len(w.rows))
                units, rows, unit = units_of(w, lower, whole)
                grams = Grams.of(units, order)
                owns, keys = [""], grams.hashes
                codes = np.zeros(keys.size, dtype=np.int64)
                if own:
                    groups = part.column(at_own).dictionary_encode()
                    owns = groups.dictionary.to_pylist()
                    of_unit = groups.indices.to_numpy(zero_copy_only=False)[rows].astype(np.int64)
                    codes = of_unit[grams.unit]
                    keys = mix(keys + np.array([_own_value(o) for o in owns], dtype=np.uint64)[codes]) if keys.size else keys
                number = np.array([known.setdefault(o, len(known)) for o in owns], dtype=np.int64)
                held.add(keys, number[codes], grams, order)
                none = [pa.nulls(len(w.rows), t) for t in arrow.types[1:]]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(w.rows), block)), *none], names=[*names, *arrow.names])
                size += w.data.size
                if (size > BLOCK_BYTES or held.size > BLOCK_GRAMS) and held.parts:
                    yield from told()
                    block, size, held, known = new_block(), 0, Held(), {}
        if held.parts:
            yield from told()

    types = ("long", "string", "string", "long", "long")
    out = docs.select(*[F.col(f"`{c}`") for c in names], *[F.lit(None).cast(t).alias(c) for c, t in zip(arrow.names, types, strict=True)])
    schema = out.schema
    for field in schema.fields:
        field.nullable = True
    path = new_scratch(docs.sparkSession, "blocks")
    docs.mapInArrow(run, schema).write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def answers(blocks: DataFrame, model: Model, own: bool) -> str:
    """A folder with a file for each block: the hashes of its n-grams, sorted, and their log probabilities.

    With ``own`` those of the n-gram's own group, else those of all groups of the model in order.
    """
    spark = blocks.sparkSession
    told = blocks.where("__gram is not null").select(F.col("__own").alias("own"), F.col("__gram").alias("gram"))
    with scratch_paths() as steps:
        if own:
            weights = model.weights(told.select(F.col("own").alias("grp"), "gram").distinct()).select(F.col("grp").alias("own"), "gram", "weight")
        else:
            groups = spark.createDataFrame([(g,) for g in model.groups], "grp string")
            each = model.weights(told.select("gram").distinct().crossJoin(F.broadcast(groups)).select("grp", "gram"))
            by_group = F.array_sort(F.collect_list(F.struct("grp", "weight")))
            weights = each.groupBy("gram").agg(F.transform(by_group, lambda x: x["weight"]).alias("weight")).select(F.lit("").alias("own"), "gram", "weight")
        keys = keyed(weights, own, model.order)
    root = filed(blocks, keys)
    delete_steps(spark, steps)
    return root


def keyed(weights: DataFrame, own: bool, order: int) -> DataFrame:
    """``own, gram, weight`` as ``key, weight``, written."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            grams = b.column(1).to_pylist()
            sizes = np.array([len(g) for g in grams], dtype=np.int64)
            hashes = gram_hashes(_letters("".join(grams)), _places(sizes), order)[np.cumsum(sizes) - 1]
            if own:
                groups = b.column(0).dictionary_encode()
                hashes = mix(hashes + np.array([_own_value(o) for o in groups.dictionary.to_pylist()], dtype=np.uint64)[groups.indices.to_numpy()])
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), b.column(2)], names=["key", "weight"])

    kind = weights.schema["weight"].dataType.simpleString()
    return _step(weights.select("own", "gram", "weight").mapInArrow(run, f"key long, weight {kind}"), "weights")


def filed(blocks: DataFrame, weights: DataFrame) -> str:
    """The folder of ``answers`` from the ``keyed`` weights of all n-grams of the blocks."""
    root = new_scratch(blocks.sparkSession, "answers")
    told = blocks.where("__gram is not null").select(F.col("__block").alias("block"), F.col("__key").alias("key"))
    found = told.join(weights, "key").select("block", "key", "weight")

    def run(batches):
        block, keys, values = None, [], []

        def flush():
            flat = np.concatenate(keys)
            at = np.argsort(flat)
            held = io.BytesIO()
            np.savez(held, keys=flat[at], weights=np.concatenate(values)[at])
            with written(f"{root}/{block}") as out:
                out.write(held.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([flat.size], pa.int64())], names=["block", "n"])

        for b in batches:
            numbers = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), numbers.size]
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                if stop == start:
                    continue
                if numbers[start] != block:
                    if keys:
                        yield flush()
                    block, keys, values = int(numbers[start]), [], []
                part = b.slice(start, stop - start)
                column = part.column(2)
                flat = column if pa.types.is_floating(column.type) else column.flatten()
                keys.append(part.column(1).to_numpy().view(np.uint64))
                values.append(flat.to_numpy(zero_copy_only=False).reshape(len(part), -1))
        if keys:
            yield flush()

    _step(found.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, n long"), "answered")
    return root


class Scorer:
    """Log probabilities of the texts of ``blocked`` rows, from the files of ``answers``."""

    def __init__(self, root: str, n_groups: int, kept: np.ndarray, lower: bool, whole: bool, order: int) -> None:
        self.root, self.n_groups, self.kept, self.lower, self.whole, self.order = root, n_groups, kept, lower, whole, order
        self._block: int | None = None

    def _open(self, block: int) -> None:
        if block != self._block:
            with opened(f"{self.root}/{block}") as source:
                held = np.load(io.BytesIO(source.read()))
            self._block, self._keys, self._weights = block, held["keys"], held["weights"]
            bits = self._keys.size.bit_length() + 1  # two to four slots a hash
            self._shift = np.uint64(64 - bits)
            self._first = np.searchsorted(self._keys, np.arange(1 << bits, dtype=np.uint64) << self._shift).astype(np.int32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Where the hashes are among the block's: from the first one with the same leading bits, as they are spread evenly."""
        at = self._first[keys >> self._shift]
        behind = np.arange(keys.size)
        while behind.size:
            behind = behind[self._keys[np.minimum(at[behind], self._keys.size - 1)] < keys[behind]]
            behind = behind[at[behind] < self._keys.size - 1]
            at[behind] += 1
        return np.minimum(at, self._keys.size - 1)

    def __call__(self, batch: pa.RecordBatch, text: int, block: int, own: int | None = None) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray, np.ndarray]]:
        """For each slice of rows of one block: these rows, their words, log probabilities under each group, and characters told."""
        names = batch.column(block).to_pylist()
        edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(start, stop - start)
            for w in words_of(part.column(text), self.kept, TOLD_BYTES):
                rows = part.slice(w.rows.start, len(w.rows))
                units, row, unit = units_of(w, self.lower, self.whole)
                grams, n = Grams.of(units, self.order), len(w.rows)
                length = np.bincount(grams.unit, minlength=len(units))
                chars = np.bincount(row, weights=length[unit], minlength=n).astype(np.int64)
                scores = np.zeros((n, self.n_groups))
                if grams.hashes.size and self.n_groups:
                    self._open(names[start])
                    keys = grams.hashes
                    if own is not None:
                        groups = rows.column(own).dictionary_encode()
                        values = np.array([_own_value(o) for o in groups.dictionary.to_pylist()], dtype=np.uint64)
                        keys = mix(keys + values[groups.indices.to_numpy()][row][grams.unit])
                    at = self._find(keys)
                    if not np.array_equal(self._keys[at], keys):
                        raise RuntimeError(f"block {names[start]} lacks n-grams of its texts")
                    for g in range(self.n_groups):
                        of_unit = np.bincount(grams.unit, weights=self._weights[at, g], minlength=len(units))
                        scores[:, g] = np.bincount(row, weights=of_unit[unit], minlength=n)
                yield rows, w, scores, chars
