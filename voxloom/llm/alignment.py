"""Alignment of two tokenizers over the same bytes.

Texts are cut before a blank or line end that stands alone between two other characters; no token of
either tokenizer reaches over such a cut, so every distinct unit between cuts is encoded once. In a unit
the libraries' own spans are the coarse cuts: character offsets of one, spans of the other's sentence
protocol. Where a span is only part of a character (tokens that share a multibyte character, pieces that
fall back to bytes) the decoded bytes of the tokens refine it. Byte offsets where both end cut the tokens
into groups, and all pairs in a group are links.

Blocks of documents are kept as unit numbers in the shared folder. Counts of pairs go through one shuffle
of a row per pair and block, and come back to the blocks; texts are read once and never shuffled.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.blocks import by_keys, load_block, new_block, save_block
from voxloom.llm.words import slices
from voxloom.session import materialize, new_scratch

#: A cut is before a blank or line end between two characters that are not white space.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: A unit that may stand between two others without changing their tokens, or its own.
_PLAIN = re.compile(r"[ \n][^\s▁](?:[^▁]*[^\s▁])?", re.DOTALL)
#: Characters of a block, units a worker remembers, units encoded at once, and pairs counted at once.
BLOCK = 4 << 20
KNOWN = 400_000
TOGETHER = 4096
AT_ONCE = 1 << 20
#: Tasks of a step, however many blocks there are.
MOST_TASKS = 10_000
#: A pair is one number: the second id in so many low bits, the first id above them.
_LOW = 32


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others, in order, have the characters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def refined(coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
    """Byte ends of tokens: the coarse cuts, and inside a character the decoded bytes.

    ``coarse`` are the byte ends that the library gives. Tokens that are parts of one character have the same
    one (or none of their own); they end where their bytes do. None when another token ends elsewhere.
    """
    ends = np.cumsum(sizes)
    part = np.zeros(coarse.size, dtype=bool)
    part[:-1] = coarse[1:] <= coarse[:-1]
    part[1:] |= part[:-1]
    out = np.where(part, ends, coarse)
    return out if np.array_equal(out, ends) else None


class Aligner:
    """Units that were met: tokens of both sides, groups and links. ``None`` where the bytes differ."""

    def __init__(self, byte_vocabulary: str, piece_model: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.bpe = Tokenizer.from_file(byte_vocabulary)
        self.bpe.no_truncation()
        self.bpe.no_padding()
        self.bpe.encode_special_tokens = True
        self.pieces = SentencePieceProcessor(model_file=piece_model)
        values = byte_values()
        self.bytes_a = [b""] * self.bpe.get_vocab_size(with_added_tokens=True)
        for token, i in self.bpe.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
        self.bytes_b = []
        for i in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode())
        self.blank = self.pieces.piece_to_id("▁")
        self.size_a, self.size_b = (np.array([len(t) for t in table], dtype=np.int64) for table in (self.bytes_a, self.bytes_b))
        self.digits = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = {name: array("q") for name in ("n_a", "n_b", "n_groups", "n_links", "sound")}
        self.links = array("q")
        self.all_sound = True

    def keep(self, used: np.ndarray) -> None:
        """Forget all units but these; they get new numbers, in their order."""
        every = np.frombuffer(self.sizes["n_links"], dtype=np.int64)
        links = np.frombuffer(self.links, dtype=np.int64)[_flat((np.cumsum(every) - every)[used], every[used])]
        sizes = {name: np.frombuffer(values, dtype=np.int64)[used] for name, values in self.sizes.items()}
        units, groups = list(self.number), self.groups  # units were numbered in the order of the dictionary
        kept = used.tolist()
        self.forget()
        self.number = {units[u]: i for i, u in enumerate(kept)}
        self.groups = [groups[u] for u in kept]
        self.links.frombytes(links.tobytes())
        for name, values in sizes.items():
            self.sizes[name].frombytes(values.tobytes())
        self.all_sound = bool(sizes["sound"].all())

    def learn(self, units: list[str]) -> None:
        """Encode units that were not met before, plain ones many at a time."""
        plain, other = [], []
        for u in units:
            (plain if _PLAIN.fullmatch(u) else other).append(u)
        for a in range(0, len(plain), TOGETHER):
            own = plain[a : a + TOGETHER]
            if not self._learn_together(own):
                other += own
        for u in other:
            self._learn_one(u)

    def _learn_together(self, units: list[str]) -> bool:
        """Encode units as one text behind a full stop; False when a cut does not hold (nothing is kept then)."""
        text = " ." + "".join(units)
        data = text.encode()
        a = self.bpe.encode(text, add_special_tokens=False)
        pieces = self.pieces.encode(text[1:], return_type="proto").pieces
        list_a, list_b = a.ids, [p.id for p in pieces]
        if b"".join([self.bytes_a[i] for i in list_a]) != data or b"".join([self.bytes_b[i] for i in list_b]) != data:
            return False
        ids_a, ids_b = np.array(list_a, dtype=np.int64), np.array(list_b, dtype=np.int64)
        cuts_a, cuts_b = np.array([e for _, e in a.offsets], dtype=np.int64), np.array([p.end for p in pieces], dtype=np.int64) + 1
        if len(data) != len(text):
            raw = np.frombuffer(data, dtype=np.uint8)
            cuts_a = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(data))[cuts_a]
        ends_a, ends_b = refined(cuts_a, self.size_a[ids_a]), refined(cuts_b, self.size_b[ids_b])
        sizes = [len(u) for u in units] if len(data) == len(text) else [len(u.encode()) for u in units]
        edges = 2 + np.concatenate([[0], np.cumsum(sizes)])
        if ends_a is None or ends_b is None:
            return False
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        unit_edge = np.searchsorted(common, edges)
        if unit_edge[-1] >= common.size or not np.array_equal(common[unit_edge], edges):
            return False
        # Groups are numbered by their ends; the full stop is what lies before the first edge.
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        first_a, first_b = (np.searchsorted(g, np.arange(common.size + 1)) for g in (group_a, group_b))
        n_a, n_b = np.diff(first_a), np.diff(first_b)
        # Ids in words, each with the mark that follows it; a slice is then the text of a group or a unit.
        marks_a, marks_b = np.full(ids_a.size, ","), np.full(ids_b.size, ",")
        marks_a[first_a[1:] - 1], marks_b[first_b[1:] - 1] = "|", ";"
        said_a, said_b = ([self.digits[i] + m for i, m in zip(ids, marks.tolist(), strict=True)] for ids, marks in ((list_a, marks_a), (list_b, marks_b)))
        at_a, at_b = first_a.tolist(), first_b.tolist()
        own = n_b[group_a]
        pairs = (np.repeat(ids_a, own) << _LOW) | ids_b[_flat(first_b[:-1][group_a], own)]
        made = np.concatenate([[0], np.cumsum(n_a * n_b)])
        lo, hi = unit_edge[:-1] + 1, unit_edge[1:] + 1
        self.links.frombytes(pairs[made[lo[0]] : made[hi[-1]]].tobytes())
        found = {"n_a": first_a[hi] - first_a[lo], "n_b": first_b[hi] - first_b[lo], "n_groups": hi - lo, "n_links": made[hi] - made[lo], "sound": np.ones_like(hi)}
        for name, values in found.items():
            self.sizes[name].frombytes(values.astype(np.int64).tobytes())
        for u, x, y in zip(units, lo.tolist(), hi.tolist(), strict=True):
            self.number[u] = len(self.groups)
            parts = []
            for g in range(x, y):
                parts += said_a[at_a[g] : at_a[g + 1]]
                parts += said_b[at_b[g] : at_b[g + 1]]
            self.groups.append("".join(parts)[:-1])
        return True

    def _learn_one(self, unit: str) -> None:
        a = self.bpe.encode(unit, add_special_tokens=False)
        # The model puts a blank before what it is given; a unit that starts with a line end drops that.
        own = unit[0] == "\n"
        proto = self.pieces.encode(unit if own else unit[1:], return_type="proto").pieces
        ids_b = [p.id for p in proto]
        cuts, good = [p.end + (not own) for p in proto], True
        if own:
            ids_b, cuts, good = ids_b[1:], cuts[1:], bool(ids_b) and ids_b[0] == self.blank
        whole = unit.encode()
        byte_of = np.cumsum([0, *[len(c.encode()) for c in unit]])
        ends = []
        for coarse, ids, table in ((byte_of[[e for _, e in a.offsets]], a.ids, self.bytes_a), (np.array(cuts, dtype=np.int64), ids_b, self.bytes_b)):
            sound = b"".join([table[i] for i in ids]) == whole
            fine = refined(coarse, np.array([len(table[i]) for i in ids], dtype=np.int64)) if sound else None
            ends.append(None if fine is None else fine.tolist())
        self._add(unit, a.ids, ends[0], ids_b, ends[1] if good else None)

    def _add(self, unit: str, ids_a: list[int], ends_a: list[int] | None, ids_b: list[int], ends_b: list[int] | None) -> None:
        self.number[unit] = len(self.groups)
        sizes = dict.fromkeys(self.sizes, 0)
        said = []
        if ends_a is not None and ends_b is not None:
            i = j = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                x, y = i, j
                while i < len(ends_a) and ends_a[i] <= end:
                    i += 1
                while j < len(ends_b) and ends_b[j] <= end:
                    j += 1
                said.append(",".join(map(str, ids_a[x:i])) + "|" + ",".join(map(str, ids_b[y:j])))
                self.links.extend((p << _LOW) | q for p in ids_a[x:i] for q in ids_b[y:j])
                sizes["n_links"] += (i - x) * (j - y)
            sizes |= {"n_a": len(ids_a), "n_b": len(ids_b), "n_groups": len(said), "sound": 1}
        for name, value in sizes.items():
            self.sizes[name].append(value)
        self.all_sound &= bool(sizes["sound"])
        self.groups.append(";".join(said))

    def units(self, texts: list[str]) -> list[list[int]]:
        """Numbers of the units of a blank and each text; an empty text has none."""
        parts = [_CUT.split(" " + t) if t else [] for t in texts]
        new = [u for u in set().union(*parts) if u not in self.number]
        if new:
            self.learn(new)
        return [list(map(self.number.__getitem__, own)) for own in parts]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(byte_vocabulary: str, piece_model: str) -> Aligner:
    """One per worker process, and only the last pair of vocabularies."""
    key = (byte_vocabulary, piece_model)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def _flat(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first, first + 1, ..`` of ``n`` numbers for every row."""
    stop = np.cumsum(n)
    return np.arange(int(stop[-1]) if n.size else 0) + np.repeat(first - (stop - n), n)


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if ordered.size else ordered


def _documents_with(pairs_of: tuple[np.ndarray, np.ndarray, np.ndarray], n_pairs: int, docs: np.ndarray, units: np.ndarray) -> np.ndarray:
    """In how many documents each pair is, from the distinct (document, unit) rows, some documents at a time."""
    first, n, pair = pairs_of
    found = np.zeros(n_pairs, dtype=np.int64)
    made = np.concatenate([[0], np.cumsum(n[units])])
    a = 0
    while a < units.size:
        b = max(a + 1, int(np.searchsorted(made, made[a] + AT_ONCE, "right")) - 1)
        if b < units.size:  # whole documents only
            b = int(np.searchsorted(docs, docs[b], "left")) if docs[b] != docs[a] else int(np.searchsorted(docs, docs[a], "right"))
        own = units[a:b]
        both = np.repeat(docs[a:b] - docs[a], n[own]) * n_pairs + pair[_flat(first[own], n[own])]
        found += np.bincount(_distinct(both) % n_pairs, minlength=n_pairs)
        a = b
    return found


def _kept_blocks(folder: str, byte_vocabulary: str, piece_model: str):
    """Texts into blocks of unit numbers; a row for every pair of each block says in how many documents it is."""
    schema = pa.schema([("block", pa.int64()), ("pair", pa.int64()), ("n", pa.int64())])

    def flush(known: Aligner, keys: list, docs: list[list[int]], digests: list[str]) -> Iterator[pa.RecordBatch]:
        count = np.array([len(d) for d in docs], dtype=np.int64)
        used, unit = np.unique(np.fromiter(chain.from_iterable(docs), np.int64, int(count.sum())), return_inverse=True)
        sizes = {name: np.frombuffer(values, dtype=np.int64)[used] if values else np.zeros(0, dtype=np.int64) for name, values in known.sizes.items()}
        every = np.frombuffer(known.sizes["n_links"], dtype=np.int64) if used.size else np.zeros(0, dtype=np.int64)
        first = (np.cumsum(every) - every)[used]
        n = sizes["n_links"]
        pairs, link = np.unique(np.frombuffer(known.links, dtype=np.int64)[_flat(first, n)] if n.sum() else np.zeros(0, dtype=np.int64), return_inverse=True)
        row = _distinct(np.repeat(np.arange(count.size), count) * max(1, used.size) + unit)
        of_unit = (np.cumsum(n) - n, n, link)
        held = _documents_with(of_unit, pairs.size, row // max(1, used.size), row % max(1, used.size))
        block = new_block()
        valid = np.array([k is not None for k in keys], dtype=np.uint8)
        save_block(
            folder, block, key=np.array([k or 0 for k in keys], dtype=np.int64), known=valid, count=count.astype(np.int32), unit=unit.astype(np.int32),
            pairs=pairs, link=link.astype(np.int32), digest=np.frombuffer("".join(digests).encode(), dtype=np.uint8), told=np.array([len(d) for d in digests], dtype=np.int32),
            **{name: values.astype(np.int32) for name, values in sizes.items()},
        )
        pairs, held = np.append(pairs, -1), np.append(held, 0)  # a block without a pair comes back as well
        for a in range(0, pairs.size, AT_ONCE):
            own = pairs[a : a + AT_ONCE]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(own.size, block)), pa.array(own), pa.array(held[a : a + AT_ONCE])], schema=schema)

    def run(batches):
        known = _aligner(byte_vocabulary, piece_model)
        keys, docs, digests, total = [], [], [], 0
        for batch in batches:
            own_keys, column = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.array(pc.fill_null(pc.utf8_length(column), 0), dtype=np.int64)
            for rows in slices(np.concatenate([[0], np.cumsum(sizes + 64)]), BLOCK // 4):
                found = known.units([t or "" for t in column.slice(rows.start, len(rows)).to_pylist()])
                sound, said = known.sizes["sound"], known.groups
                for own in found:
                    own = own if known.all_sound or all(map(sound.__getitem__, own)) else []
                    digests.append(hashlib.sha256(";".join(map(said.__getitem__, own)).encode()).hexdigest() if own else "")
                    docs.append(own)
                keys += own_keys[rows.start : rows.stop]
                total += int(sizes[rows.start : rows.stop].sum()) + 64 * len(rows)
                if total >= BLOCK:
                    yield from flush(known, keys, docs, digests)
                    if len(known.groups) > KNOWN:
                        known.keep(_distinct(np.fromiter(chain.from_iterable(docs), np.int64)))
                    keys, docs, digests, total = [], [], [], 0
        if keys:
            yield from flush(known, keys, docs, digests)

    return run


def _scored(folder: str):
    """Open every block beside the counts of its pairs: a row per document."""
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in names), ("groups_sha256", pa.string())])

    def run(batches):
        for (block,), rows in by_keys(batches, ["block"]):
            key, valid, count, unit, pairs, link, digest, told = load_block(folder, block, "key", "known", "count", "unit", "pairs", "link", "digest", "told")
            sizes = load_block(folder, block, "n_a", "n_b", "n_groups", "n_links")
            pair, all_, best = (np.array(rows.column(c).combine_chunks()) for c in ("pair", "documents", "best"))
            order = np.argsort(pair)
            place = order[np.searchsorted(pair[order], pairs)] if pairs.size else np.zeros(0, dtype=np.int64)
            if not np.array_equal(pair[place], pairs):
                raise ValueError(f"counts of block {block} are incomplete")
            n = sizes[3].astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(n)])
            per_unit = [s.astype(np.int64) for s in sizes]
            for values in (best.astype(np.int64), all_):
                sums = np.concatenate([[0], np.cumsum(values[place][link])])
                per_unit.append(sums[edges[1:]] - sums[edges[:-1]])
            ends = np.concatenate([[0], np.cumsum(count.astype(np.int64))])
            columns = []
            for values in per_unit:
                sums = np.concatenate([[0], np.cumsum(values[unit])]) if unit.size else np.zeros(1, dtype=np.int64)
                columns.append(sums[ends[1:]] - sums[ends[:-1]])
            text, at = digest.tobytes().decode(), np.concatenate([[0], np.cumsum(told)]).tolist()
            hashes = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
            for a in range(0, key.size, 10_000):
                own = slice(a, a + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[own], mask=valid[own] == 0), *(pa.array(c[own]) for c in columns), pa.array(hashes[own], pa.string())], schema=schema
                )

    return run


def aligned(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> tuple[DataFrame, DataFrame]:
    """``(documents, links)``: one row per row of ``docs`` (``doc_id`` long, ``text``), and all pairs of ids.

    ``links`` has ``a, b, documents`` (how many hold the pair linked) and ``best`` (no pair of ``a`` has
    more). A document's counts are of tokens, groups and links, of links that are ``best``, and the sum of
    ``documents`` over its links. A text that is null or empty, or that either tokenizer does not spell as
    a blank and the text, has no tokens: zeros, and no digest. Rows that repeat a ``doc_id`` or have none
    are documents of their own; a table without rows gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = new_scratch(spark, "aligned-blocks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(texts.mapInArrow(_kept_blocks(folder, byte_vocabulary, piece_model), "block long, pair long, n long"), "aligned-pairs")
    n_blocks = rows.where("pair < 0").count()
    # A pair has a row per block at most, so the commonest pair is no more rows than there are blocks.
    counted = rows.where("pair >= 0").select("block", "pair", F.sum("n").over(Window.partitionBy("pair")).alias("documents"))
    counted = materialize(counted, "aligned-counts")
    pairs = counted.groupBy("pair").agg(F.first("documents").alias("documents")).withColumn("a", F.shiftright("pair", _LOW))
    most = counted.groupBy(F.shiftright("pair", _LOW).alias("a")).agg(F.max("documents").alias("most"))
    most = F.broadcast(most)  # a row per id of the first vocabulary at most
    links = pairs.join(most, "a").select(
        F.col("a").cast("long").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << _LOW) - 1)).alias("b"), "documents", (F.col("documents") == F.col("most")).alias("best")
    )
    back = counted.withColumn("a", F.shiftright("pair", _LOW)).join(most, "a")
    back = back.select("block", "pair", "documents", (F.col("documents") == F.col("most")).cast("int").alias("best"))
    listed = rows.where("pair < 0").select("block", "pair", F.lit(0).cast("long").alias("documents"), F.lit(0).alias("best"))
    n_tasks = max(1, min(MOST_TASKS, n_blocks))
    beside = back.unionByName(listed).repartition(n_tasks, "block").sortWithinPartitions("block")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return beside.mapInArrow(_scored(folder), out), links


def op11_align(spark, sf_dir: str, byte_vocabulary: str | None = None, piece_model: str | None = None) -> DataFrame:
    """Every document's groups and links between the two public vocabularies."""
    byte_vocabulary = byte_vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    piece_model = piece_model or public_tokenizers.path("piece_bpe_32k.model")
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_vocabulary, piece_model)[0]


QUERIES = {"op11_align": op11_align}
ORACLE: dict[str, str] = {}
