"""Byte-level BPE, encoded by speculation: guess with the longest match, verify, and merge only what fails.

A word (one piece of the split pattern) is first cut greedily into the longest tokens. Such a cut is
the one that merging would give exactly when no merge could act across any two neighbours: for every
pair, undoing the two tokens step by step in the order of the merges never meets a merge that would
have been applied earlier. All distinct pairs of a slice of text are tested at once with arrays. Only
words with a failing pair go through merging proper.

A slice of about a megabyte is cut, hashed and reduced to its distinct words with arrays; words met
before are looked up in sorted hash arrays. Texts are decoded again from their ids and compared, so a
clash of hashes cannot go unnoticed.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.words import KnownWords, byte_sums, slices, stretch_hashes, text_bytes

#: Fixed: white space as the split pattern means it (the White_Space property).
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_LETTER, _NUMBER, _OTHER, _WHITE = 0, 1, 2, 3


def char_classes() -> np.ndarray:
    """Letter, number, other or white space, for each code point."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)], dtype=np.uint8)
    table[list(WHITE)] = _WHITE
    return table


def piece_starts(points: np.ndarray, text_starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the split pattern begins a piece, in texts laid end to end (as marks, one for each code point).

    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?O+|white+(?!\\S)|white+`` for letters, numbers and others.
    """
    n = points.size
    kind = classes[points]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[text_starts] = True
    fresh[n] = True
    begin = fresh[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    white = kind == _WHITE
    # the last of a run of white space before other characters stands apart, or belongs to what follows
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~fresh[1:n]) if n > 1 else np.zeros(0, dtype=np.int64)
    begin[last] = True
    begin[last[points[last] == 0x20] + 1] = False
    # an apostrophe that begins a piece takes certain letters with it
    quote = np.flatnonzero((points == 0x27) & begin)
    after = np.full(n + 3, 0, dtype=points.dtype)
    after[:n] = points
    inside = lambda at: (at < n) & ~fresh[np.minimum(at, n)]
    one, two = after[quote + 1], after[quote + 2]
    single = np.isin(one, [ord(c) for c in "stmd"]) & inside(quote + 1)
    double = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & inside(quote + 1) & inside(quote + 2)
    for taken, size in ((single, 2), (double, 3)):
        at = quote[taken]
        for k in range(1, size):
            begin[at + k] = False
        ends = at + size
        begin[ends[ends < n]] = True
    return begin


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder for a byte-level vocabulary with merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        as_bytes = {t: bytes(letters[c] for c in t) for t in vocab}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.id_of = {as_bytes[t]: i for t, i in vocab.items()}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for t, i in vocab.items():
            self.bytes_of[i] = as_bytes[t]
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.text_of = [str(i) for i in range(size)]
        # step[t]: when token t comes to be; a single byte is there from the start
        self.step = np.full(size, -1, dtype=np.int64)
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole = self.id_of[as_bytes[a] + as_bytes[b]]
            self.merge[vocab[a], vocab[b]] = (k, whole)
            if self.step[whole] < 0:
                self.step[whole], self.left[whole], self.right[whole] = k, vocab[a], vocab[b]
        keys = np.array([a * size + b for a, b in self.merge], dtype=np.int64)
        order = np.argsort(keys)
        self._size = size
        self._pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self._pair_steps = np.append(np.array([k for k, _ in self.merge.values()], dtype=np.int64)[order], 1 << 60)
        self._whole = np.array([w for _, w in self.merge.values()], dtype=np.int64)
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self._table = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self._offsets = np.cumsum(self.lengths) - self.lengths
        self._special = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self._classes = char_classes()
        self._token_ids = np.array(sorted(self.id_of.values()), dtype=np.int64)
        names = [self.bytes_of[i] for i in self._token_ids.tolist()]
        sizes = self.lengths[self._token_ids]
        data = np.frombuffer(b"".join(names), dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        hashes = stretch_hashes(byte_sums(data), starts, starts + sizes)
        order = np.argsort(hashes)
        self._token_hashes, self._token_ids = hashes[order], self._token_ids[order]
        self._sizes = np.unique(sizes)[::-1].tolist()
        self._marks = {n: np.zeros(1 << 18, dtype=bool) for n in self._sizes}
        self._longest_from = np.ones(1 << 16, dtype=np.int64)  # longest token by its first two bytes
        for n in self._sizes:
            self._marks[n][(hashes[sizes == n] >> np.uint64(46)).astype(np.int64)] = True
        for name in names:
            if len(name) > 1:
                k = name[0] << 8 | name[1]
                self._longest_from[k] = max(self._longest_from[k], len(name))
        self._one = np.array([self.id_of[bytes([b])] for b in range(256)], dtype=np.int64)
        self._known = KnownWords()

    # encoding

    def guess(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens by the longest match from the left, for stretches that cover ``data``: all ids, and how many each has."""
        sums = byte_sums(data)
        left = np.repeat(ends, ends - starts) - np.arange(data.size)
        pair = data.astype(np.int64) << 8
        pair[:-1] |= data[1:]
        reach = np.where(left > 1, np.minimum(left, self._longest_from[pair]), 1)
        token, size = self._one[data], np.ones(data.size, dtype=np.int64)
        open_ = np.flatnonzero(reach > 1)
        reach = reach[open_]
        for n in self._sizes:
            if n == 1 or not open_.size:
                break
            able = reach >= n
            at = open_[able]
            if not at.size:
                continue
            hashes = stretch_hashes(sums, at, at + n)
            maybe = np.flatnonzero(self._marks[n][(hashes >> np.uint64(46)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self._token_hashes, hashes[maybe]), self._token_hashes.size - 1)
            found = self._token_hashes[place] == hashes[maybe]
            hit = at[maybe[found]]
            token[hit], size[hit] = self._token_ids[place[found]], n
            done = np.flatnonzero(able)[maybe[found]]
            keep = np.ones(open_.size, dtype=bool)
            keep[done] = False
            open_, reach = open_[keep], reach[keep]
        cut = np.zeros(data.size, dtype=bool)
        at, stop = starts, ends
        while at.size:
            cut[at] = True
            at = at + size[at]
            more = at < stop
            at, stop = at[more], stop[more]
        counts = np.add.reduceat(cut, starts) if starts.size else np.zeros(0, dtype=np.int64)
        return token[cut], counts

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging their joined bytes gives these two again.

        The later of the two tokens is undone into its halves, and the half at the seam takes its
        place. A merge across the seam counts if it comes before everything undone so far.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(a.size, dtype=bool)
        open_, limit = np.arange(a.size), np.full(a.size, 1 << 59, dtype=np.int64)
        strict = np.ones(a.size, dtype=bool)  # the seam merge must come strictly before the limit
        while open_.size:
            keys = a * self._size + b
            at = np.searchsorted(self._pair_keys, keys)
            step = np.where(self._pair_keys[at] == keys, self._pair_steps[at], 1 << 60)
            clash = (step < limit) | (~strict & (step == limit))
            good[open_[clash]] = False
            sa, sb = self.step[a], self.step[b]
            undo_a = sa > sb  # of two equal merges the left one is made first, so the right one is undone first
            limit = np.where(undo_a, sa, sb)
            # before merge `limit` made the left token, a seam merge of a lower step wins; one of the same
            # step further left wins only over the right token
            strict = undo_a
            ended = (sa < 0) & (sb < 0)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            go = ~(clash | ended)
            open_, a, b, limit, strict = open_[go], a[go], b[go], limit[go], strict[go]
        return good

    def merged(self, piece: bytes) -> list[int]:
        """Tokens by applying the earliest merge, leftmost first, until none applies."""
        ids = [self.id_of[piece[i : i + 1]] for i in range(len(piece))]
        if len(ids) > 64:
            return self._merged_long(ids)
        while len(ids) > 1:
            best = min((self.merge.get(p, (1 << 60, -1)) for p in zip(ids, ids[1:], strict=False)))
            if best[1] < 0:
                break
            ids = self._join(ids, best)
        return ids

    def _join(self, ids: list[int], best: tuple[int, int]) -> list[int]:
        out, i = [], 0
        while i < len(ids):
            if i + 1 < len(ids) and self.merge.get((ids[i], ids[i + 1])) == best:
                out.append(best[1])
                i += 2
            else:
                out.append(ids[i])
                i += 1
        return out

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a queue of pairs over a linked list, for very long pieces."""
        import heapq

        after = list(range(1, len(ids) + 1))
        before = list(range(-1, len(ids) - 1))
        queue = [(*self.merge[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merge]
        heapq.heapify(queue)
        while queue:
            step, whole, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or self.merge.get((ids[i], ids[j])) != (step, whole):
                continue
            ids[i], ids[j], after[i] = whole, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(ids) and (m := self.merge.get((ids[x], ids[y]))):
                    heapq.heappush(queue, (*m, x))
        return [t for t in ids if t >= 0]

    def merged_many(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Merging proper for many short pieces at once: one row each, one merge a row and round."""
        width = int(sizes.max())
        place = np.minimum(starts[:, None] + np.arange(width), data.size - 1)
        ids = np.where(np.arange(width) < sizes[:, None], self._one[data[place]], -1)
        out, rows = np.full_like(ids, -1), np.arange(starts.size)
        while rows.size:
            keys = np.where(ids[:, 1:] >= 0, ids[:, :-1] * self._size + ids[:, 1:], -1)
            at = np.searchsorted(self._pair_keys, keys)
            step = np.where(self._pair_keys[at] == keys, self._pair_steps[at], 1 << 60)
            first = step.argmin(axis=1) if step.shape[1] else np.zeros(rows.size, dtype=np.int64)
            best = step[np.arange(rows.size), first] if step.shape[1] else np.full(rows.size, 1 << 60)
            go = best < 1 << 60
            out[rows[~go], : ids.shape[1]] = ids[~go]
            rows, ids, first, best = rows[go], ids[go], first[go], best[go]
            if not rows.size:
                break
            ids[np.arange(rows.size), first] = self._whole[best]
            later = np.arange(ids.shape[1] - 1) > first[:, None]
            ids = np.where(later, ids[:, 1:], ids[:, :-1])
        return out

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Guess all, test every neighbouring pair at once, and merge where a test failed: all ids, and how many each has."""
        flat, counts = self.guess(data, starts, ends)
        word = np.repeat(np.arange(counts.size), counts)
        inner = np.flatnonzero(word[:-1] == word[1:])
        if not inner.size:
            return flat, counts
        pairs, which = np.unique(flat[inner] * self._size + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self._size, pairs % self._size)
        failed = np.zeros(counts.size, dtype=bool)
        failed[word[inner[~good[which]]]] = True
        again = np.flatnonzero(failed)
        if not again.size:
            return flat, counts
        sizes = ends - starts
        short = again[sizes[again] <= 32]
        short = short[np.argsort(sizes[short], kind="stable")]
        ids, owner = [flat[~failed[word]]], [word[~failed[word]]]
        for at in range(0, short.size, 4096):
            block = short[at : at + 4096]
            merged = self.merged_many(data, starts[block], sizes[block])
            told = merged >= 0
            ids.append(merged[told])
            owner.append(np.repeat(block, told.sum(axis=1)))
        for k in again[sizes[again] > 32].tolist():
            merged = self.merged(data[starts[k] : ends[k]].tobytes())
            ids.append(np.array(merged, dtype=np.int64))
            owner.append(np.full(len(merged), k))
        owner_all = np.concatenate(owner)
        order = np.argsort(owner_all, kind="stable")
        return np.concatenate(ids)[order], np.bincount(owner_all, minlength=counts.size)

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of texts in which no special token stands."""
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, dtype=np.int32) for _ in texts]
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        edges = np.r_[0, np.cumsum(sizes)]
        begin = np.flatnonzero(piece_starts(points, edges[:-1][sizes > 0], self._classes))
        byte_of = np.r_[0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))]
        data = np.frombuffer(joined.encode(), dtype=np.uint8)
        starts, ends = byte_of[begin], np.r_[byte_of[begin[1:]], data.size]
        flat, counts = self._known.ids(data, starts, ends, self.encode_pieces)
        told = np.r_[0, np.cumsum(counts)][np.searchsorted(begin, edges)]
        if self.decode_bytes(flat) != data.tobytes():
            raise ValueError("two words have the same hash")
        return [flat[a:b] for a, b in zip(told[:-1].tolist(), told[1:].tolist(), strict=True)]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        marked = [k for k, t in enumerate(texts) if self._special.search(t)] if self.special else []
        if not marked:
            return self._encode_plain(texts)
        parts: list[str] = []
        made: list[list] = []
        for t in texts:
            at, own = 0, []
            for m in self._special.finditer(t):
                own += [len(parts), np.array([self.special[m[0]]], dtype=np.int32)]
                parts.append(t[at : m.start()])
                at = m.end()
            own.append(len(parts))
            parts.append(t[at:])
            made.append(own)
        ids = self._encode_plain(parts)
        return [np.concatenate([ids[x] if isinstance(x, int) else x for x in own]) for own in made]

    # decoding

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens, one after the other."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not ends.size:
            return b""
        at = np.arange(ends[-1]) + np.repeat(self._offsets[ids] - (ends - n), n)
        return self._table[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    """One encoder for each worker and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def _texts(column: pa.Array) -> Iterator[list[str]]:
    _, offsets = text_bytes(column)
    for rows in slices(offsets):
        yield [t or "" for t in column.slice(rows.start, len(rows)).to_pylist()]


def encode(docs: DataFrame, text: str, path: str, ids: str = "ids") -> DataFrame:
    """``docs`` without ``text``, and with the token ids of each text as ``array<int>``.

    Null and empty text have no ids. All other columns and repeated rows stay.
    """
    rest = docs.drop(text).drop(ids)
    cols = [c for c in rest.columns]

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            parts = [x for t in _texts(b.column(len(cols))) for x in bpe.encode_batch(t)]
            sizes = np.cumsum([0, *map(len, parts)])
            flat = np.concatenate([np.zeros(0, dtype="<i4"), *parts])
            done = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(cols))), done], names=[*cols, ids])

    schema = rest.select(*cols).withColumn(ids, F.lit(None).cast("array<int>")).schema
    return docs.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, path: str, text: str = "text") -> DataFrame:
    """``df`` without ``ids``, and with the text that the ids stand for; broken UTF-8 becomes U+FFFD. Null ids are none."""
    cols = [c for c in df.columns if c not in (ids, text)]

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            rows = b.column(len(cols)).to_pylist()
            done = pa.array([bpe.decode(np.array(r or [], dtype=np.int64)) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(cols))), done], names=[*cols, text])

    schema = df.select(*cols).withColumn(text, F.lit(None).cast("string")).schema
    return df.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{ids}`").alias("__ids")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    ``ids_sha256`` is over decimal ids joined by commas. Null text counts as empty; null keys and
    repeated rows stay as they are; other columns are not read.
    """

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            row = 0
            for texts in _texts(b.column(1)):
                n, ids_sha, text_sha = [], [], []
                for ids in bpe.encode_batch(texts):
                    n.append(ids.size)
                    ids_sha.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids.tolist())).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, len(n)), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                row += len(n)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op10_bpe": op10_bpe}
ORACLE: dict[str, str] = {}
