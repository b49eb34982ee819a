"""Words of whole texts as numpy arrays: where they lie, and 64-bit hashes of words and word windows.

A batch of texts is handled in slices of about a megabyte, so memory does not depend on the size
of a batch; a text is never cut. Hashes are the same on every worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _byte_class(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: Bytes of words that white space (space, and tab to carriage return) separates.
SPACED = _byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words made of ASCII letters and digits and of everything beyond ASCII.
ALPHANUMERIC = _byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as texts ask for them."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while self.up.size < n:
            size = self.up.size
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                have = getattr(self, name)
                setattr(self, name, np.concatenate([have, have * np.uint64(pow(base, size, 1 << 64))]))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any stretch of ``data`` follows."""
    sums = np.zeros(data.size + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _POWERS.upto(data.size + 1)[0][:-1], out=sums[1:])
    return sums


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each stretch of bytes."""
    return mix((sums[ends] - sums[starts]) * _POWERS.upto(sums.size)[1][starts])


class KnownWords:
    """Token ids of words met before, in sorted hash arrays (some 40 bytes a word, up to ``most`` words)."""

    def __init__(self, most: int = 1_000_000) -> None:
        self.most = most
        self.forget()

    def forget(self) -> None:
        self._runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # sorted hashes, first id, number of ids
        self._flat = np.zeros(0, dtype=np.int32)

    def _look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, n = np.full(hashes.size, -1, dtype=np.int64), np.zeros(hashes.size, dtype=np.int64)
        for run, at, counts in self._runs:
            place = np.minimum(np.searchsorted(run, hashes), run.size - 1)
            hit = run[place] == hashes
            first[hit], n[hit] = at[place[hit]], counts[place[hit]]
        return first, n

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one after the other, and the number of ids of each word.

        ``encode`` gets the bytes of the distinct words that are new, laid end to end, with their edges.
        """
        if not starts.size:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        hashes, at, back = np.unique(stretch_hashes(byte_sums(data), starts, ends), return_index=True, return_inverse=True)
        first, n = self._look(hashes)
        new = np.flatnonzero(first < 0)
        if sum(r.size for r, _, _ in self._runs) + new.size > self.most and self._runs:
            self.forget()
            first, n, new = np.full(hashes.size, -1, dtype=np.int64), n, np.arange(hashes.size)
        if new.size:
            s, size = starts[at[new]], ends[at[new]] - starts[at[new]]
            stop = np.cumsum(size)
            ids, counts = encode(data[np.arange(int(stop[-1])) + np.repeat(s - (stop - size), size)], stop - size, stop)
            first[new], n[new] = self._flat.size + np.cumsum(counts) - counts, counts
            self._flat = np.concatenate([self._flat, ids.astype(np.int32)])
            self._runs.append((hashes[new], first[new], n[new]))
            if len(self._runs) > 6:
                run, own, counts = (np.concatenate(x) for x in zip(*self._runs, strict=True))
                order = np.argsort(run, kind="stable")
                self._runs = [(run[order], own[order], counts[order])]
        first, n = first[back], n[back]
        stop = np.cumsum(n)
        return self._flat[np.arange(int(stop[-1])) + np.repeat(first - (stop - n), n)], n


@dataclass
class Words:
    """The words of a slice of texts, in order."""

    data: np.ndarray  # bytes of all texts of the slice
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    first: np.ndarray  # number of the first word of each text, and the number of words last
    rows: range  # the rows of the batch that the slice holds
    byte_edges: np.ndarray  # first byte of each text, and the number of bytes last

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64 bits for each word; with ``lower`` after A-Z became a-z."""
        return stretch_hashes(byte_sums(_LOWER[self.data] if lower else self.data), self.starts, self.ends)

    def window_starts(self, size: int) -> np.ndarray:
        """Numbers of the words that begin a window of ``size`` words of one text."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(self.starts.size)
        return np.flatnonzero(left >= size)


def window_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """64 bits for each run of ``size`` word hashes; empty when there are fewer."""
    n = word_hashes.size - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        total += word_hashes[j : j + n] * _PLACE_VALUE[j]
    return mix(total + np.uint64(size))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32) if column.buffers()[1] else np.zeros(1)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not offsets.size:
        offsets = np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[range]:
    """Runs of rows of at most ``most`` bytes, or of one row that is larger."""
    row, n = 0, offsets.size - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield range(row, end)
        row = end


def words_of(column: pa.Array, kept: np.ndarray = SPACED, most: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of each slice of a string column: runs of the bytes in ``kept``."""
    data, offsets = text_bytes(column)
    for rows in slices(offsets, most):
        own = offsets[rows.start : rows.stop + 1] - offsets[rows.start]
        part = data[offsets[rows.start] : offsets[rows.stop]]
        inside = kept[part]
        before = np.zeros(part.size + 1, dtype=bool)
        before[1:] = inside
        before[own] = False  # a text does not go on in the next one
        starts = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(part.size + 1, dtype=bool)
        after[:-1] = inside
        after[own] = False
        ends = np.flatnonzero(inside & ~after[1:]) + 1
        yield Words(part, starts, ends, np.searchsorted(starts, own), rows, own)
