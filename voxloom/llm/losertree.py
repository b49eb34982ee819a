"""Sorted runs of byte strings: front coding, and merging by loser trees that know common prefixes.

A run is sorted and front-coded: every string is the number of bytes it shares with the one before, and
the rest. Merging keeps, for every loser, how much it shares with the string that beat it. A new string
shares a known number of bytes with the last winner, so two numbers decide most matches; only when they
are equal are bytes looked at, and only those beyond. No byte of a known prefix is compared twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need not be compared."""
    n, at, step = min(len(a), len(b)), known, 16
    while at < n:
        end = min(n, at + step)
        x, y = a[at:end], b[at:end]
        if x != y:
            differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return end - (differ.bit_length() + 7) // 8
        at, step = end, step * 4
    return n


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared bytes, remaining bytes and the joined rests of sorted strings."""
    shared = np.zeros(len(strings), dtype=np.int32)
    before = b""
    rests = []
    for i, s in enumerate(strings):
        k = shared_prefix(before, s)
        shared[i] = k
        rests.append(s[k:])
        before = s
    return shared, np.array([len(r) for r in rests], dtype=np.int32), b"".join(rests)


def front_decode(shared: np.ndarray, sizes: np.ndarray, rests: bytes) -> Iterator[tuple[int, bytes]]:
    """The strings of a run, one by one, each with the bytes it shares with the one before."""
    before, at = b"", 0
    for k, size in zip(shared.tolist(), sizes.tolist(), strict=True):
        before = before[:k] + rests[at : at + size]
        at += size
        yield k, before


def merge(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int]]:
    """Merge sorted runs: for every string in order, its run and the bytes it shares with the one before."""
    n = len(runs)
    if not n:
        return
    size = 1 << (n - 1).bit_length() if n > 1 else 1
    strings: list[bytes | None] = [None] * size
    for i, run in enumerate(runs):
        strings[i] = next(run, (0, None))[1]
    loser, shares = [0] * size, [0] * size

    def beats(x: int, y: int, known: int) -> tuple[bool, int]:
        """Whether ``x`` comes before ``y``, and the bytes they share (-1 when one of them has ended)."""
        a, b = strings[x], strings[y]
        if a is None or b is None:
            return b is None, -1
        k = shared_prefix(a, b, known)
        if k == len(a):
            return True, k
        return (False, k) if k == len(b) else (a[k] < b[k], k)

    winner = [0] * (2 * size)
    for i in range(size):
        winner[size + i] = i
    for node in range(size - 1, 0, -1):
        x, y = winner[2 * node], winner[2 * node + 1]
        first, k = beats(x, y, 0)
        winner[node], loser[node], shares[node] = (x, y, k) if first else (y, x, k)
    now, share = winner[1] if size > 1 else 0, 0
    while strings[now] is not None:
        yield now, share
        share, strings[now] = next(runs[now], (-1, None))
        node = (size + now) >> 1
        while node:
            known = shares[node]
            if share < known:
                now, loser[node] = loser[node], now
                shares[node], share = share, known
            elif share == known and share >= 0:
                first, k = beats(now, loser[node], share)
                if not first:
                    now, loser[node] = loser[node], now
                shares[node] = k
            node >>= 1
