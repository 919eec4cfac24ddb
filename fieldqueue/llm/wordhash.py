"""Words of Arrow text columns as numpy arrays of hashes, without one Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Multiplier of the rolling hash, odd and therefore invertible modulo 2**64; its inverse; multipliers of the final mix.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 2**64)
MIX1, MIX2, JOIN = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93
#: Bytes hashed at once; a longer text is hashed whole.
PIECE = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit numbers over all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(MIX1)
    h ^= h >> np.uint64(33)
    h *= np.uint64(MIX2)
    h ^= h >> np.uint64(33)
    return h


VALUES = mixed((LOWER.astype(np.uint64) + np.uint64(1)) * np.uint64(JOIN))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP and BACK to the powers 0 to n - 1."""
    if len(_powers.get("up", ())) < n:
        m = max(n, PIECE)
        for name, base in (("up", STEP), ("down", BACK)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words before each row (one more than rows)."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word, A-Z as a-z."""
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(VALUES[raw] * up[: len(raw)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, words before each row) for runs of rows of about PIECE bytes."""
    raw, at = text_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1))
        part, own = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        starts, ends, before = spans(part, own)
        yield i, j, word_hashes(part, starts, ends), before
        i = j


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words, rows not regarded; empty if there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m].copy()
    for k in range(1, n):
        h *= np.uint64(JOIN)
        h += words[k : k + m]
    return mixed(h)


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted hashes of its distinct n-word shingles; fewer words are one shingle, none an empty set."""
    for i, j, words, before in pieces(column):
        all_ = grams(words, n)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
            if b - a >= n:
                yield np.unique(all_[a : b - n + 1])
            elif b > a:
                yield grams(words[a:b], b - a) + np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)
