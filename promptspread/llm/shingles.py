"""Word shingles of many texts at once, as 64-bit hashes (array operations over a slice of texts).

A word is a run of characters other than the six ASCII white spaces, with A-Z
lowered; a shingle is ``SHINGLE_WORDS`` words in a row.  A text with fewer words
has one shingle, its whole word sequence; a text without words has none.
"""

from __future__ import annotations

import numpy as np

from promptspread.llm.common import SHINGLE_WORDS

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the SplitMix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64; grown by doubling and kept for the next slice."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    if len(have) <= 1 << 23:
        _powers[base] = have
    return have[:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, text number) of every word, in text order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    visible = np.ones(256, bool)
    visible[[9, 10, 11, 12, 13, 32]] = False
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    inside = visible[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((lower[data] + np.uint64(1)) * _power(BASE, n), out=sums[1:])
    h = (sums[stop] - sums[start]) * _power(INVERSE, n)[start]
    row = np.searchsorted(offsets, start, side="right") - 1
    return mix(h + (stop - start).astype(np.uint64)), row


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, text number) of every shingle in text order, repeated ones included."""
    h, row = words(data, offsets)
    n_texts = len(offsets) - 1
    count = np.bincount(row, minlength=n_texts)
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < size))
    out, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= size:
        k = len(h) - size + 1
        acc = np.zeros(k, np.uint64)
        for i in range(size):
            acc = acc * np.uint64(BASE) + h[i:i + k]
        good = row[:k] == row[size - 1:]
        out, rows = mix(acc[good]), row[:k][good]
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(size - 1):
            has = count[short] > i
            whole[has] = whole[has] * np.uint64(BASE) + h[first[short[has]] + i]
        out = np.concatenate([out, mix(whole ^ np.uint64(MIX[1]) + count[short].astype(np.uint64))])
        rows = np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    h, row = shingles(data, offsets, size)
    cut = np.searchsorted(row, np.arange(len(offsets)))
    return [np.unique(h[a:b]) for a, b in zip(cut, cut[1:])]
