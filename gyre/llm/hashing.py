"""Words, shingles and substrings of many texts as 64-bit hashes, straight from Arrow's bytes.

A prefix sum of byte * P**position (modulo 2**64) gives the polynomial hash of
any span by one subtraction and one multiplication, so a batch of texts is hashed
without a Python object for each word.  Hashes are mixed before use.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

P = 0x9E3779B97F4A7C15 | 1
#: Another base, for a second hash that is independent of the first.
Q = 0xD1342543DE82EF95
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


#: Tables of powers are kept up to so many entries (8 MB each); longer ones are made for the one call.
KEPT = 1 << 20
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = P) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1, at least, of ``base`` and of its inverse modulo 2**64."""
    held = _tables.get(base)
    if held is None or len(held[0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(1, np.uint64)
            while len(p) < max(n, 1 << 19):
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), 1 << 64))])
            out.append(p)
        held = out[0], out[1]
        if len(held[0]) <= KEPT:
            _tables[base] = held
    return held


def prefix_sums(data: np.ndarray, base: int = P) -> tuple[np.ndarray, np.ndarray]:
    """(sums of byte * base**place, inverse powers): ``spans`` of them are polynomial hashes."""
    up, down = powers(len(data) + 1, base)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def spans(sums: np.ndarray, down: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[begin]) * down[begin]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mixing of 64-bit integers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column: pa.Array, most: int = 300_000):
    """(first row, bytes, row offsets) of slices of a string column of about ``most`` bytes; a row is never cut."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, words before each row and in all) of runs without ASCII white space; rows end runs."""
    solid = ~WHITE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    at = inner[(inner > 0) & (inner < len(data))]
    begin[at] = solid[at]
    end[at - 1] = solid[at - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(spans(*prefix_sums(data), begin, end))


def shingle_hashes(words: np.ndarray, edges: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row of each) of ``size`` words in a row; a row of fewer words, but one, has one shingle of them all."""
    n = np.diff(edges)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - np.repeat(edges[:-1], n)
    first = place <= np.maximum(np.repeat(n, n) - size, 0)
    at = np.flatnonzero(first)
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = place[at] + k < n[row[at]]
        w = words[np.minimum(at + k, len(words) - 1)] if len(words) else words
        h = h * np.uint64(P) + np.where(inside, w, np.uint64(k))
    return mix(h), row[at]
