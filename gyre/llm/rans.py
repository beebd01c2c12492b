"""A range asymmetric numeral system with static tables over blocks of interleaved lanes, in numpy.

Ids of a group share one frequency table.  They are cut into blocks of equal
length; a block is a matrix of ``steps`` rows and ``LANES`` columns, a lane has
its own 64-bit state, and all lanes of a block write 32-bit words into one
stream.  A block also keeps checkpoints (step, word offset, states), so that
decoding can begin in its middle, and a crc32 of its ids.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

BITS, LANES, BLOCK, CHECKPOINTS = 20, 256, 262_144, 3
LOW = np.uint64(1 << 31)
U32, B32 = np.uint64(0xFFFFFFFF), np.uint64(32)


@dataclass
class Table:
    """symbols ascending, their frequencies (sum 2**bits) and their first slots."""

    symbols: np.ndarray
    freq: np.ndarray
    bits: int

    @classmethod
    def of(cls, ids: np.ndarray) -> "Table":
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts, bits = counts[symbols], BITS
        while len(symbols) > 1 << (bits - 1):
            bits += 1
        freq = np.maximum(1, counts * (1 << bits) // counts.sum())
        order, over = np.argsort(-freq, kind="stable"), int(freq.sum()) - (1 << bits)
        freq[order[0]] -= min(over, 0)
        for i in order:  # rounded-up rare symbols are paid for by frequent ones
            if over <= 0:
                break
            take = min(over, int(freq[i]) // 2)
            freq[i] -= take
            over -= take
        return cls(symbols.astype(np.uint32), freq.astype(np.uint32), bits)

    def dump(self) -> bytes:
        return bytes([self.bits]) + zlib.compress(np.diff(self.symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + self.freq.astype("<u4").tobytes())

    @classmethod
    def load(cls, raw: bytes) -> "Table":
        both = np.frombuffer(zlib.decompress(raw[1:]), "<u4").reshape(2, -1)
        return cls(np.cumsum(both[0], dtype=np.uint32), both[1], raw[0])

    def first(self) -> np.ndarray:
        return (np.cumsum(self.freq, dtype=np.uint64) - self.freq).astype(np.uint64)


def encode(ids: np.ndarray, table: Table, block: int = BLOCK) -> list[dict]:
    """Blocks {n, words, steps, marks, crc} for the ids; all are encoded side by side."""
    n = len(ids)
    if not n:
        return []
    many = -(-n // block)
    steps = -(-n // (many * LANES))
    per = steps * LANES
    pos = np.searchsorted(table.symbols, ids) if len(table.symbols) < 2 or table.symbols[-1] > 1 << 22 else _places(table)[ids]
    grid = np.zeros(many * per, np.int32)  # the last block is filled up with the first symbol
    grid[:n] = pos
    grid = np.ascontiguousarray(grid.reshape(many, steps, LANES).transpose(1, 0, 2)).reshape(steps, many * LANES)
    freq, first = table.freq.astype(np.uint64), table.first()
    shift, room = np.uint64(table.bits), np.uint64(63 - table.bits)
    x = np.full(many * LANES, LOW)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
    full: list[np.ndarray] = [np.zeros(0, np.int64)] * steps
    every, marks = max(1, -(-steps // (CHECKPOINTS + 1))), {}
    owner = np.repeat(np.arange(many), LANES)
    for t in range(steps - 1, -1, -1):
        s = grid[t]
        f = freq[s]
        where = np.flatnonzero(x >= f << room)
        if len(where):
            over = x[where]
            out[t], full[t] = (over & U32).astype(np.uint32), owner[where]
            x[where] = over >> B32
        q = x // f
        x = (q << shift) + (x - q * f) + first[s]
        if t % every == 0:
            marks[t] = x.copy()
    words, whose = np.concatenate(out), np.concatenate(full)
    at = np.concatenate([[0], np.cumsum([len(w) for w in out])])
    order = np.argsort(whose, kind="stable")
    sizes = np.bincount(whose, minlength=many)
    cut = np.concatenate([[0], np.cumsum(sizes)])
    blocks = []
    for b in range(many):
        own = ids[b * per : (b + 1) * per]
        blocks.append({
            "n": len(own), "steps": steps, "words": words[order[cut[b] : cut[b + 1]]].astype("<u4").tobytes(),
            "marks": [(t, int(np.count_nonzero(whose[: at[t]] == b)), marks[t][b * LANES : (b + 1) * LANES].astype("<u8").tobytes()) for t in sorted(marks)],
            "crc": zlib.crc32(own.astype("<u4").tobytes()),
        })
    return blocks


def _places(table: Table) -> np.ndarray:
    place = np.zeros(int(table.symbols[-1]) + 1, np.int32)
    place[table.symbols] = np.arange(len(table.symbols), dtype=np.int32)
    return place


def decode(blocks: list[dict], table: Table, mark: int = 0, until: int | None = None) -> np.ndarray:
    """The ids of blocks of equal steps, from checkpoint ``mark`` on, for ``until`` steps at most; whole blocks are held against their crc32."""
    if not blocks:
        return np.zeros(0, np.uint32)
    many, steps = len(blocks), blocks[0]["steps"]
    begin = blocks[0]["marks"][mark][0]
    end = steps if until is None else min(steps, begin + until)
    slots = np.repeat(np.arange(len(table.symbols), dtype=np.int32), table.freq)
    freq, first = table.freq.astype(np.uint64), table.first()
    shift, low = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    words = [np.frombuffer(b["words"], "<u4") for b in blocks]
    base = np.concatenate([[0], np.cumsum([len(w) for w in words])])[:-1]
    words = np.concatenate(words).astype(np.uint64)
    ptr = base + np.array([b["marks"][mark][1] for b in blocks])
    x = np.concatenate([np.frombuffer(b["marks"][mark][2], "<u8") for b in blocks]).astype(np.uint64)
    got = np.empty((end - begin, many * LANES), np.int32)
    owner = np.repeat(np.arange(many), LANES)
    for t in range(begin, end):
        slot = x & low
        s = slots[slot.astype(np.int64)]
        got[t - begin] = s
        x = freq[s] * (x >> shift) + slot - first[s]
        where = np.flatnonzero(x < LOW)
        if len(where):
            whose = owner[where]
            n = np.bincount(whose, minlength=many)
            rank = np.arange(len(where)) - (np.cumsum(n) - n)[whose]
            x[where] = (x[where] << B32) | words[ptr[whose] + rank]
            ptr += n
    ids = table.symbols[got.reshape(end - begin, many, LANES).transpose(1, 0, 2).reshape(many, -1)]
    if begin or end < steps:
        return ids
    parts = [ids[i, : b["n"]] for i, b in enumerate(blocks)]
    for p, b in zip(parts, blocks):
        if zlib.crc32(p.astype("<u4").tobytes()) != b["crc"]:
            raise ValueError("a block's checksum differs")
    return np.concatenate(parts)
