"""Packing of documents into training sequences by non-negative least squares.

A document's ids are cut at multiples of the window; what is left over is
shorter than it.  The left-over lengths of all documents go into a histogram of
128 classes.  Combinations of up to three classes whose upper ends fill the
window are enumerated, and non-negative least squares gives how often to repeat
each, so that they use the histogram up.  The rounded counts are shared out to
the tasks; each packs units of about four million ids on its own: first the
combinations, then greedy ones of the residual classes, largest first.  What
still fits nowhere is cut freely: it tops up the sequences' few free places, then
fills windows, and the last ids of a unit become sequences of powers of two.  So
no sequence needs padding, memory is bounded by a unit and a document, and only
the histogram (at most 129 rows) reaches the driver.

Defined cases: a null text is an empty one, a document of the end id alone; null
and repeated doc_ids are kept as they are, each row is its own document; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing, tokens
from .common import documents, written

WINDOW, CLASSES, UNIT, DEPTH = 4096, 128, 4_000_000, 3
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_T = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """(doc_id, n, ids) of each row; ids: little-endian unsigned 16-bit integers, or 32-bit ones if the vocabulary needs them."""
    path = tokenizer or tokens.default_path()

    def run(batches):
        ids_of = tokens.word_ids(path)
        kind = "<u2" if ids_of.tok.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            for first, data, offsets in hashing.texts_of(batch.column(1)):
                ids, lens = ids_of.encode_bytes(data, offsets, end_id)
                raw = ids.astype(kind)
                ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64) * raw.itemsize
                column = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.record_batch([batch.column(0).slice(first, len(lens)), pa.array(lens, pa.int64()), column], names=["doc_id", "n", "ids"])

    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return at.mapInArrow(run, "doc_id long, n long, ids binary")


def combos(classes: int = CLASSES, depth: int = DEPTH) -> np.ndarray:
    """Rows of class multiplicities (class c at column c - 1) whose upper ends sum to the window."""
    found = []
    for k in range(1, depth + 1):
        for head in combinations_with_replacement(range(1, classes + 1), k - 1):
            last = classes - sum(head)
            if last >= (head[-1] if head else 1):
                found.append(np.bincount([*head, last], minlength=classes + 1)[1:])
    return np.array(found)


def nnls(a: np.ndarray, b: np.ndarray, most: int = 4000) -> np.ndarray:
    """Minimises |a x - b| over x >= 0 by accelerated projected gradients, with a new start wherever momentum leads uphill."""
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    v = np.ones(a.shape[1])
    for _ in range(50):  # the largest eigenvalue of a'a bounds the step
        v = a.T @ (a @ v)
        v /= max(np.linalg.norm(v), 1e-300)
    step = 1 / (1.02 * max(float(np.linalg.norm(a @ v)) ** 2, 1e-300))
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(most):
        new = np.maximum(0, y - step * (a.T @ (a @ y - b)))
        if (y - new) @ (new - x) > 0:
            t, y = 1.0, x
            new = np.maximum(0, y - step * (a.T @ (a @ y - b)))
        moved = float(np.abs(new - x).max(initial=0))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
        if moved < 1e-7 * scale:
            break
    return x


def plan(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, how often each is repeated) for the class counts of all documents."""
    table = combos(len(histogram))
    x = nnls(table.T.astype(float), histogram.astype(float))
    used = x > 1e-6
    return table[used], x[used]


def groups_of(cls: np.ndarray, table: np.ndarray, repeats: np.ndarray, classes: int) -> tuple[np.ndarray, int]:
    """Sequence number of each left-over piece, -1 for residuals, and the number of sequences.  cls: class of each."""
    order = np.argsort(cls, kind="stable")
    left = np.bincount(cls, minlength=classes + 1)
    at = np.concatenate([[0], np.cumsum(left)])[:-1]
    seq, n = np.full(len(cls), -1, np.int64), 0

    def take(parts: list[tuple[int, int]], times: int) -> None:
        nonlocal n
        for c, m in parts:
            seq[order[at[c] : at[c] + times * m]] = np.tile(np.arange(n, n + times), m)
            at[c] += times * m
            left[c] -= times * m
        n += times

    for row, times in zip(table, repeats):
        parts = [(int(c) + 1, int(row[c])) for c in np.flatnonzero(row)]
        times = min([int(times), *(int(left[c]) // m for c, m in parts)])
        if times:
            take(parts, times)
    for top in range(classes, 0, -1):  # greedy: the largest that fits, again and again
        while left[top]:
            room, chosen = classes - top, {top: 1}
            while room:
                fits = [c for c in range(min(room, top), 0, -1) if left[c] > chosen.get(c, 0)]
                if not fits:
                    break
                chosen[fits[0]] = chosen.get(fits[0], 0) + 1
                room -= fits[0]
            if room > classes // 16:
                break
            take(list(chosen.items()), min(int(left[c]) // m for c, m in chosen.items()))
    return seq, n


def packed(lens: np.ndarray, table: np.ndarray, repeats: np.ndarray, window: int = WINDOW, classes: int = CLASSES) -> dict[str, np.ndarray]:
    """Pieces (doc, start, length, sequence, offset) of documents of these lengths, in the order of doc and start."""
    whole, rest = lens // window, lens % window
    docs = np.arange(len(lens))
    doc = [np.repeat(docs, whole)]
    start = [(np.arange(len(doc[0])) - np.repeat(np.cumsum(whole) - whole, whole)) * window]
    length, seq, off = [np.full(len(doc[0]), window)], [np.arange(len(doc[0]))], [np.zeros(len(doc[0]), np.int64)]
    n = len(doc[0])
    own = np.flatnonzero(rest)
    r = rest[own]
    group, many = groups_of(-(-r // (window // classes)), table, repeats, classes)
    filled = np.bincount(group[group >= 0], weights=r[group >= 0], minlength=many).astype(np.int64)
    # The residuals must have ids enough for the free places; else the last sequences become residuals too.
    spare, free = int(r[group < 0].sum()), window - filled
    keep = many - int(np.argmax((spare + np.concatenate([[0], np.cumsum(filled[::-1])])) >= (free.sum() - np.concatenate([[0], np.cumsum(free[::-1])]))))
    group[group >= keep] = -1
    free = free[:keep]
    put = np.flatnonzero(group >= 0)
    put = put[np.argsort(group[put], kind="stable")]
    if len(put):
        ends = np.cumsum(r[put])
        base = np.concatenate([[0], np.cumsum(filled[:keep])])[group[put]]
        doc.append(own[put]), start.append(lens[own[put]] - r[put]), length.append(r[put]), seq.append(n + group[put]), off.append(ends - r[put] - base)
    n += keep
    loose = np.flatnonzero(group < 0)
    if len(loose):
        ends = np.concatenate([[0], np.cumsum(r[loose])])
        total = int(ends[-1])
        gaps = np.flatnonzero(free)
        slots, slot_seq, slot_off = [free[gaps]], [n - keep + gaps], [filled[:keep][gaps]]
        over = total - int(free.sum())
        tail = [1 << i for i in range(window.bit_length()) if over % window >> i & 1][::-1]
        more = np.array([*[window] * (over // window), *tail], np.int64)
        slots.append(more), slot_seq.append(n + np.arange(len(more))), slot_off.append(np.zeros(len(more), np.int64))
        slots, slot_seq, slot_off = map(np.concatenate, (slots, slot_seq, slot_off))
        edges = np.concatenate([[0], np.cumsum(slots)])
        cuts = np.union1d(ends, edges)
        a, b = cuts[:-1], cuts[1:]
        d, s = np.searchsorted(ends, a, "right") - 1, np.searchsorted(edges, a, "right") - 1
        whose = own[loose[d]]
        doc.append(whose), start.append(lens[whose] - rest[whose] + a - ends[d]), length.append(b - a), seq.append(slot_seq[s]), off.append(slot_off[s] + a - edges[s])
    out = {k: np.concatenate(v).astype(np.int64) for k, v in (("doc", doc), ("start", start), ("length", length), ("sequence", seq), ("offset", off))}
    order = np.lexsort((out["start"], out["doc"]))
    return {k: v[order] for k, v in out.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    held = written(tokenized(docs, tokenizer, end_id), "pack-ids")
    width = window // CLASSES
    counts = held.select(F.ceil((F.col("n") % window) / width).alias("c")).where("c > 0").groupBy("c").count().collect()
    histogram = np.zeros(CLASSES, np.int64)
    for c, n in counts:
        histogram[c - 1] = n
    table, repeats = plan(histogram)
    total = max(1, int(histogram.sum()))

    def flush(doc_ids: list, raws: list[bytes], lens: list[int], first: int):
        n = np.array(lens, np.int64)
        kind = "<u2" if len(raws[0]) == 2 * lens[0] else "<u4"
        ids = np.frombuffer(b"".join(raws), kind).astype("<u4")
        share = np.count_nonzero(n % window) / total
        local = np.diff(np.floor(np.cumsum(repeats * share) + 0.5), prepend=0).astype(np.int64) if len(repeats) else repeats
        p = packed(n, table, local, window)
        ends = np.concatenate([[0], np.cumsum(p["length"])])
        raw = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends * 4), pa.py_buffer(ids)])
        owner = pa.array(doc_ids, pa.int64())
        for a in range(0, len(ends) - 1, 2000):
            b = min(a + 2000, len(ends) - 1)
            d = p["doc"][a:b]
            yield pa.record_batch([owner.take(pa.array(d)), *(pa.array(p[k][a:b]) for k in ("start", "length")), raw[a:b].cast(pa.binary()), pa.array(n[d]), pa.array(p["sequence"][a:b] + first), pa.array(p["offset"][a:b])], schema=PIECES)

    def run(batches):
        first, size = TaskContext.get().partitionId() << 40, 0
        doc_ids, raws, lens = [], [], []
        for batch in batches:
            for d, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                doc_ids.append(d), lens.append(n), raws.append(raw)
                size += n
                if size >= unit:
                    yield from flush(doc_ids, raws, lens, first)
                    first, size, doc_ids, raws, lens = first + 2 * size + 64, 0, [], [], []
        if lens:
            yield from flush(doc_ids, raws, lens, first)

    return held.mapInArrow(run, PIECES_T)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
