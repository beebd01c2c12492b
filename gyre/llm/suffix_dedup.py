"""Removal of bytes that repeat from earlier documents, by prefix doubling over position-rank pairs.

A byte goes if a string of 50 bytes that covers it also starts in a document of a
smaller doc_id.  ``doubled`` is the method in full: every position has the rank of
its first 8 bytes; Spark sorts the pairs of a position's rank and the rank 8, 16 and
then 18 bytes on, ranks them anew, and ranks that are in one document only leave, until
50 bytes are passed.  It moves some fifty bytes a round for each byte of text, so the
queries take ``sampled``, the same rounds over sampled suffixes: of the 35 strings of
16 bytes within a window of 50, the one of the least hash is the window's anchor.
Equal windows have equal anchors at equal places, and one anchor serves a run of
windows, so about every 18th position is an anchor and nothing is lost.

Round 1: Spark sorts (rank of the anchor's 16 bytes, rank of its whole stretch of
windows, doc_id, hash of the text, position).  An anchor whose 16 bytes are in one
document only is unique and leaves.  If a smaller document has the same stretch, all
its windows repeat and it leaves with a mark.  Round 2 doubles: an anchor stays only
if its 16 bytes with the 16 after or before them (one pair lies in every window) are
in another document.  Round 3 passes the threshold: the few anchors left, at the
borders of repeats, are sorted again by rank, each with the bytes of its windows, and
every 50-byte window is ranked among those of its anchor; a rank too large for a task
deals its windows out once more.  Tasks resolve repeats among their own rows first and send on the smallest
document of each only, so a passage in a third of all documents costs a row a task.
Tasks hold a slice of sorted ranks at a time; Spark's sort spills what memory can't hold.

Ranks of ``sampled`` are hashes (64 bits for anchors and, by another base, 64 more for
stretches; two independent hashes of 64 bits for windows), not places in a total
order: a later round needs equal ranks for equal strings only.  Ranks of ``doubled``
are places in Spark's sorted order, from exact bytes.

Defined cases: a null text is empty; a null doc_id is larger than all others; rows of
one doc_id are judged each for itself and never against each other; texts under 50
bytes stay whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import documents, written

LENGTH, GRAM = 50, 16
LAST = (1 << 63) - 1
#: Anchors of a chunk; a rank with more stretches than HOT in one chunk skips round 1; a rank with more than GROUP rows is dealt out by windows.
CHUNK, HOT, GROUP = 400_000, 2_000, 100_000
#: Keys of documents with marks are broadcast up to so many rows (some 50 MB); beyond, texts are shuffled by key.
BROADCAST_ROWS = 1_000_000
ROWS_T = "kind int, g long, c long, doc long, tag long, v long"
CONTEXT_T = "kind int, g long, doc long, tag long, v long, context binary"
MARKS_T = "kind int, doc long, tag long, v long"
#: tag: the 64-bit hash of the text, which tells rows of one doc_id (or of none) apart.
#: v: 8 bits each of the 16 bytes before and after the anchor (0: none), 32 of the first window's position, 6 of the anchor's place in it, 6 of the number of windows.
LEFT, RIGHT, AT, OFF = 52, 44, 12, 6
#: The stretch's rank that tells receivers of a hot rank, and sorts before all others.
HOT_MARK = -(1 << 63)


def free_id(docs: DataFrame) -> int:
    """LAST, which stands for a null doc_id; where a row has that very id beside nulls, the largest id below it that no row has: ids above move down by one."""
    ids = docs.select(F.col("doc_id").cast("long").alias("d"))
    if not all(ids.agg(F.max("d") == LAST, F.max(F.col("d").isNull())).first()):
        return LAST
    below = ids.where("d > -9223372036854775808").select((F.col("d") - 1).alias("d")).distinct()
    return below.join(ids, "d", "left_anti").agg(F.max("d")).first()[0]


def coded(doc_id, free: int):
    """doc_id as a number that sorts as it does, nulls last."""
    d = doc_id.cast("long")
    return F.coalesce(F.when(d > free, d - 1).otherwise(d), F.lit(LAST))


def keyed(docs: DataFrame, free: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(coded(F.col("doc_id"), free).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, rank of the anchor's bytes, rank of its stretch, first window in the row, v) of each anchor."""
    n, w = len(data), length - gram + 1
    empty = (np.zeros(0, np.int64),) * 4
    if n < length:
        return empty
    sums, down = hashing.prefix_sums(data)
    h = hashing.mix((sums[gram:] - sums[: n + 1 - gram]) * down[: n + 1 - gram])
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= w:  # least of 2, 4, 8 ... values in a row
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[: len(low) - (w - size)], low[w - size :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of window p: its anchor
    ends = np.repeat(offsets[1:], np.diff(offsets))
    valid = np.arange(len(at)) + length <= ends[: len(at)]
    p = np.flatnonzero(valid)
    if not len(p):
        return empty
    new = np.ones(len(p), bool)
    new[1:] = (at[p[1:]] != at[p[:-1]]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    lo, q = p[first], at[p[first]]
    count = np.diff(np.append(first, len(p)))
    row = np.searchsorted(offsets, lo, "right") - 1
    begin, end = offsets[row], offsets[row + 1]
    stretch = hashing.mix(hashing.spans(*hashing.prefix_sums(data, hashing.Q), lo, lo + count - 1 + length) + hashing.mix((q - lo) * 64 + count, 7))
    has_left, has_right = q - gram >= begin, q + 2 * gram <= end
    ql, qr = np.where(has_left, q - gram, 0), np.where(has_right, q + gram, 0)
    top, one = np.uint64(56), np.uint64(1)
    left = np.where(has_left, hashing.mix(hashing.spans(sums, down, ql, ql + gram)) >> top | one, np.uint64(0)).astype(np.int64)
    right = np.where(has_right, hashing.mix(hashing.spans(sums, down, qr, qr + gram)) >> top | one, np.uint64(0)).astype(np.int64)
    v = left << LEFT | right << RIGHT | (lo - begin) << AT | (q - lo) << OFF | count
    return row, h[q].view(np.int64), np.maximum(stretch.view(np.int64), HOT_MARK + 1), v


def firsts(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by the keys and doc; whether the row at that place has the least doc of its keys)."""
    order = np.lexsort([doc, *keys[::-1]])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys]) if len(order) > 1 else False
    group = np.cumsum(new) - 1
    return order, doc[order] == doc[order[np.flatnonzero(new)]][group]


def resolved(keys: list[np.ndarray], doc: np.ndarray):
    """(places of the rows of the least document of their keys, places of the others): the others repeat from a smaller document."""
    order, least = firsts(keys, doc)
    return order[least], order[~least]


def record(kind: int, doc: np.ndarray, tag: np.ndarray, v: np.ndarray, g: np.ndarray | None = None, c: np.ndarray | None = None) -> pa.RecordBatch:
    none = np.zeros(len(doc), np.int64)
    g, c = (none if x is None else x.view(np.int64) for x in (g, c))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), *map(pa.array, (g, c, doc, tag, v))], names=["kind", "g", "c", "doc", "tag", "v"])


def emitted(kind: int, *columns: np.ndarray, step: int = 50_000):
    for a in range(0, len(columns[0]), step):
        yield record(kind, *(x[a : a + step] for x in columns))


def by_chunks(source, settle, share: int = 1):
    """Accumulates tuples of columns of about CHUNK / share rows and gives what ``settle`` makes of them."""

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for part in source(batch):
                parts.append(part)
                size += len(part[0])
                if size >= CHUNK // share:
                    yield from settle(*map(np.concatenate, zip(*parts)))
                    parts, size = [], 0
        if size:
            yield from settle(*map(np.concatenate, zip(*parts)))

    return run


def anchor_rows(length: int, gram: int, share: int = 1):
    """Round 1, sender: kind 1 marks and kind 2 anchors of hot ranks (their g is spread), kind 0 the others."""

    def source(batch):
        doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for first, data, offsets in hashing.texts_of(batch.column(2)):
            row, g, c, v = anchors(data, offsets, length, gram)
            row = row + first
            yield g, c, doc[row], tag[row], v

    def spread(tag, v):
        return hashing.mix(tag.view(np.uint64) ^ v.view(np.uint64)).view(np.int64)

    def settle(g, c, doc, tag, v):
        stay, repeat = resolved([g, c], doc)
        yield from emitted(1, doc[repeat], tag[repeat], v[repeat], spread(tag[repeat], v[repeat]))
        g, c, doc, tag, v = g[stay], c[stay], doc[stay], tag[stay], v[stay]  # sorted by rank
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        hot = np.diff(np.append(np.flatnonzero(new), len(g))) > HOT
        own = np.repeat(hot, np.diff(np.append(np.flatnonzero(new), len(g))))
        if hot.any():  # HOT_MARK tells the receivers; the rows themselves go on to the next round
            yield from emitted(2, doc[own], tag[own], v[own], spread(tag[own], v[own]))
            mark = g[np.flatnonzero(new)][hot]
            none = np.zeros(len(mark), np.int64)
            yield from emitted(0, none, none, none, mark, np.full(len(mark), HOT_MARK))
        yield from emitted(0, doc[~own], tag[~own], v[~own], g[~own], c[~own])

    return by_chunks(source, settle, share)


def ranked(batches):
    """Rounds 1 and 2, receiver of rows sorted by rank and stretch: (kind, doc, tag, v); kind 1 marks, kind 2 anchors that go on.

    Holds a slice of whole ranks; a rank of more than GROUP rows goes on without a look at its neighbours.
    """
    held, over = [np.zeros(0, np.int64)] * 5, None  # over: the rank that is known to go on
    for batch in batches:
        kind, g, c, doc, tag, v = (batch.column(i).to_numpy() for i in range(6))
        for k in (1, 2):
            own = np.flatnonzero(kind == k)
            yield from plain(k, doc[own], tag[own], v[own])
        own = kind == 0
        held = [np.concatenate([x, y[own]]) for x, y in zip(held, (g, c, doc, tag, v))]
        if len(held[0]) >= GROUP:
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last rank may go on
            if not cut:
                over, cut = held[0][-1], len(held[0])
            yield from rank_slice(*(x[:cut] for x in held), over)
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield from rank_slice(*held, over)


def rank_slice(g, c, doc, tag, v, over):
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    start, group = np.flatnonzero(new), np.cumsum(new) - 1
    hot = (c[start] == HOT_MARK)[group]
    if over is not None:
        hot |= g == over
    alone = (np.minimum.reduceat(doc, start) == np.maximum.reduceat(doc, start))[group]
    keep = (c != HOT_MARK) & (hot | ~alone)
    g, c, doc, tag, v, hot = g[keep], c[keep], doc[keep], tag[keep], v[keep], hot[keep]
    stay, repeat = resolved([g, c], doc)
    yield from plain(1, doc[repeat], tag[repeat], v[repeat])
    g, doc, tag, v, live = g[stay], doc[stay], tag[stay], v[stay], hot[stay]
    for side in ((v >> LEFT) & 0xFF, (v >> RIGHT) & 0xFF):
        has = np.flatnonzero(side)
        if len(has):
            order = has[np.lexsort((doc[has], side[has], g[has]))]
            new = np.ones(len(order), bool)
            new[1:] = (g[order[1:]] != g[order[:-1]]) | (side[order[1:]] != side[order[:-1]])
            start = np.flatnonzero(new)
            shared = np.minimum.reduceat(doc[order], start) != np.maximum.reduceat(doc[order], start)
            live[order] |= shared[np.cumsum(new) - 1]
    yield from plain(2, doc[live], tag[live], v[live])


def plain(kind: int, doc: np.ndarray, tag: np.ndarray, v: np.ndarray, step: int = 50_000):
    for a in range(0, len(doc), step):
        d = doc[a : a + step]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), kind, np.int32)), pa.array(d), pa.array(tag[a : a + step]), pa.array(v[a : a + step])], names=["kind", "doc", "tag", "v"])


def context_rows(length: int, gram: int):
    """Round 3, sender: the anchors that are left, each with the bytes of its windows; equal ones of a chunk are settled here."""

    def source(batch):
        doc, tag, vs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
        for i, raw in enumerate(batch.column(2).to_pylist()):
            raw = zstandard.decompress(raw)
            v = np.array(vs[i].as_py(), np.int64)
            data = np.frombuffer(raw, np.uint8)
            sums, down = hashing.prefix_sums(data)
            lo = (v >> AT) & 0xFFFFFFFF
            q, end = lo + ((v >> OFF) & 63), lo + (v & 63) - 1 + length
            g = hashing.mix(hashing.spans(sums, down, q, q + gram))
            stretch = hashing.mix(hashing.spans(*hashing.prefix_sums(data, hashing.Q), lo, end) + hashing.mix((q - lo) * 64 + (v & 63), 7))
            yield g, stretch, np.full(len(v), doc[i]), np.full(len(v), tag[i]), v, np.array([raw[a:b] for a, b in zip(lo, end)] + [b""], object)[:-1]

    def settle(g, c, doc, tag, v, context):
        stay, repeat = resolved([g, c], doc)
        for kind, at in ((1, repeat), (2, stay)):
            for a in range(0, len(at), 10_000):
                own = at[a : a + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(g[own].view(np.int64)), pa.array(doc[own]), pa.array(tag[own]), pa.array(v[own]), pa.array(context[own].tolist() if kind == 2 else [None] * len(own), pa.binary())], names=["kind", "g", "doc", "tag", "v", "context"])

    return by_chunks(source, settle, 4)


def windows(doc: np.ndarray, tag: np.ndarray, v: np.ndarray, contexts: list[bytes], length: int, part: int = 4000):
    """(two ranks by independent hashes, doc, tag, v) of each window of the contexts."""
    out = []
    for a in range(0, len(contexts), part):
        own, count = contexts[a : a + part], v[a : a + part] & 63
        data = np.frombuffer(b"".join(own), np.uint8)
        begin = np.cumsum([0, *map(len, own)])[:-1]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(begin, count) + step
        ranks = [hashing.mix(hashing.spans(*hashing.prefix_sums(data, base), at, at + length), 8) for base in (hashing.P, hashing.Q)]
        lo = np.repeat((v[a : a + part] >> AT) & 0xFFFFFFFF, count) + step
        out.append((*ranks, np.repeat(doc[a : a + part], count), np.repeat(tag[a : a + part], count), lo << AT | 1))
    return [np.concatenate(x) for x in zip(*out)]


def window_ranks(length: int):
    """Round 3, receiver of rows sorted by rank: kind 1 marks; a rank of more than GROUP rows is passed on by its windows, kind 3."""

    def settle(doc, tag, v, contexts, big):
        w, x, doc, tag, v = windows(doc, tag, v, contexts, length)
        stay, repeat = resolved([w, x], doc)
        yield from emitted(1, doc[repeat], tag[repeat], v[repeat])
        if big:
            yield from emitted(3, doc[stay], tag[stay], v[stay], w[stay], x[stay])

    def run(batches):
        g, doc, tag, v, contexts, big = (np.zeros(0, np.int64),) * 4 + ([], False)
        for batch in batches:
            kind = batch.column(0).to_numpy()
            one = int(np.searchsorted(kind, 2))
            yield from emitted(1, *(batch.column(i).to_numpy()[:one] for i in (2, 3, 4)))
            g, doc, tag, v = (np.concatenate([x, batch.column(i).to_numpy()[one:]]) for x, i in ((g, 1), (doc, 2), (tag, 3), (v, 4)))
            contexts = contexts + batch.column(5).to_pylist()[one:]
            while len(g):
                cut = int(np.searchsorted(g, g[-1], "left"))  # the last rank may go on
                if cut:  # the first rank ends here
                    head = int(np.searchsorted(g, g[0], "right")) if big else cut
                    yield from settle(doc[:head], tag[:head], v[:head], contexts[:head], big)
                    g, doc, tag, v, contexts, big = g[head:], doc[head:], tag[head:], v[head:], contexts[head:], False
                elif len(g) > GROUP:
                    big = True
                    yield from settle(doc, tag, v, contexts, True)
                    g, doc, tag, v, contexts = g[-1:], doc[-1:], tag[-1:], v[-1:], contexts[-1:]
                    break
                else:
                    break
        if len(g):
            yield from settle(doc, tag, v, contexts, big)

    return run


def repeats(batches):
    """Window ranks of hot anchors, sorted by kind, rank and doc: (kind, doc, tag, v); kind 1 for those that a smaller document has."""
    last = None  # rank and least document of the rank that the last batch ended in
    for batch in batches:
        one = int(np.searchsorted(batch.column(0).to_numpy(), 3))
        g, c, doc, tag, v = (batch.column(i).to_numpy() for i in range(1, 6))
        yield from plain(1, doc[:one], tag[:one], v[:one])
        g, c, doc, tag, v = g[one:], c[one:], doc[one:], tag[one:], v[one:]
        if not len(g):
            continue
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        if last is not None and (g[0], c[0]) == last[0]:
            least = np.where(np.cumsum(new) == 1, last[1], least)
        yield from plain(1, doc[doc > least], tag[doc > least], v[doc > least])
        last = ((g[-1], c[-1]), least[-1])


def shrunk(rows: DataFrame) -> DataFrame:
    """(doc, tag, text) with the text as compressed UTF-8, for a shuffle."""

    def run(batches):
        for batch in batches:
            pack = zstandard.ZstdCompressor(1).compress
            for a in range(0, batch.num_rows, 1000):
                text = batch.column(2).slice(a, 1000).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 1000), batch.column(1).slice(a, 1000), pa.array(list(map(pack, text)), pa.binary())], names=["doc", "tag", "text"])

    return rows.mapInArrow(run, "doc long, tag long, text binary")


def by_text(base: DataFrame, rows: DataFrame, shuffled=shrunk) -> tuple[DataFrame, DataFrame | None]:
    """(the rows of ``base`` that have rows of (doc, tag, v), made small by ``shuffled``, with their vs; the other rows as they are).

    base has doc and tag.  The keys of texts with rows are broadcast if they are few, so
    that no other text is shuffled; beyond, all rows come in the first table (vs null for
    those without) and the second is None.
    """
    lists = rows.groupBy("doc", "tag").agg(F.collect_list("v").alias("vs"))
    lists = written(lists, "suffix-lists", compression="zstd")
    # A text's rows are few enough for one row, as its bytes are.
    named = lists.select(F.col("doc").alias("_ld"), F.col("tag").alias("_lt"), "vs")
    on = (F.col("doc") == F.col("_ld")) & (F.col("tag") == F.col("_lt"))
    if lists.count() > BROADCAST_ROWS:
        return shuffled(base).join(named, on, "left").drop("_ld", "_lt"), None
    keys = F.broadcast(lists.select(F.col("doc").alias("_kd"), F.col("tag").alias("_kt")))
    has = (F.col("doc") == F.col("_kd")) & (F.col("tag") == F.col("_kt"))
    return shuffled(base.join(keys, has, "left_semi")).join(named, on).drop("_ld", "_lt"), base.join(keys, has, "left_anti")


def sampled(docs: DataFrame, free: int, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, tag, v): runs of windows that also start in a smaller document; by the rounds over anchors."""
    rows = keyed(docs, free).mapInArrow(anchor_rows(length, gram), ROWS_T).repartition("g").sortWithinPartitions("g", "c")
    first = written(rows.mapInArrow(ranked, MARKS_T), "suffix-round1", compression="zstd")
    left, _ = by_text(keyed(docs, free), first.where("kind = 2"))
    rows = left.where("vs is not null").mapInArrow(context_rows(length, gram), CONTEXT_T)
    rows = rows.repartition(F.when(F.col("kind") == 2, F.col("g")).otherwise(F.xxhash64("tag", "v"))).sortWithinPartitions("kind", "g")
    rows = rows.mapInArrow(window_ranks(length), ROWS_T)
    rows = rows.repartition(F.when(F.col("kind") == 3, F.col("g")).otherwise(F.xxhash64("tag", "v"))).sortWithinPartitions("kind", "g", "c", "doc")
    second = rows.mapInArrow(repeats, MARKS_T)
    return first.where("kind = 1").select("doc", "tag", "v").union(second.select("doc", "tag", "v"))


def starts(size: int):
    """Every position with ``size`` (at most 8) bytes after it: (doc, tag, p, r), r being those bytes as a number."""

    def run(batches):
        for batch in batches:
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, data, offsets in hashing.texts_of(batch.column(2)):
                r = np.zeros(max(0, len(data) - size + 1), np.uint64)
                for k in range(size):
                    r = r << np.uint64(8) | data[k : k + len(r)].astype(np.uint64)
                p = np.arange(len(r))
                row = np.searchsorted(offsets, p, "right") - 1
                at = np.flatnonzero(p + size <= offsets[row + 1])
                for a in range(0, len(at), 50_000):
                    own = at[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[first + row[own]]), pa.array(tag[first + row[own]]), pa.array(own - offsets[row[own]]), pa.array(r[own].view(np.int64))], names=["doc", "tag", "p", "r"])

    return run


def reranked(batches):
    """Pairs sorted by (r, s, doc): (doc, tag, p, r, least), r being the pair's place among its partition's; pairs in one document only leave."""
    place, last, least, known, waiting = TaskContext.get().partitionId() << 40, None, 0, False, []

    def rows(doc, tag, p, r, lo):
        return pa.RecordBatch.from_arrays(list(map(pa.array, (doc, tag, p, r, lo))), names=["doc", "tag", "p", "r", "least"])

    for batch in batches:
        r, s, doc, tag, p = (batch.column(i).to_numpy() for i in range(5))
        if not len(r):
            continue
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        more = last == (r[0], s[0])  # the last batch's pair goes on
        lo, hi = doc[start], doc[np.append(start[1:], len(r)) - 1]
        if more:
            lo[0] = least
        shared = hi > lo
        number = np.arange(len(start)) + place + (0 if more else 1)
        if more:
            shared[0] |= known
            if shared[0]:
                yield from waiting
        own = shared[group]
        yield rows(doc[own], tag[own], p[own], number[group][own], lo[group][own])
        if shared[-1] or not (more and len(start) == 1):
            waiting = []
        if not shared[-1]:  # rows of the pair's first document wait for another one
            own = group == group[-1]
            waiting.append(rows(doc[own], tag[own], p[own], number[group][own], lo[group][own]))
        last, least, known, place = (r[-1], s[-1]), lo[-1], shared[-1], number[-1]


def doubled(docs: DataFrame, free: int, length: int = LENGTH) -> DataFrame:
    """The marks of ``sampled``, by prefix doubling over all positions: ranks are places in Spark's sorted order."""
    size = min(8, length)
    rows = written(keyed(docs, free).mapInArrow(starts(size), "doc long, tag long, p long, r long"), "suffix-starts")
    step = 0  # the first round ranks the bytes themselves
    while True:
        later = rows.select("doc", "tag", (F.col("p") - step).alias("p"), F.col("r").alias("s"))
        pairs = rows.join(later, ["doc", "tag", "p"]) if step else rows.withColumn("s", F.lit(0).cast("long"))
        pairs = pairs.select("r", "s", "doc", "tag", "p").repartitionByRange("r", "s").sortWithinPartitions("r", "s", "doc")
        rows = written(pairs.mapInArrow(reranked, "doc long, tag long, p long, r long, least long"), "suffix-ranks")
        if size == length:
            return rows.where("doc > least").select("doc", "tag", F.shiftleft("p", AT).bitwiseOR(F.lit(1)).alias("v"))
        step = min(size, length - size)
        size += step


def cut(raw: bytes, vs: np.ndarray | None, length: int) -> tuple[bytes, int, int]:
    """(bytes that stay, bytes removed, removed runs)."""
    if vs is None or not len(vs):
        return raw, 0, 0
    edge = np.zeros(len(raw) + 1, np.int64)
    lo = (vs >> AT) & 0xFFFFFFFF
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + (vs & 63) - 1 + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


CUT_T = "doc_id long, tag long, n_bytes long, n_removed long, n_spans long, kept binary"


def removed(docs: DataFrame, length: int = LENGTH, marks=sampled) -> DataFrame:
    """(doc_id, tag, n_bytes, n_removed, n_spans, kept) of every row; kept: the bytes that stay.  marks: ``sampled`` or ``doubled``."""
    free = free_id(docs)
    has, others = by_text(keyed(docs, free), marks(docs, free, length))

    def run(batches):
        for batch in batches:
            texts, lists = batch.column(2).to_pylist(), batch.column(3)  # texts are compressed
            for a in range(0, batch.num_rows, 1000):
                raws = [zstandard.decompress(t) for t in texts[a : a + 1000]]
                rows = [cut(raw, None if vs is None else np.array(vs, np.int64), length) for raw, vs in zip(raws, lists.slice(a, 1000).to_pylist())]
                ids = [None if d == LAST else d + (d >= free) for d in batch.column(0).slice(a, 1000).to_pylist()]
                yield pa.record_batch([pa.array(ids, pa.int64()), batch.column(1).slice(a, 1000), pa.array(list(map(len, raws)), pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.binary())], names=["doc_id", "tag", "n_bytes", "n_removed", "n_spans", "kept"])

    out = has.mapInArrow(run, CUT_T)
    if others is not None:
        zero = F.lit(0).cast("long")
        out = out.union(others.select(F.when(F.col("doc") < free, F.col("doc")).when(F.col("doc") < LAST, F.col("doc") + 1), "tag", F.octet_length("text").cast("long"), zero, zero, F.col("text").cast("binary")))
    return out


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with text cut (bytes of characters that were cut in two go as well) and n_chars counted anew; other columns stay."""
    fields = docs.schema.fields
    tag = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that no column's name clashes with doc, tag or vs
    free = free_id(docs)
    base = docs.select(coded(F.col("doc_id"), free).alias("doc"), tag.alias("tag"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    has, others = by_text(base, sampled(docs, free, length), lambda df: df)
    both = has.select(*names.values(), "vs").toDF(*docs.columns, "vs" if "vs" not in docs.columns else "_vs")

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                columns, names = list(batch.columns[:-1]), batch.schema.names[:-1]
                at = names.index("text")
                old = columns[at].to_pylist()
                texts = [t if t is None or not v else cut(t.encode(), np.array(v, np.int64), length)[0].decode(errors="ignore") for t, v in zip(old, batch.columns[-1].to_pylist())]
                if "n_chars" in names:
                    n = names.index("n_chars")
                    columns[n] = pa.array([k if t == o else len(t) for t, o, k in zip(texts, old, columns[n].to_pylist())], columns[n].type)
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = both.mapInArrow(run, T.StructType(fields))
    return out if others is None else out.union(others.select(*names.values()))


def brute(rows: list[tuple[int | None, str | None]], length: int = LENGTH) -> list[tuple]:
    """The same by a dictionary of all windows, for tests."""
    least: dict[bytes, int] = {}
    for d, t in rows:
        raw, d = (t or "").encode(), LAST + 1 if d is None else d
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            least[w] = min(d, least.get(w, d))
    out = []
    for d, t in rows:
        raw, k = (t or "").encode(), LAST + 1 if d is None else d
        vs = [p << AT | 1 for p in range(len(raw) - length + 1) if least[raw[p : p + length]] < k]
        kept, n, runs = cut(raw, np.array(vs, np.int64), length)
        out.append((d, len(raw), n, runs, hashlib.sha256(kept).hexdigest()))
    return out


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
