"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

Words are counted over all texts by Spark.  Each word of L letters has L + 1 bigrams, one
pad before and one after it; words one edit apart share at least max(L) - 1 of them (the
count filter's bound), at places that differ by no more than their lengths do.  Bigrams are ordered by
how rare they are, so by the bound two such words share DEPTH of the rarest DEPTH + 2: the index
has a posting for each way to choose them (``postings``), and Spark's external sort
merges the postings of a choice, by rising length.  Each task walks its merged postings as a heap
merge would, under the length limit, counts the bigrams shared under the position limit, keeps
pairs that reach the bound and verifies these (``Walk``).  A pair that meets under several
choices counts at the least.  A choice with more than HOT words is not compared there: by the
bound, its words share DEEPER more of their next rarest bigrams (all but two, in words of up to
17 letters), and meet again under choices of these.

Defined cases: null and empty texts have no words; a null id counts as an empty text
before the colon; rows that repeat an id or a text count as often as they stand; an
empty table gives no rows; other columns are not read.  Words may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, dropped, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = "[A-Za-zÀ-ÿ]+"
#: Letters are single bytes of Latin-1, so there are at most so many bigrams; pads are the byte 0.
GRAMS = 1 << 16
DEPTH, DEEPER, Q = 4, 12, 2
#: Words of a choice that are compared where they meet; numbers of a block of pairs; the rarest bigrams of a word that choices are made from.
HOT, BLOCK, RANKED = 1000, 1 << 22, 62
#: Marks postings of a second choice.
LAST = -1
POSTING = "key long, first long, used long, word string, n long"
FOUND = "word string, near string, near_n long, key long, first long, used long, n long"


def word_counts(docs: DataFrame, least_letters: int = 5, least_count: int = 3, one_in: int = 97) -> DataFrame:
    """(word, n): lower-cased runs of letters, one in ``one_in`` with a letter deleted, as the crc32 of doc_id and run has it."""
    runs = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"({RUN})"))).alias("run"))
    runs = runs.where(F.length("run") >= least_letters).select("id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    cut = F.expr("concat(substring(run, 1, int(h % length(run))), substring(run, int(h % length(run)) + 2))")
    words = runs.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Words:
    """Words of one Arrow column as bytes of Latin-1, taken out by length or as rows of a matrix."""

    def __init__(self, column: pa.Array):
        self.lens = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        data = column.buffers()[2]
        size = np.dtype(np.int32).itemsize
        start = int(np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * size)[0]) if len(column) else 0
        self.flat = np.frombuffer(bytes(memoryview(data)[start : start + int(ends.sum())]).decode().encode("latin-1"), np.uint8) if data and len(column) else np.zeros(0, np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]]).astype(np.int64)

    def matrix(self, rows: np.ndarray, width: int, right: bool = False) -> np.ndarray:
        """The words of ``rows`` to the left (or right) of ``width`` columns, pads elsewhere."""
        lens = self.lens[rows][:, None]
        at = np.arange(width)[None, :] - (width - lens if right else 0)
        own = (at >= 0) & (at < lens)
        return np.where(own, self.flat[np.where(own, self.starts[rows][:, None] + at, 0)], 0) if len(self.flat) else np.zeros((len(rows), width), np.uint8)

    def grams(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Bigrams by place: width + 1 columns, of which a word of L letters fills L + 1; 0 elsewhere."""
        m = self.matrix(rows, width).astype(np.uint16)
        edge = np.zeros((len(rows), 1), np.uint16)
        return np.hstack([edge, m]) * np.uint16(256) + np.hstack([m, edge])

    def by_length(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(length, rows) in blocks of at most BLOCK bytes."""
        order = rows[np.argsort(self.lens[rows], kind="stable")]
        lens = self.lens[order]
        for part in np.split(order, np.flatnonzero(np.diff(lens)) + 1) if len(order) else []:
            width = int(self.lens[part[0]])
            step = max(1, BLOCK // (width + 1))
            for a in range(0, len(part), step):
                yield width, part[a : a + step]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer of xor, shift and multiply."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def choices(words: Words, width: int, rows: np.ndarray, used: np.ndarray, start: np.ndarray, rank: np.ndarray, depth: int, spare: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, used) of words of one length, a column for each choice of ``depth`` of the rarest ``depth + spare`` bigrams that ``used`` has no bit for.

    Bigrams stand by rarity, repeats told apart by their number; a choice's key starts from ``start``, and its ``used`` has its own bits too.
    """
    n = len(rows)
    tokens = np.sort(rank[words.grams(rows, width)].astype(np.int64), axis=1)[:, :RANKED]
    same = np.concatenate([np.zeros((n, 1), bool), tokens[:, 1:] == tokens[:, :-1]], axis=1)
    column = np.arange(tokens.shape[1])
    repeat = column - np.maximum.accumulate(np.where(same, -1, column), axis=1)
    tokens = tokens * (RANKED + 1) + repeat
    at = np.argsort((used[:, None] >> column) & 1, axis=1, kind="stable")[:, : depth + spare]
    near = mixed(np.take_along_axis(tokens, at, 1).astype(np.uint64) + np.uint64(1))
    ways = list(combinations(range(depth + spare), depth))
    keys, bits = np.empty((n, len(ways)), np.int64), np.empty((n, len(ways)), np.int64)
    for i, way in enumerate(ways):
        h = mixed(start.astype(np.uint64))
        for j in way:
            h = mixed(h * np.uint64(31) + near[:, j])
        keys[:, i] = h.astype(np.int64)
        bits[:, i] = used | np.bitwise_or.reduce(np.int64(1) << at[:, list(way)], axis=1, initial=0)
    return keys, bits


def first_keys(words: Words, width: int, rows: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    zero = np.zeros(len(rows), np.int64)
    return choices(words, width, rows, zero, zero, rank, DEPTH, Q)


def next_keys(words: Words, width: int, rows: np.ndarray, used: np.ndarray, start: np.ndarray, rank: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of a second choice, apart for pairs whose longer word has as many letters and for those where it has one more."""
    for longest in (width, width + 1):
        depth = min(DEEPER, longest - 1 - DEPTH, RANKED - Q - DEPTH)
        yield choices(words, width, rows, used, start + longest, rank, depth, width - longest + Q)[0]


def postings(words: DataFrame, rank, again: bool = False) -> DataFrame:
    """POSTING rows of ``words`` (key, first, used, word, n): of all words, or again of those under a key that was too full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, used = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            whole = Words(b.column(3))
            for width, rows in whole.by_length(np.arange(len(whole.lens))):
                if again:
                    made = [(k, np.full(k.shape, LAST)) for k in next_keys(whole, width, rows, used[rows], key[rows], rank.value)]
                else:
                    made = [first_keys(whole, width, rows, rank.value)]
                for keys, masks in made:
                    order = np.argsort(keys, axis=1, kind="stable")
                    keys, masks = np.take_along_axis(keys, order, 1), np.take_along_axis(masks, order, 1)
                    own = np.concatenate([np.ones((len(rows), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
                    r, c = np.nonzero(own)
                    at, k = pa.array(rows[r]), keys[r, c]
                    first = key[rows[r]] if again else k
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(first), pa.array(masks[r, c]), b.column(3).take(at), b.column(4).take(at)], names=["key", "first", "used", "word", "n"])

    return words.select("key", "first", "used", "word", "n").mapInArrow(run, POSTING)


def one_edit(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (words of ``b`` as long as ``a``'s or one longer) are one edit apart: the count filter, then an exact test."""
    out = np.zeros(len(a), bool)
    order = np.argsort(words.lens[b], kind="stable")
    at = 0
    while at < len(order):
        # a block's width is its last word's, so that one very long word doesn't widen the others' rows
        step = max(1, BLOCK // (8 * (int(words.lens[b[order[at]]]) + 2)))
        part = order[at : at + step]
        part = part[words.lens[b[part]] <= 2 * words.lens[b[order[at]]]]
        at += len(part)
        x, y = a[part], b[part]
        width = int(words.lens[y].max())
        gx, gy = words.grams(x, width), words.grams(y, width)
        own = np.arange(width + 1) <= words.lens[x][:, None]
        longer = (words.lens[y] > words.lens[x])[:, None]
        shared = own & ((gx == gy) | (longer & (gx == np.hstack([gy[:, 1:], np.zeros((len(y), 1), np.uint16)]))))
        live = np.flatnonzero(shared.sum(axis=1) >= words.lens[y] - 1)
        if not len(live):
            continue
        x, y = x[live], y[live]
        left = words.matrix(x, width) == words.matrix(y, width)
        right = words.matrix(x, width, True) == words.matrix(y, width, True)
        head = np.where(left.all(axis=1), width, np.argmin(left, axis=1))
        tail = np.where(right.all(axis=1), width, np.argmin(right[:, ::-1], axis=1))
        equal = words.lens[x] == words.lens[y]
        good = np.where(equal, (~left).sum(axis=1) == 1, head + tail >= words.lens[x])
        out[part[live[good]]] = True
    return out


class Walk:
    """Walks the merged postings of a task, choice by choice, and gives the pairs to be counted there."""

    def __init__(self, rank: np.ndarray, most: int):
        self.rank, self.most = rank, most

    def pairs(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """``batch``: whole choices, postings in order of key and length."""
        key, first, used = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        words, n = Words(batch.column(3)), batch.column(4).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.repeat(np.diff(np.append(edges, len(key))), np.diff(np.append(edges, len(key))))
        full = (size > self.most) & (used != LAST)
        if full.any():
            yield _rows(batch.filter(pa.array(full)))
        act = np.flatnonzero(~full & (size > 1))
        step, found, held = 1, [], 0
        while len(act):
            act = act[act + step < len(key)]
            act = act[(key[act] == key[act + step]) & (words.lens[act + step] <= words.lens[act] + 1)]
            if len(act):
                found.append((act, act + step))
                held += len(act)
            step += 1
            if held >= BLOCK // 8 or not len(act):
                if found:
                    yield from self.verified(words, batch.column(3), n, key, first, *(np.concatenate(x) for x in zip(*found)))
                found, held = [], 0

    def verified(self, words, column, n, key, first, a, b) -> Iterator[pa.RecordBatch]:
        good = one_edit(words, a, b)
        a, b = a[good], b[good]
        if not len(a):
            return
        # A pair counts under the least of the first choices that both words have.
        rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        keys = np.concatenate([first_keys(words, width, part, self.rank)[0] for width, part in words.by_length(rows)])
        keys = keys[np.argsort(np.concatenate([np.searchsorted(rows, part) for _, part in words.by_length(rows)]))]
        own = np.zeros(len(a), bool)
        for at in range(0, len(a), BLOCK >> 8):
            x, y = (keys[place[p + at : p + min(at + (BLOCK >> 8), len(a))]] for p in (0, len(a)))
            both = (x[:, :, None] == y[:, None, :]).any(axis=2)
            own[at : at + len(x)] = np.where(both, x, np.iinfo(np.int64).max).min(axis=1) == first[a[at : at + len(x)]]
        a, b = a[own], b[own]
        if len(a):
            x, y = (pa.array(np.concatenate(p)) for p in ((a, b), (b, a)))
            yield _rows(None, column.take(x), column.take(y), pa.array(n).take(y))


def _rows(full: pa.RecordBatch | None, word=None, near=None, near_n=None) -> pa.RecordBatch:
    names = ["word", "near", "near_n", "key", "first", "used", "n"]
    if full is None:
        none = pa.nulls(len(word), pa.int64())
        return pa.RecordBatch.from_arrays([word, near, near_n, none, none, none, none], names=names)
    none = pa.nulls(full.num_rows, pa.string())
    return pa.RecordBatch.from_arrays([full.column(3), none, pa.nulls(full.num_rows, pa.int64()), *(full.column(i) for i in (0, 1, 2, 4))], names=names)


def met(index: DataFrame, rank, most: int) -> DataFrame:
    """FOUND rows: pairs one edit apart, and the words of choices that were too full (near is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, rest = Walk(rank.value, most), None
        for b in batches:
            b = b if rest is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            key = b.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield from walk.pairs(b.slice(0, cut))
            rest = b.slice(cut)
            if rest.num_rows > max(most, 1) and rest.column(2)[0].as_py() != LAST:
                # more words than are compared here: they go on; one word too many stays, as the mark of a full choice
                yield _rows(rest.slice(0, rest.num_rows - most - 1))
                rest = rest.slice(rest.num_rows - most - 1)
        if rest is not None and rest.num_rows:
            yield from walk.pairs(rest)

    return index.repartition("key").sortWithinPartitions("key", F.length("word")).mapInArrow(run, FOUND)


def near_words(words: DataFrame, most: int = HOT) -> DataFrame:
    """(word, near, near_n): each pair of words one edit apart, both ways; words: (word, n), each word once, of more than DEPTH letters."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRAMS, np.int64)
        for b in batches:
            whole = Words(b.column(0))
            for width, rows in whole.by_length(np.arange(len(whole.lens))):
                total += np.bincount(whole.grams(rows, width).ravel(), minlength=GRAMS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    spark = words.sparkSession
    often = words.select("word").mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most GRAMS rows
    count = np.zeros(GRAMS, np.int64)
    count[often.column("gram").to_numpy()] = often.column("n").to_numpy()
    order = np.lexsort((np.arange(GRAMS), count))
    place = np.empty(GRAMS, np.int32)
    place[order] = np.arange(GRAMS, dtype=np.int32)
    rank = spark.sparkContext.broadcast(place)
    start = words.select(*(F.lit(0).cast("long").alias(c) for c in ("key", "first", "used")), "word", "n")
    found = written(met(postings(start, rank), rank, most), "spelling-pairs")
    pairs = found.where("near IS NOT NULL").select("word", "near", "near_n")
    full = found.where("near IS NULL").select("key", "first", "used", "word", "n")
    if full.isEmpty():
        return pairs
    # a pair may meet under several of the second choices
    return pairs.unionByName(written(met(postings(full, rank, True), rank, most), "spelling-pairs").select("word", "near", "near_n").distinct())


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): pointers doubled until none moves; a form occurs twice as often as its word, so chains are short."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        new = written(at.join(on, at.root == on["_w"], "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        moved = not new.where("moved").isEmpty()
        dropped(at)
        at = new.select("word", "root")
        if not moved:
            return at


def variants(docs: DataFrame, most: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of at least 5 letters that occur 3 times."""
    words = written(word_counts(docs), "spelling-words")
    best = near_words(words, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("best"))
    form = F.when(-F.col("best.m") >= 2 * F.col("n"), F.col("best.form"))
    out = words.join(best, "word", "left").select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), -F.col("best.m")).alias("form_n"))
    out = written(out, "spelling-forms")
    root = roots(out.where("form IS NOT NULL"))
    return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir).select("doc_id", "text"))
