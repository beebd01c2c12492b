"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

What is predicted is a word's leaf: the 128 most frequent words are leaves of their
own, the others share 128 more by their last bytes.  A leaf's probability given the
words before it is that of its class (16) times its own within the class (16), both
softmaxes over sums of hashed features: the last word by its own hash, whatever its
leaf, and the leaves of the last word, of the last two and of the second last (a
skip).  A word within a shared leaf has its smoothed share of the leaf's training counts.  Text beginnings have a
word of their own as context.  The tables of hashed features have 2**15 and 2**17 rows
(10 MB a task and copy; fewer only where there are under 4096 distinct training words).

Training goes over every training document once, in rounds of disjoint documents, one
more for each doubling of the training words over ``ROUND_TOKENS``.  In a round each
task takes gradient steps on a copy of the weights, and
the copies' changes are averaged by words; only the averaged tables, of fixed size,
reach the driver.  The counts of all training words stay a distributed table: the
most frequent 2**18 are broadcast (a bound), and the counts of other words are
joined to each document's rare words.

Defined cases: a null text is an empty one: its end alone; a null doc_id is neither
held out nor learned from (held_out is null); rows are scored each for itself,
repeated ids too; without training documents counts are 0 and the model is uniform
over leaves; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import documents, fold, written

K1, K2, TOP = 16, 16, 128
LEAVES = K1 * K2
START = np.uint64(0x2545F4914F6CDD1D)
FREQUENT = 1 << 18
BITS1, BITS2, FEATURES = 15, 17, 4
ROUNDS, ROUND_TOKENS, BATCH, RATE, DAMPING = 2, 40_000_000, 8192, 0.5, 1.0
END = np.uint64(0x5851F42D4C957F2D)
CHUNK = 2_000_000


class Lookup:
    """Numbers of 64-bit keys, by open addressing; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.mask = (1 << max(4, int(4 * len(keys)).bit_length())) - 1
        self.keys, self.place = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int32)
        at, left = (keys & np.uint64(self.mask)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.place[at[left]] < 0)
            _, first = np.unique(at[left[free]], return_index=True)
            put = left[free[first]]
            self.keys[at[put]], self.place[at[put]] = keys[put], put
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = (h & np.uint64(self.mask)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        far = np.arange(len(h))
        while len(far):
            place = self.place[at[far]]
            hit = (self.keys[at[far]] == h[far]) & (place >= 0)
            out[far[hit]] = place[hit]
            far = far[~hit & (place >= 0)]
            at[far] = (at[far] + 1) & self.mask
        return out


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shared leaf, row) of each word and each text's end."""
    data = hashing.FOLD[data]
    begin, stop, edges = hashing.word_spans(data, offsets)
    h = hashing.span_hashes(data, begin, stop)
    last = data[stop - 1].astype(np.uint64)
    before = np.where(stop - begin > 1, data[np.maximum(stop - 2, 0)], 0).astype(np.uint64)
    leaf = (hashing.mix(last * np.uint64(256) + before, 11) % np.uint64(LEAVES - TOP)).astype(np.int64) + TOP
    n = np.diff(edges)
    row = np.repeat(np.arange(len(n)), n)
    size = len(h) + len(n)
    at = np.arange(len(h)) + row
    ends = np.cumsum(n + 1) - 1
    out_h, out_leaf, out_row = np.full(size, END), np.full(size, TOP), np.zeros(size, np.int64)
    out_h[at], out_leaf[at], out_row[at], out_row[ends] = h, leaf, row, np.arange(len(n))
    return out_h, out_leaf, out_row


def counted(batches):
    """(h, leaf, n) of the words of chunks."""
    parts, size = [], 0

    def flush():
        h, leaf = (np.concatenate(x) for x in zip(*parts))
        keys, first, n = np.unique(h, return_index=True, return_counts=True)
        for a in range(0, len(keys), 100_000):
            own = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(keys[own].view(np.int64)), pa.array(leaf[first[own]].astype(np.int32)), pa.array(n[own].astype(np.int64))], names=["h", "leaf", "n"])

    for batch in batches:
        for _, data, offsets in hashing.texts_of(batch.column(0)):
            h, leaf, _ = tokens_of(data, offsets)
            parts.append((h, leaf))
            size += len(h)
            if size >= CHUNK:
                yield from flush()
                parts, size = [], 0
    if parts:
        yield from flush()


def contexts(h: np.ndarray, row: np.ndarray, leaf: np.ndarray | None = None) -> np.ndarray:
    """Feature hashes (n x FEATURES, uint64) of the words before each word, and of the last two's leaves."""
    h = h.astype(np.uint64)
    padded, coarse = (np.concatenate([np.full(2, START), x]) for x in (h, h if leaf is None else leaf.astype(np.uint64)))
    n = len(row)
    same = [np.concatenate([np.zeros(min(k, n), bool), row[k:] == row[: max(0, n - k)]]) for k in (1, 2)]
    one = np.where(same[0], padded[1 : 1 + n], START)
    first, second = (np.where(s, coarse[2 - k : 2 - k + n], START) for k, s in zip((1, 2), same))
    p = np.uint64(hashing.P)
    return np.stack([hashing.mix(x, seed) for seed, x in enumerate((first, first * p + second, second, one), 21)], axis=1)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def bits_for(distinct: int) -> tuple[int, int]:
    """Table sizes, as powers of two, for so many distinct training words."""
    n = max(1, int(distinct)).bit_length()
    return min(BITS1, max(10, n + 2)), min(BITS2, max(12, n + 4))


class Model:
    """Weights of the class level (hashed features x K1) and of the leaf level (hashed features and class x K2)."""

    def __init__(self, w1: np.ndarray, w2: np.ndarray, b1: np.ndarray, b2: np.ndarray):
        self.w1, self.w2, self.b1, self.b2 = w1, w2, b1, b2
        self.down1, self.down2 = (np.uint64(65 - len(w).bit_length()) for w in (w1, w2))

    @classmethod
    def start(cls, counts: np.ndarray, bits: tuple[int, int] = (BITS1, BITS2)) -> "Model":
        """Biases from the leaves' counts, no other weight."""
        by = (counts.astype(np.float64) + 0.5).reshape(K1, K2)
        w1, w2 = (np.zeros((1 << b, k), np.float32) for b, k in zip(bits, (K1, K2)))
        return cls(w1, w2, np.log(by.sum(axis=1) / by.sum()).astype(np.float32), np.log(by / by.sum(axis=1, keepdims=True)).astype(np.float32))

    def rows(self, f: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r1 = (f >> self.down1).astype(np.int64)
        r2 = (((f ^ (cls[:, None].astype(np.uint64) * np.uint64(hashing.P))) * np.uint64(0xBF58476D1CE4E5B9)) >> self.down2).astype(np.int64)
        return r1, r2

    def sums(self, r1: np.ndarray, r2: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z1, z2 = self.w1[r1[:, 0]] + self.b1, self.w2[r2[:, 0]] + self.b2[cls]
        for k in range(1, FEATURES):
            z1 += self.w1[r1[:, k]]
            z2 += self.w2[r2[:, k]]
        return z1, z2

    def log10(self, leaf: np.ndarray, f: np.ndarray) -> np.ndarray:
        cls, own = leaf // K2, leaf % K2
        z1, z2 = self.sums(*self.rows(f, cls), cls)
        at = np.arange(len(leaf))
        out = np.zeros(len(leaf))
        for z, y in ((z1, cls), (z2, own)):
            m = z.max(axis=1)
            out += (z[at, y] - m - np.log(np.exp(z - m[:, None]).sum(axis=1))).astype(np.float64)
        return out / np.log(10)

    def step(self, leaf: np.ndarray, f: np.ndarray, past: tuple[np.ndarray, np.ndarray], rate: float) -> None:
        """One gradient step on a batch; ``past`` sums the squared gradients of each table row, which scale its steps."""
        cls, own = leaf // K2, leaf % K2
        r1, r2 = self.rows(f, cls)
        z1, z2 = self.sums(r1, r2, cls)
        at = np.arange(len(leaf))
        for w, r, z, y, g2 in ((self.w1, r1, z1, cls, past[0]), (self.w2, r2, z2, own, past[1])):
            p = softmax(z)
            p[at, y] -= 1
            flat = np.flatnonzero(np.bincount(r.ravel(), minlength=len(w)))  # the table's rows that are met
            place = np.zeros(len(w), np.int64)
            place[flat] = np.arange(len(flat)) * w.shape[1]
            begin, column, p = place[r], np.arange(w.shape[1]), p.astype(np.float64).ravel()
            g = np.zeros(len(flat) * w.shape[1])
            for i in range(FEATURES):
                g += np.bincount((begin[:, i, None] + column).ravel(), weights=p, minlength=len(g))
            g = g.astype(np.float32).reshape(-1, w.shape[1])
            g2[flat] += np.einsum("ij,ij->i", g, g)
            g *= (rate / np.sqrt(g2[flat] / w.shape[1] + DAMPING)).astype(np.float32)[:, None]
            w[flat] -= g


def gradient_task(model: Model, top: np.ndarray, rate: float):
    """Trains a copy on the task's texts and gives its change, weighted by words, in parts of fixed size."""

    def run(batches):
        find = Lookup(top)
        own = Model(model.w1.copy(), model.w2.copy(), model.b1, model.b2)
        past = (np.zeros(len(own.w1)), np.zeros(len(own.w2)))
        n = 0
        for batch in batches:
            for _, data, offsets in hashing.texts_of(batch.column(0)):
                h, leaf, row = tokens_of(data, offsets)
                rank = find(h)
                leaf = np.where(rank >= 0, rank, leaf)
                f = contexts(h, row, leaf)
                for a in range(0, len(leaf), BATCH):
                    own.step(leaf[a : a + BATCH], f[a : a + BATCH], past, rate)
                n += len(leaf)
        if n:
            delta = np.concatenate([(own.w1 - model.w1).ravel(), (own.w2 - model.w2).ravel()])
            for i, part in enumerate(np.split(delta, PARTS)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n], pa.int64()), pa.array([zstandard.compress(part.astype(np.float16).tobytes(), 1)], pa.binary())], names=["part", "n", "delta"])

    return run


PARTS = 16


def averaged(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zstandard.decompress(d), np.float16).astype(np.float64) * n for d, n in zip(pdf.delta, pdf.n))
    return pd.DataFrame({"part": [pdf.part.iloc[0]], "n": [int(pdf.n.sum())], "delta": [zstandard.compress((total / pdf.n.sum()).astype(np.float16).tobytes(), 1)]})


def summed(changes: DataFrame) -> DataFrame:
    """Averages in two steps, so that no task holds the changes of all others: first by part and group of tasks."""
    apart = changes.withColumn("group", F.pmod(F.xxhash64("n", "delta"), F.lit(32)))
    first = apart.groupBy("part", "group").applyInPandas(averaged, "part int, n long, delta binary")
    return first.groupBy("part").applyInPandas(averaged, "part int, n long, delta binary")


def train(texts: DataFrame, leaf_counts: np.ndarray, top: np.ndarray, rounds: int, bits: tuple[int, int], rate: float = RATE) -> Model:
    """texts: (text, round) of the training documents."""
    model = Model.start(leaf_counts, bits)
    for i in range(rounds):
        changes = texts.where(F.col("round") == i).select("text").mapInArrow(gradient_task(model, top, rate / (i + 1)), "part int, n long, delta binary")
        parts = sorted((r.part, r.delta) for r in summed(changes).collect())
        if parts:
            delta = np.concatenate([np.frombuffer(zstandard.decompress(d), np.float16) for _, d in parts]).astype(np.float32)
            model = Model(model.w1 + delta[: model.w1.size].reshape(model.w1.shape), model.w2 + delta[model.w1.size :].reshape(model.w2.shape), model.b1, model.b2)
    return model


DOC_T = "rid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, model double, h long, m long"


def scoring_task(model: Model, top: np.ndarray, keys: np.ndarray, counts: np.ndarray, norms: np.ndarray):
    """Rows of documents (h null) and of their rare words (doc columns null).

    norms: log10 of each leaf's smoothed total; logs: the sum of log10(count + 0.5)
    of frequent words; model: the rest of the model's log10 probability.
    """

    def run(batches):
        find_top, find = Lookup(top), Lookup(keys)
        logs_of = np.log10(counts + 0.5)
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, data, offsets in hashing.texts_of(batch.column(2)):
                n = len(offsets) - 1
                h, leaf, row = tokens_of(data, offsets)
                rank, place = find_top(h), find(h)
                leaf = np.where(rank >= 0, rank, leaf)
                f = contexts(h, row, leaf)
                p = np.concatenate([model.log10(leaf[a : a + BATCH], f[a : a + BATCH]) for a in range(0, len(leaf), BATCH)])
                had = place >= 0
                own = np.where(had, logs_of[np.maximum(place, 0)], 0.0) if len(logs_of) else np.zeros(len(h))
                # A word that is a leaf alone has all of it; its count stands in ``logs`` for the base, so it is taken out here.
                p += np.where(rank >= 0, -own, -norms[leaf])
                sums = [np.bincount(row, weights=x, minlength=n) for x in (np.ones(len(h)), had, own, p)]
                ids = rid + np.arange(n)
                rid += n
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3]), none, none], names=NAMES)
                rare = np.flatnonzero(~had)
                if len(rare):
                    order = rare[np.lexsort((h[rare], row[rare]))]
                    new = np.ones(len(order), bool)
                    new[1:] = (h[order[1:]] != h[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
                    at = np.flatnonzero(new)
                    times = np.diff(np.append(at, len(order)))
                    k = len(at)
                    gaps = [pa.nulls(k, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row[order[at]]]), *gaps, pa.array(h[order[at]].view(np.int64)), pa.array(times.astype(np.int64))], names=NAMES)

    return run


NAMES = ["rid", "doc_id", "held_out", "n_tokens", "known", "logs", "model", "h", "m"]


def frequent(vocab: DataFrame) -> DataFrame:
    """The most frequent words, at most FREQUENT of them: those over the count that a histogram of counts (a few thousand classes) gives."""
    cls = F.when(F.col("n") <= 4096, F.col("n").cast("double")).otherwise(4096 + F.floor(F.log2(F.col("n").cast("double")) * 64).cast("double"))
    left, least = FREQUENT, float("inf")
    for c, n in sorted((tuple(r) for r in vocab.groupBy(cls).count().collect()), reverse=True):
        left -= n
        if left < 0:
            break
        least = c
    return vocab.where(cls >= least)


def score(docs: DataFrame, held_out: Column, rounds: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from rows whose ``held_out`` is false."""
    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    train_docs = at.where(~F.col("held_out"))
    vocab = written(train_docs.select("text").mapInArrow(counted, "h long, leaf int, n long").groupBy("h").agg(F.first("leaf").alias("leaf"), F.sum("n").alias("n")), "lm-vocabulary")
    total, distinct = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    best = frequent(vocab).toPandas()  # at most FREQUENT rows
    keys, counts = best.h.to_numpy(np.int64).view(np.uint64), best.n.to_numpy(np.int64)
    order = np.lexsort((keys, -counts))
    top = keys[order[:TOP]]
    leaf_counts, leaf_words = np.zeros(LEAVES), np.zeros(LEAVES)
    leaf_counts[: len(top)] = counts[order[:TOP]]
    shared = vocab.where(~F.col("h").isin(top.view(np.int64).tolist())) if len(top) else vocab
    for leaf, n, words in shared.groupBy("leaf").agg(F.sum("n"), F.count("*")).collect():
        leaf_counts[leaf], leaf_words[leaf] = n, words
    rounds = rounds or ROUNDS + max(0, int(total) // ROUND_TOKENS).bit_length()
    model = train(train_docs.select("text", F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)).alias("round")), leaf_counts, top, rounds, bits_for(distinct))
    norms = np.log10(leaf_counts + 0.5 * (leaf_words + 1))
    scored = written(at.mapInArrow(scoring_task(model, top, keys, counts, norms), DOC_T), "lm-scored")
    rare = scored.where("h is not null").select("rid", "h", "m").join(vocab.select("h", "n"), "h", "left")
    rare = rare.groupBy("rid").agg(F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("rare_logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("rare_known"))
    out = scored.where("h is null").join(rare, "rid", "left")
    logs, zero = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)), F.lit(0)
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", zero)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * norm).alias("base_score"), (logs + F.col("model")).alias("score"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), fold(F.col("doc_id"), 5) == 1)
