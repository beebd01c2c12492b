"""Exact top-k inner products by norm buckets.

Vectors become integers floor(scale * x) and are written once, range-partitioned by
length (ties by a hash, so that vectors of one length are split too), the longest
first: each task reads buckets of falling length.  Queries form slices of bounded
size; a slice is broadcast, and all candidates are scanned where they lie, so no
candidate is shuffled.  First the slice meets a few rows only (the longest and a hash
sample), which gives each query a score that its k-th best can't fall below.  Divided
by the query's length and the longest of a bucket that floor is a local cosine
threshold: over 1, the query skips the bucket; over ``HIGH`` it prunes by length, as
only the bucket's first rows are long enough; over ``LOW`` by coordinates, by partial
products over its largest ones plus the Cauchy-Schwarz bound of the rest; under it no
pruning pays.  What is left is verified by exact integer products.  Floors rise as a
task goes on, and each task returns at most k rows a query.

Defined cases: vectors that are null or hold null or non-finite components take no
part; shorter vectors count as filled up with zeros, an empty one as all zeros;
ties go to the smaller id; rows with a null id take no part; repeated ids are rows
of their own, a query never meets rows of its own id, and its repeated rows have one
result, that of the greatest vector; an empty table gives no rows; other columns are
not read.  Products are exact while they fit 64 bits.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

COORDS, LOW, HIGH = 16, 0.3, 0.8
#: A slice of queries is at most so many numbers (32 MB), and SLICES of them are scored in one scan; the floors come from about SAMPLE candidates.
SLICE, SLICES, SAMPLE = 1 << 22, 4, 8192
LEAST = -(1 << 62)
FOUND = "query_id long, vec_id long, score long"


def integers(rows: DataFrame, vec: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>, norm double) of the rows that take part."""
    whole = F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    good = F.col(vec).isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(vec, lambda x: F.coalesce(F.isnan(x) | (F.abs(x.cast("double")) == float("inf")), F.lit(True)))
    out = rows.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def matrix(values: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of an array column, filled up with zeros or cut to ``dim``."""
    flat, ends = values.flatten().to_numpy(zero_copy_only=False), values.offsets.to_numpy() - values.offsets[0].as_py()
    lens = np.diff(ends)
    if (lens == dim).all():
        return flat.reshape(len(lens), dim)
    out = np.zeros((len(lens), dim), np.int64)
    row = np.repeat(np.arange(len(lens)), lens)
    at = np.arange(len(flat)) - np.repeat(ends[:-1], lens)
    own = at < dim  # what a query lacks is zero
    out[row[own], at[own]] = flat[own]
    return out


class Search:
    """The k best candidates so far of each of a slice's queries; ``meet`` takes a bucket's rows, the longest first."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.q, self.k, self.floor = ids[order], q[order], k, floor[order].copy()
        self.norm = np.sqrt((self.q.astype(np.float64) ** 2).sum(axis=1))
        self.top = np.argsort(-np.abs(self.q), axis=1, kind="stable")[:, : min(COORDS, q.shape[1])]
        part = np.take_along_axis(self.q, self.top, 1).astype(np.float64)
        self.rest = np.sqrt(np.maximum(0.0, self.norm**2 - (part**2).sum(axis=1)))
        self.most = float(np.abs(q).max(initial=0))
        self.best = [np.zeros(0, np.int64)] * 3  # query's place, candidate, score

    def exact(self, rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Integer products; by floating point where that is exact."""
        if self.most * float(np.abs(c).max(initial=0)) * max(1, c.shape[1]) < 2**52:
            return np.rint(self.q[rows].astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
        return self.q[rows] @ c.T

    def meet(self, c_ids: np.ndarray, c: np.ndarray, norm: np.ndarray) -> None:
        if not len(c_ids) or not len(self.ids):
            return
        reach = self.norm * norm[0]
        cosine = np.where(self.floor > 0, self.floor / np.maximum(reach, 1e-300), np.where(self.floor > LEAST, 0.0, -1.0))
        live = cosine <= 1 + 1e-9
        found = []

        def keep(rows, n, scores):  # n: the candidates' places
            at, j = np.nonzero(scores >= self.floor[rows][:, None])
            own = rows[at]
            other = c_ids[n[j]] != self.ids[own]
            found.append((own[other], c_ids[n[j]][other], scores[at, j][other]))

        every = np.arange(len(c_ids))
        plain = np.flatnonzero(live & (cosine <= LOW))
        for a in range(0, len(plain), 128):
            rows = plain[a : a + 128]
            keep(rows, every, self.exact(rows, c))
            if (self.floor[rows] == LEAST).any():
                self.settle(found)
                found.clear()
        by_length = np.flatnonzero(live & (cosine > HIGH))
        need = self.floor[by_length] / np.maximum(self.norm[by_length], 1e-300) * (1 - 1e-9)
        by_length = by_length[np.argsort(-need, kind="stable")]
        for a in range(0, len(by_length), 64):  # queries of like need share their candidates
            rows = by_length[a : a + 64]
            n = int(np.searchsorted(-norm, -float(np.sort(need)[::-1][a : a + 64].min()), "right"))
            keep(rows, every[:n], self.exact(rows, c[:n]))
        by_coords = np.flatnonzero(live & (cosine > LOW) & (cosine <= HIGH))
        if len(by_coords):
            turned = np.ascontiguousarray(c.T).astype(np.float64)
            squares = turned**2
            whole = squares.sum(axis=0)
            for i in by_coords:
                top = self.top[i]
                bound = self.q[i, top].astype(np.float64) @ turned[top] + self.rest[i] * np.sqrt(np.maximum(0, whole - squares[top].sum(axis=0)))
                n = np.flatnonzero(bound >= self.floor[i] - 1e-6 * abs(float(self.floor[i])) - 1e-3)
                if len(n):
                    keep(np.array([i]), n, self.exact(np.array([i]), c[n]))
        self.settle(found)

    def settle(self, found: list) -> None:
        """Keeps the k best of each query, and raises its floor once it has k."""
        q, c, s = (np.concatenate(x) for x in zip(self.best, *found))
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        own = place < self.k
        self.best = [q[own], c[own], s[own]]
        full = own & (place == self.k - 1)
        self.floor[q[full]] = np.maximum(self.floor[q[full]], s[full])


def scan(candidates: DataFrame, held: list, k: int) -> DataFrame:
    """At most k rows a query and task; held: the broadcast (ids, matrix, floors) of some slices."""

    def run(batches):
        parts = [h.value for h in held]
        searches, dim = [Search(ids, q, floor, k) for ids, q, floor in parts], parts[0][1].shape[1]
        for batch in batches:
            norm = batch.column(2).to_numpy()
            order = np.argsort(-norm, kind="stable")
            rows = batch.column(0).to_numpy()[order], matrix(batch.column(1), dim)[order], norm[order]
            for search in searches:
                search.meet(*rows)
        for search in searches:
            own, vec_id, score = search.best
            for a in range(0, len(own), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 50_000]) for x in (search.ids[own], vec_id, score)], names=["query_id", "vec_id", "score"])

    return candidates.select("vec_id", "v", "norm").mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec: str = "embedding", most: int = SLICE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each row under ``is_query`` (a condition on vec_id).

    most: numbers of a slice of queries, the only rows that pass through the driver, a slice at a time; SLICES of them live at once.
    """
    spark = vectors.sparkSession
    by = [F.col("norm").desc(), F.xxhash64("vec_id")]
    ints = written(integers(vectors, vec, scale).repartitionByRange(*by).sortWithinPartitions(*by), "topk-integers")
    total, dim = ints.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    queries = ints.where(is_query).groupBy("vec_id").agg(F.max("v").alias("v"))
    slices = max(1, -(-queries.count() * max(1, dim) // most))
    edge = ints.agg(F.percentile_approx("norm", 1 - min(1.0, SAMPLE / 2 / max(1, total)), 10_000)).first()[0] or 0.0
    often = F.lit(max(1, 2 * total // SAMPLE))
    sample = ints.where((F.pmod(F.xxhash64("vec_id", F.lit(1)), often) == 0) | (F.col("norm") > edge))  # any rows give true floors
    found = []
    for first in range(0, slices, SLICES):
        sent = [slice_of(queries, sample, slices, i, dim, k) for i in range(first, min(slices, first + SLICES))]
        # A scan's result is written, so that its slices need not live on.
        found.append(written(scan(ints, sent, k), "topk-found"))
        for s in sent:
            s.destroy()
    return ranked(reduce(DataFrame.union, found), k).select("query_id", "rank", "vec_id", "score")


def slice_of(queries: DataFrame, sample: DataFrame, slices: int, i: int, dim: int, k: int):
    """The broadcast (ids, matrix, floors) of slice i; the floors come from the sample."""
    context = queries.sparkSession.sparkContext
    own = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(slices)) == i).toArrow()
    ids = own.column("vec_id").to_numpy()
    rows = own.column("v").combine_chunks()
    rows = matrix(rows if isinstance(rows, pa.Array) else pa.array([], pa.list_(pa.int64())), dim)
    floor = np.full(len(ids), LEAST, np.int64)
    bare = context.broadcast((ids, rows, floor))
    near = ranked(scan(sample, [bare], k), k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    floors = near.where(F.col("n") == k).select("query_id", "s").toArrow()
    bare.destroy()
    at = np.argsort(ids, kind="stable")
    floor[at[np.searchsorted(ids[at], floors.column(0).to_numpy())]] = floors.column(1).to_numpy()
    return context.broadcast((ids, rows, floor))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
