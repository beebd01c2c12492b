"""Approximate nearest neighbours by inner product: robust-pruned directed graphs, one a shard.

Equal vectors are one node, which keeps its k + 1 smallest ids (no result needs more).
Nodes are dealt into shards of about SHARD rows by a hash of their vector.  A task takes a
shard's nodes in batches: each batch searches the graph that there is, from entry nodes,
greedily (``Graph.beam``); what a search has visited are the proposed neighbours; of these,
nearest first, a node keeps those that no kept one is nearer to by ``alpha`` (``pruned``,
so that edges point in different ways), and fills up with the nearest left over; edges get
their reverse, and full lists are pruned anew.  The largest inner product becomes the
least distance by one more coordinate, sqrt(M^2 - |v|^2) with M the shard's longest.

The index is a table (a row a node: shard, place, ids, vector, neighbours).  A search
sends each query to all shards; a task meets a shard's nodes first, then its queries in
batches, and gives each query's k best by exact products in double precision.

Defined cases: vectors that are null, zero, empty or hold null or non-finite entries and
rows with a null id take no part; shorter vectors count as filled up with zeros; ties go
to the smaller id; repeated ids are rows of their own, a query never meets rows of its own
id, and its repeated rows have one result, that of the greatest vector; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Nodes of a shard, edges of a node, widths of a building and of a query's beam, relaxation.
SHARD, EDGES, BUILD, BEAM, ALPHA = 16384, 32, 64, 96, 1.2
ENTRIES, BATCH, STEP = 16, 256, 4
INDEX = "shard int, place int, ids array<struct<id:long,n:int>>, v array<double>, near array<int>"
FOUND = "query_id long, vec_id long, score double"


class Graph:
    """Nodes x (float32 rows, scaled to at most 1, with the last coordinate) and their neighbours, -1 where there is none."""

    def __init__(self, v: np.ndarray, near: np.ndarray | None = None):
        most = float(np.sqrt((v * v).sum(axis=1).max(initial=0))) or 1.0
        v = v / most
        self.x = np.hstack([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1)))[:, None]]).astype(np.float32)
        self.size = (self.x * self.x).sum(axis=1)
        self.near = np.full((len(v), 2 * EDGES), -1, np.int32) if near is None else near
        self.degree = (self.near >= 0).sum(axis=1)

    def beam(self, q: np.ndarray, width: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, distances) of the ``width`` nearest met by each row of q, and (row, place) of all nodes whose edges were followed, on the first ``count`` nodes."""
        b = len(q)
        seen = np.zeros((b, count), np.int32)
        start = np.arange(min(ENTRIES, count), dtype=np.int32)
        place = np.full((b, width), -1, np.int32)
        dist = np.full((b, width), np.inf, np.float32)
        d = self.size[start] - 2 * (q @ self.x[start].T)
        order = np.argsort(d, axis=1, kind="stable")[:, :width]
        place[:, : order.shape[1]], dist[:, : order.shape[1]] = start[order], np.take_along_axis(d, order, 1)
        seen[:, start] = 1
        done = np.zeros((b, width), bool)
        live, stamp, trail = np.arange(b), 1, []
        while True:
            open_ = ~done[live] & (place[live] >= 0)
            some = open_.any(axis=1)
            live, open_ = live[some], open_[some]
            if not len(live):
                break
            row, col = np.nonzero(open_ & (np.cumsum(open_, axis=1) <= STEP))
            done[live[row], col] = True
            at = place[live[row], col]
            trail.append((live[row], at))
            to = self.near[at]
            r, c = np.nonzero(to >= 0)
            to, row = to[r, c], row[r]
            new = seen[live[row], to] == 0
            to, row = to[new], row[new]
            mark = np.arange(stamp + 1, stamp + 1 + len(to), dtype=np.int32)
            seen[live[row], to] = mark  # of one node met twice, the last stays
            own = seen[live[row], to] == mark
            stamp += len(to)
            to, row = to[own], row[own]
            if not len(to):
                continue
            d = self.size[to] - 2 * np.einsum("ij,ij->i", self.x[to], q[live[row]])
            count_ = np.bincount(row, minlength=len(live))
            pos = np.arange(len(row)) - np.repeat(np.cumsum(count_) - count_, count_)
            p = np.full((len(live), int(count_.max())), -1, np.int32)
            e = np.full(p.shape, np.inf, np.float32)
            p[row, pos], e[row, pos] = to, d
            p, e = np.hstack([place[live], p]), np.hstack([dist[live], e])
            f = np.hstack([done[live], np.zeros((len(live), p.shape[1] - width), bool)])
            order = np.argsort(e, axis=1, kind="stable")[:, :width]
            place[live], dist[live], done[live] = (np.take_along_axis(m, order, 1) for m in (p, e, f))
        row, at = (np.concatenate(x) for x in zip(*trail))
        return place, dist, row, at

    def pruned(self, at: np.ndarray, near: np.ndarray) -> np.ndarray:
        """EDGES of the proposed neighbours ``near`` (-1: none) of each node of ``at``: diverse ones first, then the nearest left over."""
        n, width = near.shape
        near = np.sort(near, axis=1)
        own = (near >= 0) & (near != at[:, None])
        own[:, 1:] &= near[:, 1:] != near[:, :-1]
        e = self.x[near]
        d = self.size[near] + self.size[at][:, None] - 2 * np.einsum("ijk,ik->ij", e, self.x[at])
        d = np.where(own, np.maximum(d, 0), np.inf).astype(np.float32)
        order = np.argsort(d, axis=1, kind="stable")
        near, d, own = (np.take_along_axis(m, order, 1) for m in (near, d, own))
        most = max(1, int(own.sum(axis=1).max(initial=0)))
        near, d, own = near[:, :most], d[:, :most], own[:, :most]
        e = self.x[near]
        between = (self.size[near][:, :, None] + self.size[near][:, None, :] - 2 * (e @ e.transpose(0, 2, 1))) * ALPHA**2
        rows, alive, kept = np.arange(n), own.copy(), np.zeros(own.shape, bool)
        for _ in range(EDGES):
            pick = np.argmax(alive, axis=1)
            ok = alive[rows, pick]
            if not ok.any():
                break
            kept[rows[ok], pick[ok]] = True
            alive &= between[rows, pick] > d
            alive[rows, pick] = False
        rank = np.argsort(np.where(kept, 0, np.where(own, 1, 2)), axis=1, kind="stable")[:, :EDGES]
        out = np.where(np.take_along_axis(own, rank, 1), np.take_along_axis(near, rank, 1), -1)
        return out if out.shape[1] == EDGES else np.hstack([out, np.full((n, EDGES - out.shape[1]), -1, out.dtype)])

    def put(self, at: np.ndarray, near: np.ndarray) -> None:
        self.near[at] = -1
        self.near[at, :EDGES] = near
        self.degree[at] = (near >= 0).sum(axis=1)

    def shrunk(self, at: np.ndarray, extra: np.ndarray) -> None:
        for a in range(0, len(at), BATCH):
            part = at[a : a + BATCH]
            self.put(part, self.pruned(part, np.hstack([self.near[part], extra[a : a + BATCH]])))

    def linked_back(self, source: np.ndarray, near: np.ndarray) -> None:
        """Adds the edges near -> source; lists that would be over-full are pruned."""
        s, t = np.repeat(source, near.shape[1])[near.ravel() >= 0], near.ravel()[near.ravel() >= 0]
        order = np.argsort(t, kind="stable")
        s, t = s[order], t[order]
        node, first, count = np.unique(t, return_index=True, return_counts=True)
        pos = np.arange(len(t)) - np.repeat(first, count)
        fits = self.degree[node] + count <= 2 * EDGES
        short = np.repeat(fits, count)
        self.near[t[short], self.degree[t[short]] + pos[short]] = s[short]
        self.degree[node[fits]] += count[fits]
        if not fits.all():
            extra = np.full((int((~fits).sum()), int(count[~fits].max())), -1, np.int32)
            extra[np.repeat(np.arange(len(extra)), count[~fits]), pos[~short]] = s[~short]
            self.shrunk(node[~fits], extra)

    def build(self) -> Graph:
        n = len(self.x)
        have = min(n, BATCH // 2)
        every = np.arange(have, dtype=np.int32)
        first = self.pruned(every, np.broadcast_to(every, (have, have)))
        self.put(every, first)
        self.linked_back(every, first)
        while have < n:
            at = np.arange(have, min(n, have + min(BATCH, have)), dtype=np.int32)
            row, met = self.beam(self.x[at], BUILD, have)[2:]
            order = np.argsort(row, kind="stable")
            row, met = row[order], met[order]
            count = np.bincount(row, minlength=len(at))
            near = np.full((len(at), int(count.max())), -1, np.int32)
            near[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = met
            near = self.pruned(at, near)
            self.put(at, near)
            self.linked_back(at, near)
            have += len(at)
        over = np.flatnonzero(self.degree > EDGES).astype(np.int32)
        self.shrunk(over, np.full((len(over), 0), -1, np.int32))
        return self


def matrix(values: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of an array column as doubles, filled up with zeros."""
    lens = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lens == dim).all():
        return flat.reshape(len(lens), dim)
    out = np.zeros((len(lens), dim))
    out[np.arange(dim) < lens[:, None]] = flat
    return out


def vectors(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.transform(vec, lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def nodes(own: DataFrame, k: int) -> DataFrame:
    """(v, ids): a row for each vector with its k + 1 smallest ids, each with its count (k at most)."""
    ids = own.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    few = ids.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct(F.col("vec_id").alias("id"), "n"))).alias("ids"))


def by_shard(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[int, pa.Table]]:
    """(shard, rows) of batches in order of shard, each shard's rows whole."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        shard = b.column(column).to_numpy()
        for a, z in zip(e := np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), [*e[1:], len(shard)]):
            if held and held[0].column(column)[0].as_py() != shard[a]:
                yield held[0].column(column)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield held[0].column(column)[0].as_py(), pa.Table.from_batches(held)


def whole(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def index(own: DataFrame, k: int, shard: int = SHARD) -> tuple[DataFrame, int, int]:
    """(INDEX rows, number of shards, dimensions) of ``vectors``."""
    table = written(nodes(own, k), "ann-nodes")
    n, dim = table.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards = max(1, -(-n // shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in by_shard(batches):
            near = Graph(matrix(whole(rows, "v"), dim)).build().near[:, :EDGES]
            live = near >= 0
            ends = np.concatenate([[0], np.cumsum(live.sum(axis=1))]).astype(np.int32)
            edges = pa.ListArray.from_arrays(pa.array(ends), pa.array(near[live]))
            place = np.arange(len(near), dtype=np.int32)
            out = pa.table([pa.array(np.full(len(near), number, np.int32)), pa.array(place), rows.column("ids"), rows.column("v"), edges], names=["shard", "place", "ids", "v", "near"])
            yield from out.combine_chunks().to_batches(max_chunksize=4096)

    dealt = table.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "ids", "v")
    # the first nodes of a shard are entries: in the order of another hash they are any nodes
    dealt = dealt.repartition(4 * shards, "shard").sortWithinPartitions("shard", F.xxhash64("v", F.lit(1)), "v")
    return written(dealt.mapInArrow(run, INDEX), "ann-index"), shards, dim


def search(table: DataFrame, shards: int, dim: int, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """FOUND rows: the k best of each shard for each row of queries (query_id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, graph = None, [], None
        for b in batches:
            shard, query = b.column("shard").to_numpy(), b.column("query_id").is_valid().to_numpy(zero_copy_only=False)
            change = np.flatnonzero((shard[1:] != shard[:-1]) | (query[1:] != query[:-1])) + 1
            for a, z in zip([0, *change], [*change, len(shard)]):
                part = b.slice(a, z - a)
                if not len(part):
                    continue
                if shard[a] != at:
                    at, parts, graph = shard[a], [], None
                if not query[a]:
                    parts.append(part)
                elif parts:
                    graph = graph or Shard(pa.Table.from_batches(parts), dim)
                    for i in range(0, len(part), BATCH):
                        yield from graph.best(part.slice(i, BATCH), k, max(beam, 2 * k))

    none = {"query_id": F.lit(None).cast("long"), "near": F.lit(None).cast("array<int>"), "ids": F.lit(None).cast("array<struct<id:long,n:int>>"), "place": F.lit(None).cast("int")}
    columns = ["shard", "query_id", "place", "ids", "v", "near"]
    sent = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumns({c: none[c] for c in ("place", "ids", "near")})
    both = table.withColumn("query_id", none["query_id"]).select(columns).unionByName(sent.select(columns))
    return both.repartition(4 * shards, "shard").sortWithinPartitions("shard", F.col("query_id").isNotNull(), "place").mapInArrow(run, FOUND)


class Shard:
    """A shard's graph, vectors and ids, read from the index."""

    def __init__(self, rows: pa.Table, dim: int):
        near = whole(rows, "near")
        lens = np.diff(near.offsets.to_numpy())
        edges = np.full((len(lens), EDGES), -1, np.int32)
        edges[np.arange(EDGES) < lens[:, None]] = near.flatten().to_numpy()
        self.dim, self.v = dim, matrix(whole(rows, "v"), dim)
        self.graph = Graph(self.v, edges)
        ids = whole(rows, "ids")
        self.ends, flat = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten()
        self.ids, self.n = flat.field("id").to_numpy(), flat.field("n").to_numpy()

    def best(self, part: pa.RecordBatch, k: int, beam: int) -> Iterator[pa.RecordBatch]:
        query, q = part.column("query_id").to_numpy(), matrix(part.column("v"), self.dim)
        unit = q / np.maximum(np.sqrt((q * q).sum(axis=1)), 1e-300)[:, None]
        place = self.graph.beam(np.hstack([unit, np.zeros((len(q), 1))]).astype(np.float32), beam, len(self.v))[0]
        row, col = np.nonzero(place >= 0)
        at = place[row, col]
        score = np.concatenate([(self.v[at[a : a + 8192]] * q[row[a : a + 8192]]).sum(axis=1) for a in range(0, len(at), 8192)])
        count = self.ends[at + 1] - self.ends[at]  # a node stands for all its ids
        flat = np.repeat(self.ends[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        row, score, vec, n = np.repeat(row, count), np.repeat(score, count), self.ids[flat], self.n[flat]
        other = vec != query[row]
        row, score, vec, n = (np.repeat(x[other], n[other]) for x in (row, score, vec, n))
        order = np.lexsort((vec, -score, row))
        row, score, vec = row[order], score[order], vec[order]
        own = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query[row[own]], vec[own], score[own])], names=["query_id", "vec_id", "score"])


def neighbours(rows: DataFrame, is_query: Column, k: int = 20, vec: str = "embedding", shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row under ``is_query`` (a condition on vec_id)."""
    own = vectors(rows, vec)
    table, shards, dim = index(own, k, shard)
    queries = own.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.max("v").alias("v"))
    found = search(table, shards, dim, queries, k, beam)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
