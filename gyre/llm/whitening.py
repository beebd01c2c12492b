"""Embedding whitening by MLlib's RowMatrix.

Entries become integers x = floor(1024 * c) + 100000.  One pass sums them, so that rows
can be centred exactly: n * x - S is an integer in each dimension.  RowMatrix adds the
outer products of these rows up on the executors (computeGramianMatrix); divided by n,
and by n * n for the rows' own scale, that is the covariance.  Its eigenvectors are found
on the driver (d x d numbers, the one thing that passes through it), and the whitening
matrix, at most d x 8, is broadcast to mapInPandas.  The whitened rows are written, and
their own covariance is taken by a second RowMatrix over rows centred by their mean.

Defined cases: vectors that are null or hold null or non-finite entries are dropped;
shorter ones count as filled up with zeros (x = 100000), an empty one as all zeros; rows
with a null or repeated id and equal rows are rows of their own; floor(1024 * c) is held
within -2^30 and 2^30; a deviation beyond 64 bits is null; a component with no variance
to speak of (e not above 1e-12 of the largest) has a null ``whitened`` and stays out of
``identity_error``, which is null where no component is left; ``explained`` is null where
the trace is zero; fewer than 8 dimensions have as many components; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SHIFT, MOST, FLAT = 100_000, 1 << 30, 1e-12


def entries(rows: DataFrame, vec: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, x array<long>) of the rows that stay."""
    bad = F.exists(vec, lambda c: F.coalesce(F.isnan(c) | (F.abs(c.cast("double")) == float("inf")), F.lit(True)))
    whole = F.transform(vec, lambda c: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c.cast("double") * scale))).cast("long") + SHIFT)
    return rows.where(F.col(vec).isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def column_sums(x: DataFrame, dim: int) -> np.ndarray:
    """Sums of each dimension, with 100000 for what a shorter row lacks: each task sends one row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, np.int64)
        for b in batches:
            total += filled(b.column(0), dim).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(total)], names=["d", "s"])

    got = x.select("x").mapInArrow(run, "d long, s long").groupBy("d").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(dim, np.int64)
    out[got.column("d").to_numpy()] = got.column("s").to_numpy()
    return out


def filled(values: pa.ListArray, dim: int) -> np.ndarray:
    lens = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if (lens == dim).all():
        return flat.reshape(len(lens), dim)
    out = np.full((len(lens), dim), SHIFT, np.int64)
    out[np.arange(dim) < lens[:, None]] = flat
    return out


def covariance(rows: DataFrame, vec: Column, n: int) -> np.ndarray:
    """Gramian of the rows of centred values ``vec`` (array<double>), divided by n."""
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(vec).alias("v")), "v"))
    return np.asarray(matrix.computeGramianMatrix().toArray()) / n


def centred(x: Column, n: int, s: np.ndarray) -> Column:
    """n * x - S, whole numbers as doubles, filled up to S's length."""
    full = F.concat(x, F.array_repeat(F.lit(SHIFT).cast("long"), F.greatest(F.lit(0), F.lit(len(s)) - F.size(x))))
    return F.zip_with(full, F.lit([int(v) for v in s]).cast("array<long>"), lambda a, b: (a * n - b).cast("double"))


def deviations(d: np.ndarray) -> list[int | None]:
    """Sums of squares of whole numbers, exact; None beyond 64 bits."""
    if not d.size or float((d.astype(np.float64) ** 2).sum(axis=1).max()) < 2.0**62:
        return (d * d).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in d]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, components: int = 8, vec: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each remaining row and component."""
    x = entries(rows, vec, scale)
    n, dim = x.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    schema = "vec_id long, deviation long, w array<double>"
    if not n or not dim:
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    s = column_sums(x, dim)
    v = covariance(x, centred(F.col("x"), n, s), n) / float(n) ** 2
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, dim)
    live = e[:k] > max(0.0, float(e[0])) * FLAT
    held = rows.sparkSession.sparkContext.broadcast((s, u[:, :k] / np.sqrt(np.where(live, e[:k], 1.0)) / n, live))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, w, live = held.value
        for f in frames:
            d = filled(pa.array(f["x"], pa.list_(pa.int64())), len(s)) * n - s
            out = d.astype(np.float64) @ w
            yield pd.DataFrame({"vec_id": f["vec_id"].astype("Int64"), "deviation": pd.array(deviations(d), "Int64"), "w": [[float(v) if ok else None for v, ok in zip(row, live)] for row in out]})

    done = written(x.mapInPandas(run, schema), "whitened")
    error = None
    if at := [int(i) for i in np.flatnonzero(live)]:
        means = done.agg(*(F.avg(F.col("w")[i]) for i in at)).first()
        gap = covariance(done, F.array(*(F.col("w")[i] - F.lit(float(m)) for i, m in zip(at, means))), n) - np.eye(len(at))
        error = float(np.abs(gap).max())
    trace = float(np.trace(v))
    share = F.lit([float(v / trace) if trace > 0 else None for v in e[:k]]).cast("array<double>")
    return done.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("i")].alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
