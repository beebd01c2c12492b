"""Means over time windows and grid cells, block statistics, gridding of scattered points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .locate import bucketed


def window_mean(rows: DataFrame, ts: Column, length: str, by: list[str], value: Column, weight: Column | None = None) -> DataFrame:
    """(window_start, by, mean, n): time-weighted where a weight is given."""
    mean = F.avg(value) if weight is None else F.sum(value * weight) / F.sum(weight)
    return rows.groupBy(F.window(ts, length).alias("w"), *by).agg(mean.alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "mean", "n")


def last_value(rows: DataFrame, ts: Column, length: str, by: list[str], value: Column, tie: Column) -> DataFrame:
    """The last value of each window."""
    return rows.groupBy(F.window(ts, length).alias("w"), *by).agg(F.max_by(value, F.struct(ts, tie)).alias("last")).select(F.col("w.start").alias("window_start"), *by, "last")


def block_mean(grid: DataFrame, factor: int, value: str, fill: float | None = None) -> DataFrame:
    """Mean of each factor x factor block, to the nearest whole number; fill values don't count, and a block of them alone is fill."""
    held = F.col(value) if fill is None else F.when(F.col(value) != fill, F.col(value))
    mean = F.floor(F.avg(held) + 0.5).cast("double")
    return grid.groupBy(F.floor(F.col("i") / factor).alias("bi"), F.floor(F.col("j") / factor).alias("bj")).agg((mean if fill is None else F.coalesce(mean, F.lit(float(fill)))).alias(value))


def block_sample(grid: DataFrame, factor: int) -> DataFrame:
    """The cell in the middle of each block: half the factor, rounded up."""
    mid = (factor + 1) // 2
    return grid.where((F.col("i") % factor == mid) & (F.col("j") % factor == mid))


def coverage(rows: DataFrame, cell: list[str], kind: str) -> DataFrame:
    """(cell, kind, percent): share of a cell's rows by kind, from one aggregation by both and one over its small result."""
    by = rows.groupBy(*cell, kind).agg(F.count("*").alias("n"))
    total = by.groupBy(*cell).agg(F.sum("n").alias("total"))
    return by.join(total, cell).select(*cell, kind, (100 * F.col("n") / F.col("total")).alias("percent"))


def scattered(points: DataFrame, grid: DataFrame, radius: float, value: str, kind: str = "cressman") -> DataFrame:
    """Values at grid points (cell_id, gx, gy) of points (px, py, value) within the radius.

    cressman: (R2 - d2) / (R2 + d2); idw: 1 / d2; bucket: 1.  Each point goes to the
    buckets its circle meets, so the join is an equi-join.
    """
    r2 = radius * radius
    p = bucketed(points, F.col("px") - radius, F.col("px") + radius, F.col("py") - radius, F.col("py") + radius, radius)
    q = grid.withColumns({"bx": F.floor(F.col("gx") / radius).cast("long"), "by": F.floor(F.col("gy") / radius).cast("long")})
    d2 = F.pow(F.col("px") - F.col("gx"), F.lit(2)) + F.pow(F.col("py") - F.col("gy"), F.lit(2))
    w = {"cressman": (r2 - d2) / (r2 + d2), "idw": 1 / F.greatest(d2, F.lit(1e-12)), "bucket": F.lit(1.0)}[kind]
    return q.join(p, ["bx", "by"]).where(d2 <= r2).groupBy("cell_id").agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value), F.count("*").alias("n"))
