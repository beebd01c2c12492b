"""Values of a time series at given times: linear between its two neighbours, stepwise, or of the same day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(series: DataFrame, by: list[str], t: str, v: str, span: int) -> DataFrame:
    """(by, t0, v0, t1, v1): each step and the next; the last step's end is open (null).

    Steps are ordered within buckets of ``span`` time units of a series, so a hot series is split by time; only the first and
    last step of each bucket are ordered over a whole series, to close the gaps between buckets.
    """
    bucket = F.floor(F.col(t) / span)
    w = Window.partitionBy(*by, "_b").orderBy(t)
    own = series.where(F.col(t).isNotNull()).select(*by, bucket.alias("_b"), F.col(t).alias(t), F.col(v).alias(v))
    inner = own.withColumns({"t1": F.lead(t).over(w), "v1": F.lead(v).over(w)})
    firsts = own.groupBy(*by, "_b").agg(F.min(F.struct(t, v)).alias("_first"))
    nxt = firsts.select(*by, "_b", F.lead("_first").over(Window.partitionBy(*by).orderBy("_b")).alias("_next"))
    out = inner.join(nxt, [*by, "_b"])
    last = F.col("t1").isNull()
    return out.select(*by, F.col(t).alias("t0"), F.col(v).alias("v0"), F.when(last, F.col(f"_next.{t}")).otherwise(F.col("t1")).alias("t1"), F.when(last, F.col(f"_next.{v}")).otherwise(F.col("v1")).alias("v1"))


def bracketed(at: DataFrame, series: DataFrame, by: list[str], t: str, v: str, span: int) -> DataFrame:
    """at (by, at) with the interval t0 <= at <= t1 around it; outside the series: null.

    An interval goes to every bucket of ``span`` time units it meets, so the join is an
    equi-join and a hot series is split by time.
    """
    iv = intervals(series, by, t, v, span).where("t1 is not null")
    iv = iv.withColumn("_b", F.explode(F.sequence(F.floor(F.col("t0") / span), F.floor(F.col("t1") / span))))
    q = at.withColumn("_b", F.floor(F.col("at") / span))
    j = q.join(iv, [*by, "_b"]).where((F.col("t0") <= F.col("at")) & (F.col("at") <= F.col("t1")))
    # At a step two intervals meet; the later one counts.
    best = j.groupBy(*by, "at").agg(F.max(F.struct("t0", "v0", "t1", "v1")).alias("m"))
    return at.join(best, [*by, "at"], "left").select(*at.columns, "m.*")


def current(at: DataFrame, series: DataFrame, by: list[str], t: str, v: str, span: int, kind: str = "closed", day: int = 1) -> DataFrame:
    """``bracketed`` by the kind of forcing: "closed" [t0, t1], "coupled" [t0, t1), "daily" (a step of the same day of ``day`` time units), "constant" (the first step, whatever the time)."""
    if kind == "closed":
        return bracketed(at, series, by, t, v, span)
    if kind == "coupled":
        held = bracketed(at, series, by, t, v, span)
        inside = F.col("at") < F.col("t1")
        return held.withColumns({c: F.when(inside, F.col(c)) for c in ("t0", "v0", "t1", "v1")})
    first = F.min(F.struct(F.col(t), F.col(v))).alias("m")
    if kind == "constant":
        return at.join(series.groupBy(*by).agg(first), by, "left").select(*at.columns, F.col(f"m.{t}").alias("t0"), F.col(f"m.{v}").alias("v0"), F.lit(None).cast("long").alias("t1"), F.lit(None).cast("double").alias("v1"))
    held = series.groupBy(*by, F.floor(F.col(t) / day).alias("_d")).agg(first)
    return at.withColumn("_d", F.floor(F.col("at") / day)).join(held, [*by, "_d"], "left").select(*at.columns, F.col(f"m.{t}").alias("t0"), F.col(f"m.{v}").alias("v0"), F.lit(None).cast("long").alias("t1"), F.lit(None).cast("double").alias("v1"))


def linear(factor: Column | float = 1.0, bias: Column | float = 0.0) -> Column:
    """factor * (c0 v0 + c1 v1) + bias; the bias comes after the factor."""
    c0 = F.abs(F.col("at") - F.col("t1")) / F.abs(F.col("t1") - F.col("t0"))
    c1 = F.abs(F.col("at") - F.col("t0")) / F.abs(F.col("t1") - F.col("t0"))
    return factor * (c0 * F.col("v0") + c1 * F.col("v1")) + bias


def step(factor: Column | float = 1.0, bias: Column | float = 0.0) -> Column:
    return factor * F.col("v0") + bias


def spin_up(t: Column, start: Column, duration: float) -> Column:
    """Rises from 0 to 1 over the duration."""
    return F.when(t - start < duration, (t - start) / duration).otherwise(1.0)
