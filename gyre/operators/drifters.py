"""Sets of moving points: seeding, moving, sampling, masking, lifetimes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import locate


def seeded(spark: SparkSession, x0: float, x1: float, y0: float, y1: float, spacing: float) -> DataFrame:
    """A regular lattice over a box: (drifter_id, x, y)."""
    nx, ny = int((x1 - x0) // spacing) + 1, int((y1 - y0) // spacing) + 1
    return spark.range(nx * ny).select(F.col("id").alias("drifter_id"), (F.col("id") % nx * spacing + x0).alias("x"), (F.floor(F.col("id") / nx) * spacing + y0).alias("y"))


def moved(rows: DataFrame, u: str, v: str, factor: float) -> DataFrame:
    """Positions after a displacement; a null displacement moves nothing."""
    return rows.withColumns({"x": F.col("x") + factor * F.coalesce(u, F.lit(0.0)), "y": F.col("y") + factor * F.coalesce(v, F.lit(0.0))})


def sampled_conc(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def stepped(rows: DataFrame, at: DataFrame, size: float, factor: float, limit: float) -> DataFrame:
    """rows (x, y, ...) after a step on a mesh, with conc: they move by ``factor`` times the velocity where they are, take the
    concentration of the place they come to, and stay if it is over the limit.  at: elements with corners and corner values of u, v and conc; beyond the mesh nothing moves and there is no ice.
    """
    corner = lambda c: [f"{c}{k}" for k in (1, 2, 3)]
    here = rows.withColumns({"px": F.col("x"), "py": F.col("y")})
    velocity = locate.interpolated(locate.in_triangles(here, at, size, [*corner("u"), *corner("v")]), ["u", "v"], 0.0)
    there = moved(velocity, "u", "v", factor).select(*rows.columns).withColumns({"px": F.col("x"), "py": F.col("y")})
    found = locate.interpolated(locate.in_triangles(there, at, size, corner("conc")), "conc", 0.0)
    return found.withColumn("conc", sampled_conc(F.col("conc"))).where(F.col("conc") > limit).select(*rows.columns, "conc")


def is_due(t: Column, start: Column, interval: int) -> Column:
    """Whole multiples of the interval after the start; times are whole microseconds or seconds, so no remainder is inexact."""
    return (t >= start) & ((t - start) % interval == 0)


def lifetime(t: Column, start: Column, life: int) -> Column:
    """Number of the set that is alive at t: a new one begins when the last has lived its time."""
    return F.when(t >= start, F.floor((t - start) / life).cast("long"))


def checked_interval(interval: int, step: int, what: str) -> int:
    if interval <= 0 or step <= 0 or interval % step:
        raise ValueError(f"{what}: {interval} is no multiple of the step {step}")
    return interval


def buoys_at(rows: DataFrame, t: Column) -> DataFrame:
    """Rows of exactly the time: earlier ones are dropped, later ones wait."""
    return rows.where(F.col("t") == t)


@dataclass(frozen=True)
class Schedule:
    """Times of a set, in whole units: when it begins, how long it lives, how often buoys come in and positions go out; and the least concentration, not included."""

    start: int
    life: int
    input_every: int
    output_every: int
    limit: float


def start_at_restart(start: float, restart: float, fixed: bool) -> float:
    """The beginning (decimal days) of a set that a restart finds without positions: as it was if it is still to come, else the same time of day on the next
    day; an error where the beginning is fixed."""
    if restart <= start:
        return start
    if fixed:
        raise ValueError(f"a set that had to begin at {start} is not in the restart of {restart}")
    return math.ceil(restart) + start - math.floor(start)


#: What is kept of a drifter: whether its set has begun and it is in it, its place, and when the set began.
KEPT = "begun boolean, on boolean, x double, y double, start long"
STEP_T = "drifter_id long, t long, x double, y double, conc double, kind string"


def drifter_steps(kept: tuple | None, rows: Iterator[tuple], s: Schedule) -> Iterator[tuple]:
    """(kept, [(t, x, y, conc, kind), ...]) after each row (t, x, y, u, v, conc, reported) of one drifter, in order of time.

    The order of a step is fixed: it has moved; its set ends with its life, with a last position, and begins anew; it begins where the row has
    it; at input times it stays or comes in only if it is reported and over the limit; at output times its place goes out.
    """
    begun, on, x, y, start = kept or (False, False, 0.0, 0.0, s.start)
    for t, x0, y0, u, v, conc, reported in rows:
        out = []
        if on:
            x, y = x + u, y + v
        if begun and t - start >= s.life:
            if on:
                out.append((t, x, y, conc, "last"))
            begun, on, start = False, False, start + s.life
        if not begun and t >= start:
            begun, on, x, y = True, conc > s.limit, x0, y0
        if begun and (t - s.start) % s.input_every == 0:
            if not on:
                x, y = x0, y0
            on = bool(reported) and conc > s.limit
        if on and t >= s.start and (t - s.start) % s.output_every == 0:
            out.append((t, x, y, conc, "output"))
        yield (begun, on, x, y, start), out


def run_steps(rows: DataFrame, s: Schedule) -> DataFrame:
    """STEP_T rows of all drifters; rows: (drifter_id, t, x, y, u, v, conc, reported), a row for each drifter and time.  A drifter's own rows are taken in order by one task; drifters don't meet."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values("t", kind="stable")[["t", "x", "y", "u", "v", "conc", "reported"]].itertuples(index=False, name=None)
        out = [(key[0], *o) for _, found in drifter_steps(None, own, s) for o in found]
        return pd.DataFrame(out, columns=["drifter_id", "t", "x", "y", "conc", "kind"])

    return rows.groupBy("drifter_id").applyInPandas(run, STEP_T)
