"""Random forcing: AR(1) series, wind from pressure gradients, Gaussian fields by Fourier transforms along shuffled lines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyre.shared import written

from .fields import renumbered


def alpha(dt: float, correlation: float) -> float:
    """exp(-1) after a correlation time."""
    return math.exp(-1.0) ** (dt / correlation)


#: Rows of a series that one task folds at a time.
BLOCK = 4096


def ar1(rows: DataFrame, by: list[str], order: str, w: str, a: float) -> DataFrame:
    """x_0 = w_0, x_n = a x_n-1 + sqrt(1 - a^2) w_n, along each series, with column x.

    Rows are numbered in the order of their series and dealt into blocks, so a hot series is spread over tasks.  A block is folded from nothing;
    what the last one ended with comes in at its head, weakened by a for each step.  A block is longer than any such trace (below 1e-16), so
    its end doesn't depend on the one before.
    """
    b = math.sqrt(1 - a * a)
    size = max(BLOCK, math.ceil(math.log(1e-17) / math.log(a))) if 0 < a < 1 else BLOCK
    numbered = renumbered(rows, [*by, order], into="_n")
    first = numbered.groupBy(*by).agg(F.min("_n").alias("_first"))
    place = F.col("_n") - F.col("_first")
    held = numbered.join(first, by).withColumns({"_block": F.floor(place / size), "_at": (place % size).cast("int")}).drop("_n")
    schema = T.StructType([*held.schema.fields, T.StructField("x", T.DoubleType())])

    def fold(frames):
        x = 0.0
        for frame in frames:  # blocks one after another, each in order
            out = []
            for block, at, v in zip(frame["_block"].tolist(), frame["_at"].tolist(), frame[w].tolist()):
                x = a * x + b * v if at else b * v if block else v
                out.append(x)
            yield frame.assign(x=out)

    dealt = held.repartition("_first", "_block").sortWithinPartitions("_first", "_block", "_at")
    own = written(dealt.mapInPandas(fold, schema), "series")
    ends = own.where(F.col("_at") == size - 1).select(*by, (F.col("_block") + 1).alias("_block"), F.col("x").alias("_end"))
    x = F.col("x") + F.coalesce(F.col("_end") * F.pow(F.lit(a), F.col("_at") + 1), F.lit(0.0))
    return own.join(ends, [*by, "_block"], "left").withColumn("x", x).select(*rows.columns, "x")


def pressure_gradient(grid: DataFrame, value: str, dx: float) -> DataFrame:
    """gx, gy: backward differences, from the second column and row on; both 0 in the first ones."""
    gx = (F.col(value) - F.lag(value).over(Window.partitionBy("j").orderBy("i"))) / dx
    gy = (F.col(value) - F.lag(value).over(Window.partitionBy("i").orderBy("j"))) / dx
    inner = F.col("gx").isNotNull() & F.col("gy").isNotNull()
    return grid.withColumns({"gx": gx, "gy": gy}).withColumns({c: F.when(inner, F.col(c)).otherwise(0.0) for c in ("gx", "gy")})


#: Density of air (kg/m3), the latitude of the Coriolis factor and the one of the equator's weight, whose sine is taken of its number as it stands (fixed values).
AIR, CORIOLIS_LAT, EQUATOR_LAT = 1.2, 40.0, 60.0


def geostrophic(gx: Column, gy: Column, factor: float = 1.0) -> tuple[Column, Column]:
    """Wind of a pressure gradient in mbar a metre: Coriolis balance at one latitude, weighted with a flow down the gradient."""
    f = 2 * math.sin(math.radians(CORIOLIS_LAT)) * 2 * math.pi / 86400 * AIR
    px, py = 100 * factor * gx / f, 100 * factor * gy / f
    w = math.sin(EQUATOR_LAT) / EQUATOR_LAT * math.pi / 2
    return w * -py - (1 - w) * px, w * px - (1 - w) * py


def speed_factor(pressure_sd: float, speed_sd: float, length: float, dx: float) -> float:
    """Scales gradients so that typical winds are those of the wind's own deviation."""
    f = 2 * math.sin(math.radians(CORIOLIS_LAT)) * 2 * math.pi / 86400
    return speed_sd / (3 * 100 * pressure_sd / (length * dx) / f)


def scaled(fields: DataFrame, deviations: dict[str, float]) -> DataFrame:
    """Each field times its standard deviation."""
    return fields.withColumns({c: F.col(c) * d for c, d in deviations.items()})


def perturbed(steps: DataFrame, noise: DataFrame, key: list[str], names: dict[str, str]) -> DataFrame:
    """Forcing rows (key and, say, two time steps each) with noise of the same key added to each column that ``names`` maps; rows without noise stay."""
    held = noise.select(*key, *[F.col(n).alias(f"_n_{c}") for c, n in names.items()])
    return steps.join(held, key, "left").withColumns({c: F.col(c) + F.coalesce(F.col(f"_n_{c}"), F.lit(0.0)) for c in names}).select(*steps.columns)


def wave_width(n1: int, length: float) -> float:
    """The width s of exp(-k**2 / s**2) with which a field on n1 periodic cells has the correlation exp(-1) after ``length`` cells; by halving, as the correlation falls with s."""
    k = np.arange(-(n1 // 2) + 1, n1 // 2 + 1) * 2 * np.pi / n1

    def correlation(s: float) -> float:
        w = np.exp(-2 * (k / s) ** 2)
        return float((w * np.cos(k * length)).sum() / w.sum())

    low, high = 1e-6, 64.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if correlation(mid) > math.exp(-1) else (low, mid)
    return (low + high) / 2


def random_fields(phases: DataFrame, by: list[str], shape: tuple[int, int], length: float) -> DataFrame:
    """(by, i, j, value): periodic fields of Gaussian covariance, the correlation exp(-1) after ``length`` cells along i.

    That is before the waves l = 0 lose half of their share of the variance 1: a real field has no place for their imaginary parts.
    phases: (by, l, p, phi): a turn (0 to 1) for each wave l = 0 .. n1 / 2, p = 0 .. n2 - 1 of each field's n1 x n2 cells (both even); waves
    without a row are absent.  The transform goes by shuffled lines: along p for each (field, l), then along l for each
    (field, j), so a field is spread over as many tasks as it has lines, and no task holds more than lines.
    """
    n1, n2 = shape
    s, half = wave_width(n1, length), n1 // 2 + 1
    k1, k2 = (np.minimum(np.arange(n), n - np.arange(n)) * 2 * np.pi / n for n in (n1, n2))
    weight = lambda k, n: np.exp(-2 * (k / s) ** 2)
    scale = 1 / math.sqrt(float(weight(k1, n1).sum() * weight(k2, n2).sum()))
    types = {f.name: f.dataType for f in phases.schema.fields}
    keys = ", ".join(f"`{c}` {types[c].simpleString()}" for c in by)

    def lines(column: pd.Series, size: int, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
        """Arrays of structs (at, names) as matrices of ``size`` columns; zeros where there is no entry."""
        out = tuple(np.zeros((len(column), size)) for _ in names)
        for i, entries in enumerate(column):
            for e in entries:
                for o, name in zip(out, names):
                    o[i, e["at"]] = e[name]
        return out

    def along_p(frames):
        for f in frames:
            phi, amp = lines(f["line"], n2, ("phi", "amp"))
            spec = amp * np.exp(2j * np.pi * phi)
            x = np.fft.ifft(spec, axis=1) * n2
            yield f[by].assign(at=f["at"], re=list(x.real), im=list(x.imag))

    def along_l(frames):
        for f in frames:
            re, im = lines(f["line"], half, ("re", "im"))
            y = np.fft.irfft(re + 1j * im, n=n1, axis=1) * n1
            yield f[by].assign(j=f["at"], value=list(y))

    column = lambda values: F.array(*[F.lit(float(v)) for v in values])
    amp = F.get(column(np.exp(-((k1[:half] / s) ** 2))), F.col("l").cast("int")) * F.get(column(np.exp(-((k2 / s) ** 2)) * scale), F.col("p").cast("int"))
    entry = F.struct(F.col("p").cast("int").alias("at"), F.col("phi").cast("double").alias("phi"), amp.alias("amp"))
    first = phases.where(F.col("l").between(0, half - 1) & F.col("p").between(0, n2 - 1)).groupBy(*by, F.col("l").cast("int").alias("at")).agg(F.collect_list(entry).alias("line"))
    waves = first.mapInPandas(along_p, f"{keys}, at int, re array<double>, im array<double>")
    turned = waves.select(*by, "at", F.posexplode(F.arrays_zip("re", "im")).alias("j", "x"))
    second = turned.groupBy(*by, F.col("j").alias("at")).agg(F.collect_list(F.struct(F.col("at").alias("at"), F.col("x.re").alias("re"), F.col("x.im").alias("im"))).alias("line"))
    return second.mapInPandas(along_l, f"{keys}, j int, value array<double>").select(*by, F.posexplode("value").alias("i", "value"), "j").select(*by, "i", "j", "value")
