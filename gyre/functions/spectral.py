"""Wave spectra and floe sizes as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY = 9.81


def bretschneider(hs: Column, tp: Column, omega: Column) -> Column:
    """Spectral density at an angular frequency for significant height and peak period."""
    wm = 2 * math.pi / tp
    return 5 / 16 * hs * hs * F.pow(wm, F.lit(4)) * F.pow(omega, F.lit(-5)) * F.exp(-1.25 * F.pow(wm / omega, F.lit(4)))


def direction_share(low: Column, high: Column, mean: Column) -> Column:
    """Share of energy between two directions (degrees, low < high <= low + 360) of a cos**2 spread within 90 of ``mean``, wrapped: its exact integral."""
    into = lambda t: t - F.floor((t - low) / 360) * 360
    begin, end = into(mean - 90), into(mean + 90)

    def part(a: Column, b: Column) -> Column:
        p, q = F.radians(a - mean), F.radians(b - mean)
        return F.when(b > a, 2 * (q - p) + F.sin(2 * q) - F.sin(2 * p)).otherwise(0.0)

    once = part(F.greatest(low, begin), F.least(high, end))
    return F.when(end > begin, once).otherwise(part(low, F.least(high, end)) + part(begin, high)) / (2 * math.pi)


def wave_parameters(m0: Column, m2: Column, mx: Column, my: Column) -> dict[str, Column]:
    """Significant height, period and mean direction (degrees, from north, where waves come from) of moments."""
    return {
        "hs": 4 * F.sqrt(m0),
        "tp": F.when(m2 > 0, 2 * math.pi * F.sqrt(m0 / m2)),
        "mwd": F.when((mx != 0) | (my != 0), -90 - F.degrees(F.atan2(my, mx))),
    }


def wave_mask(ice: Column, land: Column, hs: Column, period: Column, longest: float) -> Column:
    return (~ice) & (~land) & (hs > 1e-3) & (period > 1e-8) & (period < 1.5 * longest)


def floes(conc: Column, size: Column, least: float = 0.0) -> Column:
    """Floes per area; none where the concentration is under ``least`` or zero."""
    return F.when((conc > 0) & (conc >= least) & (size > 0), conc / (size * size)).otherwise(0.0)


def floe_size(conc: Column, n: Column, most: float, least: float = 0.0) -> Column:
    """Size from number, capped; 0 where the concentration is under ``least`` or zero."""
    return F.when((conc > 0) & (conc >= least) & (n > 0), F.least(F.sqrt(conc / n), F.lit(most))).otherwise(0.0)


def floe_size_reset(conc: Column, n: Column, most: float, initial: float, least: float = 0.0) -> Column:
    """The other convention: sizes above the cap go back to the initial one."""
    d = F.sqrt(conc / n)
    return F.when((conc > 0) & (conc >= least) & (n > 0), F.when(d > most, F.lit(initial)).otherwise(d)).otherwise(0.0)


def floe_moment_smooth(most: Column, least: float, exponent: float, moment: int) -> Column:
    """Mean of size**moment for a power law of the exponent between ``least`` and ``most``; no floe is under ``least``."""
    a, b = exponent, exponent - moment
    p = lambda c, k: F.pow(c, F.lit(-k))
    return F.when(most <= least, F.lit(float(least) ** moment)).otherwise(a / b * (least**-b - p(most, b)) / (least**-a - p(most, a)))


def floe_moment_steps(most: Column, least: float, fragility: float, xi: float, moment: int) -> Column:
    """Mean of size**moment by renormalised breaking: at each step a share ``fragility`` breaks into xi**2 pieces, until sizes are under xi times ``least``; what is left then stays."""
    times = F.floor(F.log(most / least) / math.log(xi) + 1e-12).cast("int")

    def fold(state: Column, m: Column) -> Column:
        n = F.pow(F.lit(fragility * xi * xi), m) * F.when(m < times, F.lit(1 - fragility)).otherwise(1.0)
        return F.struct((state["up"] + n * F.pow(most / F.pow(F.lit(xi), m), F.lit(moment))).alias("up"), (state["low"] + n).alias("low"))

    none = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("low"))
    sums = F.aggregate(F.sequence(F.lit(0), F.greatest(times, F.lit(0))), none, fold)
    whole = F.greatest(F.pow(most, F.lit(moment)), F.lit(float(least) ** moment))
    return F.when(most < xi * least, whole).otherwise(sums["up"] / sums["low"])


def mean_floe_size(ice: Column, size: Column, threshold: float, least: float, fragility: float, xi: float, moment: int, smooth: bool = False) -> Column:
    """0 without ice; under the threshold by one of the two distributions; else all floes are alike, and the size itself counts, whatever the moment."""
    exponent = 2 + math.log(fragility) / math.log(xi)
    spread = floe_moment_smooth(size, least, exponent, moment) if smooth else floe_moment_steps(size, least, fragility, xi, moment)
    return F.when(~ice, 0.0).when(size < threshold, spread).otherwise(size)


def attenuated(energy: Column, rate: Column, group_speed: Column, dt: float) -> Column:
    return energy * F.exp(-rate * group_speed * dt)


#: The least thickness of thin ice, in m (fixed value).
THINNEST = 0.01


def thin_ice(thin: Column, snow: Column, new: Column, conc: Column, slope: float, thickest: float) -> dict[str, Column]:
    """Redistribution of thin ice to thick ice.

    thin, snow: volumes of thin ice and of the snow on it; new: thickness of new ice on open water; conc:
    concentration of thick ice; slope: thickness over concentration of thin ice; thickest: where thin ice ends.
    Gives the thin volume left, the volume and concentration gained by thick ice, and the snow that goes with it.
    """
    open_ = 1 - conc
    cover = lambda v: F.least(v / THINNEST, F.sqrt(2 * v / slope))
    before = cover(thin)
    depth = F.when(before > 0, snow / before).otherwise(0.0)
    volume = thin + new * F.greatest(F.lit(0.0), open_ - before)
    top = F.when(cover(volume) <= open_, F.sqrt(2 * volume * slope)).otherwise(volume / open_ + 0.5 * open_ * slope)
    gain = F.greatest(F.lit(0.0), top - thickest) / slope
    full, closes = conc == 1, gain > open_
    moved = F.when(full | closes, volume).otherwise(0.5 * gain * (top + thickest))
    return {
        "thin": F.when(full, 0.0).otherwise(volume - moved), "new_volume": moved,
        "new_conc": F.when(full, 0.0).when(closes, open_).otherwise(gain), "new_snow": F.when(full, snow).otherwise(F.least(snow, gain * depth)),
    }
