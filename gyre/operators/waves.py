"""Wave spectra as tables (elem_id, f, n, s): integrals over directions and frequencies, attenuation, masks, breaking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.functions import spectral


def heading(direction: Column) -> Column:
    """Radians, from the x axis, of the way that waves from a direction (degrees from north) go."""
    return -F.radians(90 + direction)


def over_directions(spec: DataFrame, s: str, weight: str, direction: str, by: list[str]) -> DataFrame:
    """(by, s, sx, sy): the sum over directions and its first cosine and sine moments."""
    e, a = F.col(s) * F.col(weight), heading(F.col(direction))
    return spec.groupBy(*by).agg(F.sum(e).alias("s"), F.sum(e * F.cos(a)).alias("sx"), F.sum(e * F.sin(a)).alias("sy"))


def integrals(sums: DataFrame, freq: str, weight: str, wavelength: str, ratio: Column | float = 1.0, by: str = "elem_id") -> DataFrame:
    """hs, tp, mwd and the Stokes drift (stokes_x, stokes_y) of what ``over_directions`` gives by element and frequency.

    ratio: of ice to water amplitudes; 1 where heights of water are asked for.
    """
    om, k = 2 * math.pi * F.col(freq), 2 * math.pi / F.col(wavelength)
    w = F.col(weight) * F.pow(F.lit(ratio) if not isinstance(ratio, Column) else ratio, F.lit(2))
    m = sums.groupBy(by).agg(
        F.sum(w * F.col("s")).alias("m0"), F.sum(w * F.col("s") * om * om).alias("m2"), F.sum(w * F.col("sx")).alias("mx"), F.sum(w * F.col("sy")).alias("my"),
        F.sum(w * 2 * om * k * F.col("sx")).alias("stokes_x"), F.sum(w * 2 * om * k * F.col("sy")).alias("stokes_y"),
    )
    some = F.col("m2") > 0
    return m.select(
        by, (4 * F.sqrt("m0")).alias("hs"), F.when(some, 2 * math.pi * F.sqrt(F.col("m0") / F.col("m2"))).otherwise(0.0).alias("tp"),
        F.when(some, -90 - F.degrees(F.atan2("my", "mx"))).otherwise(0.0).alias("mwd"), "stokes_x", "stokes_y",
    )


def rescaled(spec: DataFrame, factor: DataFrame, s: str) -> DataFrame:
    """The spectrum after elements changed their area: times (elem_id, factor)."""
    return spec.join(factor.select("elem_id", F.col("factor").alias("_f")), "elem_id").withColumn(s, F.col(s) * F.col("_f")).drop("_f")


def attenuated(spec: DataFrame, s: str, weight: str, direction: str, ice: Column, rate: Column, group_speed: Column, dt: float, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the spectrum after a step of exponential decay under ice, (by, tau_x, tau_y): the stress that the ice takes up)."""
    lost, a = F.col(s) * F.col(weight) * rate * group_speed, heading(F.col(direction))
    under = F.when(ice, lost).otherwise(0.0)
    stress = spec.groupBy(*by).agg(F.sum(under * F.cos(a)).alias("tau_x"), F.sum(under * F.sin(a)).alias("tau_y"))
    return spec.withColumn(s, F.when(ice, spectral.attenuated(F.col(s), rate, group_speed, dt)).otherwise(F.col(s))), stress


def by_floe_size(spec: DataFrame, size: Column, pack: float) -> DataFrame:
    """spec with q_scat and q_abs of its attenuation and damping (1/m): floes under the size of pack ice scatter, larger ones take the energy up."""
    small = size < pack
    return spec.withColumns({"q_scat": F.when(small, F.col("attenuation")).otherwise(0.0), "q_abs": F.when(small, F.col("damping")).otherwise(F.col("attenuation") + F.col("damping"))})


def scattering_stress(spec: DataFrame, s: str, weight: str, direction: str, by: list[str]) -> DataFrame:
    """(by, tau_x, tau_y): the momentum that ice takes up by a step of ``scattered``: the first moments of the energy, at the rate of what is scattered and absorbed."""
    a, lost = heading(F.col(direction)), F.when(F.col("ice"), F.col(s) * F.col(weight) * F.col("cg") * (F.col("q_scat") + F.col("q_abs"))).otherwise(0.0)
    return spec.groupBy(*by).agg(F.sum(lost * F.cos(a)).alias("tau_x"), F.sum(lost * F.sin(a)).alias("tau_y"))


def scattered(spec: DataFrame, s: str, dt: float, by: list[str]) -> DataFrame:
    """spec (by, one row for each of evenly spaced directions; s, ice, q_scat, q_abs, cg) after a step of isotropic scattering.

    Scattering spreads energy evenly, so in Fourier space the mean decays by what is absorbed and every other
    harmonic by what is absorbed and scattered: a direction's energy is the decayed mean and its own decayed rest.
    """
    mean = F.avg(s).over(Window.partitionBy(*by))
    kept = lambda q: F.exp(-q * F.col("cg") * dt)
    new = kept(F.col("q_abs")) * mean + kept(F.col("q_abs") + F.col("q_scat")) * (F.col(s) - mean)
    return spec.withColumn(s, F.when(F.col("ice"), new).otherwise(F.col(s)))


def incident(seas: DataFrame, frequencies: list[float], directions: int) -> DataFrame:
    """(elem_id, f, n, s) of seas (elem_id, hs, tp, mwd): the spectrum by height and period, spread about the mean direction over evenly spaced directions (density a radian)."""
    width = 360.0 / directions
    every = F.array(*[F.struct(F.lit(k).alias("f"), F.lit(2 * math.pi * v).alias("omega")) for k, v in enumerate(frequencies)])
    rows = seas.select("*", F.explode(every).alias("_f")).select("*", F.explode(F.sequence(F.lit(0), F.lit(directions - 1))).alias("n"))
    share = spectral.direction_share(F.col("n") * width - width / 2, F.col("n") * width + width / 2, F.col("mwd")) / math.radians(width)
    return rows.select("elem_id", F.col("_f.f").alias("f"), "n", (2 * math.pi * spectral.bretschneider(F.col("hs"), F.col("tp"), F.col("_f.omega")) * share).alias("s"))


def prescribed(waves: DataFrame, forcing: DataFrame, mask: Column, names: tuple[str, ...] = ("hs", "tp", "mwd")) -> DataFrame:
    """Forcing values (elem_id, names) where the mask holds (a condition on both), else zero."""
    new = waves.join(forcing.select("elem_id", *[F.col(n).alias(f"_{n}") for n in names]), "elem_id", "left")
    return new.withColumns({n: F.when(mask, F.col(f"_{n}")).otherwise(0.0) for n in names}).select(*waves.columns)


def ice_wavenumber(omega: Column, thickness: Column, young: float = 5.49e9, poisson: float = 0.3, density: float = 922.5, water: float = 1025.0, gravity: float = spectral.GRAVITY, steps: int = 40) -> Column:
    """The travelling root k of (D k**4 + rho g - h rho_ice omega**2) k = rho omega**2 for a floating elastic plate on deep water; open water where it is 0 thick.

    Newton's steps from the open-water root or the plate's, whichever is less: the left side rises and bends
    upwards there, so they come down to the one positive root.
    """
    d = young * F.pow(thickness, F.lit(3)) / (12 * (1 - poisson * poisson)) / (water * gravity)
    lift = F.greatest(1 - density * thickness * omega * omega / (water * gravity), F.lit(1e-9))
    open_ = omega * omega / gravity
    start = F.struct(d.alias("d"), lift.alias("l"), open_.alias("w"), F.greatest(open_ / lift, F.lit(1e-30)).alias("k"))
    root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, i: F.struct(s["d"].alias("d"), s["l"].alias("l"), s["w"].alias("w"), (s["k"] - (s["d"] * F.pow(s["k"], F.lit(5)) + s["l"] * s["k"] - s["w"]) / (5 * s["d"] * F.pow(s["k"], F.lit(4)) + s["l"])).alias("k")))
    return root["k"]


def broken(ice: DataFrame, strain: float, least: float, spread: Column | None = None) -> DataFrame:
    """ice (elem_id, ice, conc, thickness, size, m0, m2, var_strain, ...) with size, floes and broken after waves that strain it enough: floes are half a wave long at most."""
    k = ice_wavenumber(F.sqrt(F.col("m2") / F.col("m0")), F.col("thickness"))
    length = 2 * math.pi / k
    hit = F.col("ice") & (2 * F.col("var_strain") > strain * strain) & (length < 2 * F.col("size"))
    size = F.when(hit, F.greatest(F.lit(least), length / 2)).otherwise(F.col("size"))
    out = ice.withColumns({"broken": F.coalesce(hit, F.lit(False)), "size": F.coalesce(size, F.col("size"))})
    return out.withColumn("floes", spectral.floes(F.col("conc"), F.col("size")))


def root_of(guess: Column, lift: Column, depth: Column, plate: float, steps: int = 40) -> Column:
    """The root k of (plate k**4 + lift) k tanh(k depth) = 1 from a guess, by Newton's steps; all quantities without dimension."""
    first = F.struct(guess.alias("k"), lift.alias("l"), depth.alias("d"))

    def step(s: Column, _: Column) -> Column:
        k4 = plate * F.pow(s["k"], F.lit(4))
        t = F.tanh(s["k"] * s["d"])
        value = (k4 + s["l"]) * s["k"] * t - 1
        slope = (5 * k4 + s["l"]) * t + (k4 + s["l"]) * s["k"] * s["d"] * (1 - t * t)
        return F.struct((s["k"] - value / slope).alias("k"), s["l"].alias("l"), s["d"].alias("d"))

    return F.abs(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step)["k"])


#: Depth in units of the plate's length, from which on water counts as deep (fixed value).
DEEP = 4.0


def medium(thickness: Column, omega: Column, guess: Column, drag: float = 13.0, young: float = 5.49e9, poisson: float = 0.3, density: float = 922.5, water: float = 1025.0, gravity: float = spectral.GRAVITY) -> Column:
    """What waves of an angular frequency meet in ice of a thickness: struct (k_ice, k_water, admittance, damping, period_nd, thickness_nd).

    A thin elastic plate on water of finite depth: wavenumbers are the real roots of the dispersion relations under ice and
    in the open, near the guess; admittance is the ratio of energy fluxes of unit waves on either side; damping (1/m) comes from a
    viscous drag in Pa s/m; the last two are the squared frequency and the thickness in units of the plate's length.
    """
    rigidity = young * F.pow(thickness, F.lit(3)) / (12 * (1 - poisson * poisson))
    unit = F.pow(rigidity / water / (omega * omega), F.lit(0.2))
    alpha, h = omega * omega / gravity * unit, thickness / unit
    draught = density / water * h

    def flux(k: Column, lift: Column, depth: Column, plate: float) -> tuple[Column, Column]:
        whole = plate * F.pow(k, F.lit(4)) + lift
        rate = depth * (F.pow(whole * k, F.lit(2)) - 1) + 5 * plate * F.pow(k, F.lit(4)) + lift
        return whole * whole * k / rate, k / rate

    base = F.struct(unit.alias("unit"), alpha.alias("alpha"), h.alias("h"), (1 / alpha - draught).alias("lift"), (1 / alpha).alias("open"), (DEEP + draught).alias("deep"), guess.alias("guess"))

    def out(s: Column) -> Column:
        ice = root_of(s["guess"] * s["unit"], s["lift"], F.lit(DEEP), 1.0)
        free = root_of(s["alpha"], s["open"], s["deep"], 0.0)
        return F.struct(s.alias("s"), ice.alias("ice"), free.alias("free"))

    def done(r: Column) -> Column:
        s = r["s"]
        (under, decay), (over, _) = flux(r["ice"], s["lift"], F.lit(DEEP), 1.0), flux(r["free"], s["open"], s["deep"], 0.0)
        return F.struct(
            (r["ice"] / s["unit"]).alias("k_ice"), (r["free"] / s["unit"]).alias("k_water"), (over / under).alias("admittance"),
            (decay * drag / (water * omega * s["unit"]) / s["unit"]).alias("damping"), s["alpha"].alias("period_nd"), s["h"].alias("thickness_nd"),
        )

    # each stage is held once, so that later ones don't repeat it
    return F.transform(F.transform(F.array(base), out), done)[0]


def wave_medium(ice: DataFrame, frequencies: list[float], **constants) -> DataFrame:
    """(elem_id, f, omega, ``medium``'s columns) of ice (elem_id, thickness) at each rising frequency: the root of one frequency is the guess of the next, the open-water root that of the first.

    Elements don't meet, so nothing moves: frequencies are a fold within each row.
    """
    omegas = F.array(*[F.lit(2 * math.pi * f) for f in frequencies])
    types = "array<struct<omega:double,m:struct<k_ice:double,k_water:double,admittance:double,damping:double,period_nd:double,thickness_nd:double>>>"
    start = F.from_json(F.lit("[]"), types)

    def add(held: Column, omega: Column) -> Column:
        gravity = constants.get("gravity", spectral.GRAVITY)
        guess = F.coalesce(F.element_at(held, F.when(F.size(held) > 0, F.lit(-1)).otherwise(F.lit(None).cast("int")))["m"]["k_ice"], omega * omega / gravity)
        one = F.struct(omega.alias("omega"), medium(F.col("thickness"), omega, guess, **constants).alias("m"))
        return F.concat(held, F.array(one))

    every = F.aggregate(omegas, start, add)
    return ice.select("elem_id", F.posexplode(every).alias("f", "e")).select("elem_id", "f", "e.omega", "e.m.*")


def regime(value: Column, edges: list[Column | float], logs: list[bool]) -> tuple[Column, Column]:
    """(number of the interval that holds a value, its place there from -1 to 1, by its logarithm where ``logs`` says so); values beyond the ends count as the ends."""
    e = [c if isinstance(c, Column) else F.lit(float(c)) for c in edges]
    x = F.greatest(e[0], F.least(e[-1], value))
    number = F.lit(0)
    for k in range(1, len(logs)):
        number = F.when(x >= e[k], F.lit(k)).otherwise(number)

    def place(k: int) -> Column:
        a, b, c = (F.log(v) if logs[k] else v for v in (e[k], e[k + 1], x))
        return 2 * (c - a) / (b - a) - 1

    at = place(0)
    for k in range(1, len(logs)):
        at = F.when(number == k, place(k)).otherwise(at)
    return number, at


def chebyshev(coefficients: Column, x: Column, y: Column) -> Column:
    """The sum of coefficients[m][n] T_m(x) T_n(y)."""

    def basis(t: Column, n: Column) -> Column:
        return F.cos(n * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), t))))

    rows = F.transform(coefficients, lambda row, m: basis(x, m) * F.aggregate(F.transform(row, lambda c, n: c * basis(y, n)), F.lit(0.0), lambda a, b: a + b))
    return F.aggregate(rows, F.lit(0.0), lambda a, b: a + b)


def attenuation(medium_rows: DataFrame, table: DataFrame, period: tuple[list, list[bool]], thickness: tuple[list, list[bool]]) -> DataFrame:
    """medium_rows with attenuation (for each floe) and the ratio of amplitudes in ice to those in water, from a table of piecewise polynomials.

    table: (period_regime, thickness_regime, kind, c): Chebyshev coefficients c of what ``kind`` says: "log" (of attenuation) or "plain".
    period, thickness: (edges, which intervals go by logarithms) of the two quantities without dimension; rows are joined to the table by the two
    regimes they fall into, and a regime that the table lacks gives null.  The table has a row for each pair of regimes.
    """
    pr, px = regime(F.col("period_nd"), *period)
    tr, tx = regime(F.col("thickness_nd"), *thickness)
    # the coefficients of a pair of regimes are a row of a small table, which is joined by both
    own = medium_rows.withColumns({"_pr": pr, "_px": px, "_tr": tr, "_tx": tx}).join(table.withColumnsRenamed({"period_regime": "_pr", "thickness_regime": "_tr"}), ["_pr", "_tr"], "left")
    z = chebyshev(F.col("c"), F.col("_px"), F.col("_tx"))
    own = own.withColumn("attenuation", F.when(F.col("kind") == "log", F.exp(z)).otherwise(z))
    passed = F.sqrt(F.exp(-F.col("attenuation") / 2) / F.col("admittance"))
    return own.withColumn("amplitude_ratio", F.col("k_ice") * passed / F.col("k_water")).select(*medium_rows.columns, "attenuation", "amplitude_ratio")
