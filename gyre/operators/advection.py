"""Advection: upwind finite volumes on triangles, third-order WENO on grids, by direction where a field has directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.joins import dealt


def oriented_faces(elems: DataFrame, nodes: DataFrame, u: str, v: str, closed: str | None = None) -> DataFrame:
    """(elem_id, neighbour, flux, closed): a row for each side of each element, with the volume that nodal velocities carry out through it.

    elems: (elem_id, nodes); nodes: (node_id, x, y, u, v and, if named, closed: a boolean mark).  The flux is the
    side's outward normal, of its length, times the mean of its ends' velocities, whichever way the element turns; the two
    elements of a side have opposite fluxes.  neighbour is null at the boundary; a side is closed where both its ends are.
    """
    more = [closed] if closed else []
    flat = elems.select("elem_id", F.posexplode("nodes").alias("k", "node_id")).join(dealt(nodes.select("node_id", "x", "y", u, v, *more)), "node_id")
    corner = F.struct("k", "node_id", "x", "y", F.col(u).alias("u"), F.col(v).alias("v"), (F.col(closed) if closed else F.lit(False)).alias("closed"))
    at = flat.groupBy("elem_id").agg(F.array_sort(F.collect_list(corner)).alias("c"))  # three of each
    c = [F.get("c", F.lit(k)) for k in range(3)]
    turn = F.signum((c[1]["x"] - c[0]["x"]) * (c[2]["y"] - c[0]["y"]) - (c[2]["x"] - c[0]["x"]) * (c[1]["y"] - c[0]["y"]))

    def side(p: Column, q: Column) -> Column:
        out = (q["y"] - p["y"]) * (p["u"] + q["u"]) / 2 - (q["x"] - p["x"]) * (p["v"] + q["v"]) / 2
        return F.struct(F.least(p["node_id"], q["node_id"]).alias("a"), F.greatest(p["node_id"], q["node_id"]).alias("b"), (turn * out).alias("flux"), (p["closed"] & q["closed"]).alias("closed"))

    sides = at.select("elem_id", F.explode(F.array(side(c[0], c[1]), side(c[1], c[2]), side(c[2], c[0]))).alias("s")).select("elem_id", "s.*")
    both = Window.partitionBy("a", "b")  # two rows at most
    other = F.when(F.count("*").over(both) == 2, F.min("elem_id").over(both) + F.max("elem_id").over(both) - F.col("elem_id"))
    return sides.withColumn("neighbour", other).select("elem_id", "neighbour", "flux", "closed")


def upwind_step(field: DataFrame, faces: DataFrame, area: DataFrame, value: str, dt: float, by: list[str] = [], incoming: float = 0.0) -> DataFrame:
    """One step of d(value)/dt = -div(flux).  faces: (elem_id, neighbour, flux and, if there, closed), flux > 0 out of the element, neighbour null at the boundary.

    What leaves is the element's own value, what enters the neighbour's.  A face moves a third of its source's area
    in a step at most, so no element gives more than it has.  At the boundary outflow is free; inflow has the value
    ``incoming`` where the boundary is open and is none where it is closed.  by: further keys of field, such as a direction.
    """
    own = field.select(*by, "elem_id", F.col(value).alias("_own"))
    there = own.select(*by, F.col("elem_id").alias("neighbour"), F.col("_own").alias("_there"))
    sized = area.select("elem_id", F.col("area").alias("_area"))
    limits = sized.select(F.col("elem_id").alias("neighbour"), F.col("_area").alias("_far"))
    closed = F.coalesce(F.col("closed"), F.lit(False)) if "closed" in faces.columns else F.lit(False)
    shared = [c for c in by if c in faces.columns]
    out = faces.join(dealt(sized), "elem_id").join(dealt(limits), "neighbour", "left").join(dealt(own), [*shared, "elem_id"]).join(dealt(there), [*by, "neighbour"], "left")
    inner = F.col("_far").isNotNull()
    leaves = F.least(F.col("flux"), F.col("_area") / dt / 3) * F.col("_own")
    enters = F.when(inner, -F.least(-F.col("flux"), F.col("_far") / dt / 3) * F.coalesce("_there", F.lit(0.0))).when(closed, 0.0).otherwise(F.col("flux") * incoming)
    moved = out.withColumn("_f", F.when(F.col("flux") > 0, leaves).otherwise(enters))
    net = moved.groupBy(*by, "elem_id").agg(F.sum("_f").alias("_net"))
    new = field.join(dealt(sized), "elem_id").join(dealt(net), [*by, "elem_id"], "left")
    return new.withColumn(value, F.col(value) - dt * F.coalesce("_net", F.lit(0.0)) / F.col("_area")).select(*field.columns)


def padded(grid: DataFrame, shape: tuple[int, int], width: int = 4, periodic: str = "xy", values: tuple[str, ...] = ("h",)) -> DataFrame:
    """A grid (i, j, ...) of this shape with ghost cells: copies of the far side along periodic axes ("xy", "y" or ""), zeros of ``values`` along others; an axis of one cell has none."""

    def ghosts(df: DataFrame, axis: str, n: int) -> DataFrame:
        if n == 1:
            return df
        c, off = F.col(axis), F.lit(None).cast("long")
        shifts = F.filter(F.array(F.lit(0), F.when(c < width, n).otherwise(off), F.when(c >= n - width, -n).otherwise(off)), lambda s: s.isNotNull())
        out = df.withColumn("_s", F.explode(shifts))
        if axis not in periodic:
            out = out.withColumns({v: F.when(F.col("_s") == 0, F.col(v)).otherwise(0.0) for v in values})
        return out.withColumn(axis, c + F.col("_s")).drop("_s")

    return ghosts(ghosts(grid, "j", shape[1]), "i", shape[0])


def weno3(grid: DataFrame, h: str, dt: float, by: list[str], axes: dict[str, str], dx: float = 1.0) -> DataFrame:
    """grid with ``sao``, the spatial operator of h by third-order WENO with limited high-order fluxes.

    axes: the velocity's column for each axis, {"i": "u"} or {"i": "u", "j": "v"}, at the lower edges of cells of side dx.
    Lines are keyed by ``by`` and the other axis.  Cells beyond the grid count as zero, so a grid should come padded.
    """
    eps, area = 1e-12, dx * dx

    def line(axis: str) -> Window:
        return Window.partitionBy(*by, *[a for a in ("i", "j") if a != axis]).orderBy(axis)

    def at(c: str, k: int, axis: str) -> Column:
        return F.coalesce(F.lag(c, k).over(line(axis)), F.lit(0.0)) if k else F.col(c)

    out = grid
    for axis, vel in axes.items():
        m2, m1, here, p1, u = at(h, 2, axis), at(h, 1, axis), F.col(h), at(h, -1, axis), F.col(vel)
        up = u > 0
        q0 = F.when(up, -0.5 * m2 + 1.5 * m1).otherwise(0.5 * m1 + 0.5 * here)
        q1 = F.when(up, 0.5 * m1 + 0.5 * here).otherwise(1.5 * here - 0.5 * p1)
        a0 = F.when(up, 1 / 3).otherwise(2 / 3)
        a1 = F.when(up, 2 / 3 * (F.abs(m2 - m1) + eps) / (F.abs(m1 - here) + eps)).otherwise(1 / 3 * (F.abs(m1 - here) + eps) / (F.abs(here - p1) + eps))
        low = u * F.when(up, m1).otherwise(here) * dx
        out = out.withColumns({f"_l{axis}": low, f"_h{axis}": u * (a0 * q0 + a1 * q1) * dx / (a0 + a1) - low})
    spread = lambda p: sum((at(f"{p}{a}", -1, a) - F.col(f"{p}{a}") for a in axes), F.lit(0.0))
    out = out.withColumn("_g", F.col(h) - dt * spread("_l") / area)
    most = 0.25 / dt * area
    for axis in axes:
        held = F.greatest(-most * F.col("_g"), F.least(most * at("_g", 1, axis), F.col(f"_h{axis}")))
        out = out.withColumn(f"_f{axis}", F.col(f"_l{axis}") + held)
    out = out.withColumn("sao", -spread("_f") / area)
    return out.select(*grid.columns, "sao")


def weno_step(grid: DataFrame, h: str, dt: float, shape: tuple[int, int], axes: dict[str, str], by: list[str] = [], periodic: str = "xy", dx: float = 1.0, land: str | None = None) -> DataFrame:
    """One step: a prediction, and the mean with its correction; land cells go to zero."""
    wide = padded(grid.withColumn("_z", F.lit(True)), shape, 4, periodic, (h,))
    first = weno3(wide, h, dt, by, axes, dx).withColumn("_p", F.col(h) + dt * F.col("sao")).drop("sao")
    second = weno3(first, "_p", dt, by, axes, dx)
    inside = F.col("i").between(0, shape[0] - 1) & F.col("j").between(0, shape[1] - 1)
    new = (F.col(h) + F.col("_p") + dt * F.col("sao")) / 2
    return second.where(inside).withColumn(h, new if land is None else F.when(F.col(land), 0.0).otherwise(new)).select(*grid.columns)
