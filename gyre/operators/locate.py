"""Points in triangles, boxes and grids: joins on grid-bucket keys, so a spatial join is an equi-join with a residual test."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.functions import geometry as g
from gyre.joins import dealt
from gyre.shared import written

#: Elements (some 100 bytes in each of nine buckets or so) are broadcast up to so many.
BROADCAST_ELEMENTS = 50_000


def bucketed(rows: DataFrame, x0, x1, y0, y1, size: float) -> DataFrame:
    """One row for each bucket (bx, by) that a row's box meets."""
    b = lambda c: F.floor(c / size).cast("long")
    out = rows.withColumn("bx", F.explode(F.sequence(b(x0), b(x1))))
    return out.withColumn("by", F.explode(F.sequence(b(y0), b(y1))))


def level_of(extent: Column, size: float) -> Column:
    """The least k with size * 2**k >= extent, from -40 on."""
    return F.greatest(F.lit(-40), F.ceil(F.log2(F.greatest(extent, F.lit(1e-300)) / size))).cast("int")


def in_triangles(points: DataFrame, at: DataFrame, size: float, keep: list[str] = ()) -> DataFrame:
    """points (px, py) with elem_id, the barycentric l1, l2, l3 and ``keep`` of the element that holds them; others: null.

    at: elements with corners.  Of several elements (shared edges, tolerance 1e-11) the
    highest id holds a point; elements without area hold none.  Each element is filed by its own size, in the nine buckets or so of half
    the power of two times ``size`` that it fits, so meshes of elements of very unlike sizes stay cheap; a point looks into one bucket of each level there is (few: one for each doubling
    from the least to the greatest element).  A bucket is one row with the list of its elements (those of a mesh don't
    overlap, so a list is short); the buckets of the levels with fewest elements are broadcast, up to ``BROADCAST_ELEMENTS``
    of them, counted, and then points don't move; those of the others are never broadcast.  Every row of points gives one row.
    """
    xs, ys = [F.col(f"x{k}") for k in (1, 2, 3)], [F.col(f"y{k}") for k in (1, 2, 3)]
    pad = 1e-9
    turn = g.jacobian(*[c for p in zip(xs, ys) for c in p])
    box = {"_x0": F.least(*xs) - pad, "_x1": F.greatest(*xs) + pad, "_y0": F.least(*ys) - pad, "_y1": F.greatest(*ys) + pad}
    # l1 and l2 are linear in the way from the first corner, so a test of an element is a few products
    slopes = {"_a1": (ys[1] - ys[2]) / turn, "_a2": (xs[2] - xs[1]) / turn, "_b1": (ys[2] - ys[0]) / turn, "_b2": (xs[0] - xs[2]) / turn}
    held = ["elem_id", "x1", "y1", *slopes, *keep]
    el = at.where(turn != 0).withColumns(box | slopes).withColumn("_level", level_of(F.greatest(F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys)) * (1 - 1e-9), size))
    el = written(el.select("_level", *box, *held), "elements")
    levels = {r._level: r.n for r in el.groupBy("_level").agg(F.count("*").alias("n")).collect()}  # some eighty rows at most
    few, total = {}, 0
    for k, n in sorted(levels.items(), key=lambda kn: kn[1]):
        total += n
        few[k] = F.broadcast if total <= BROADCAST_ELEMENTS else dealt
    out, hits = points, []

    def weights(e: Column) -> tuple[Column, Column]:
        dx, dy = F.col("px") - e["x1"], F.col("py") - e["y1"]
        return 1 + (e["_a1"] * dx + e["_a2"] * dy), e["_b1"] * dx + e["_b2"] * dy

    def holds(e: Column) -> Column:
        l1, l2 = weights(e)
        return (l1 >= g.TOLERANCE) & (l2 >= g.TOLERANCE) & (l1 + l2 <= 1 - g.TOLERANCE)

    for k in sorted(levels):
        cell, names = size * 2.0 ** (k - 1), [f"_b{k}x".replace("-", "m"), f"_b{k}y".replace("-", "m"), f"_e{k}".replace("-", "m")]
        lists = bucketed(el.where(F.col("_level") == k), F.col("_x0"), F.col("_x1"), F.col("_y0"), F.col("_y1"), cell).groupBy(F.col("bx").alias(names[0]), F.col("by").alias(names[1]))
        lists = lists.agg(F.collect_list(F.struct(*held)).alias(names[2]))
        at_ = lambda c: F.when(F.abs(F.col(c).cast("double")) < math.inf, F.floor(F.col(c) / cell).cast("long"))  # noqa: E731  # NaN is above all
        out = out.withColumns({names[0]: at_("px"), names[1]: at_("py")}).join(few[k](lists), names[:2], "left")
        hits.append(F.array_max(F.filter(names[2], holds)))
    if not hits:
        types = dict(at.dtypes)
        return points.select("*", F.lit(None).cast(types["elem_id"]).alias("elem_id"), *[F.lit(None).cast("double").alias(c) for c in ("l1", "l2", "l3")], *[F.lit(None).cast(types[c]).alias(c) for c in keep])
    own = out.withColumn("_e", F.greatest(*hits) if len(hits) > 1 else hits[0]).select(*points.columns, "_e")
    l1, l2 = weights(F.col("_e"))
    return own.select(*points.columns, "_e.elem_id", l1.alias("l1"), l2.alias("l2"), (1 - l1 - l2).alias("l3"), *[F.col("_e")[c].alias(c) for c in keep])


def stored_weights(held: DataFrame, key: list[str], elems: DataFrame) -> DataFrame:
    """(key, node_id, w): the barycentric weights of ``in_triangles`` as a table to keep and apply again."""
    parts = F.array(*[F.struct(F.col("nodes")[k].alias("node_id"), F.col(f"l{k + 1}").alias("w")) for k in range(3)])
    return held.where("elem_id is not null").join(elems.select("elem_id", "nodes"), "elem_id").select(*key, F.explode(parts).alias("p")).select(*key, "p.*")


def interpolated(held: DataFrame, value: str | list[str], default: float) -> DataFrame:
    """Nodal values by barycentric weights of corner values value1..value3, of one variable or several; points outside: the default."""
    names = [value] if isinstance(value, str) else value
    v = {n: F.col("l1") * F.col(f"{n}1") + F.col("l2") * F.col(f"{n}2") + F.col("l3") * F.col(f"{n}3") for n in names}
    return held.withColumns({n: F.when(F.col("elem_id").isNull(), default).otherwise(c) for n, c in v.items()})


def rasterised(grid: DataFrame, at: DataFrame, size: float, value: str, default: float) -> DataFrame:
    """grid (px, py) with the element value of the last (highest) triangle that covers each point."""
    held = in_triangles(grid, at, size, [value])
    return held.withColumn(value, F.coalesce(value, F.lit(default)))


def cell_values(points: DataFrame, grid: DataFrame, start: tuple[float, float], step: float, shape: tuple[int, int], value: str | list[str]) -> DataFrame:
    """points (px, py) with i, j, dx, dy and the four corner values v00, v10, v01, v11 of their cell of a regular grid (i, j, value); of a list of variables, each has its own four (u00, ...)."""
    nx, ny = shape
    p = points.withColumns({"i": g.bracket(F.col("px"), start[0], step, nx), "j": g.bracket(F.col("py"), start[1], step, ny)})
    p = p.withColumns({"dx": (F.col("px") - start[0]) / step - F.col("i"), "dy": (F.col("py") - start[1]) / step - F.col("j")})
    names = {value: "v"} if isinstance(value, str) else {v: v for v in value}
    # The four corners of a cell are gathered once for each cell, not for each point.
    corner = lambda a, b: F.struct((F.col("i") - a).cast("int").alias("ci"), (F.col("j") - b).cast("int").alias("cj"), F.lit(2 * b + a).alias("k"), *[F.col(v).alias(n) for v, n in names.items()])
    c = grid.select(F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("c")).select("c.*")
    cells = c.groupBy("ci", "cj").agg(*[F.max(F.when(F.col("k") == k, F.col(n))).alias(n + at) for n in names.values() for k, at in enumerate(("00", "10", "01", "11"))])
    return p.join(cells, (p.i == cells.ci) & (p.j == cells.cj), "left").drop("ci", "cj")


def place_of(points: DataFrame) -> DataFrame:
    """The distinct finite places (px, py): what is nearest depends on the place alone, so rows that share one are looked up once."""
    return points.where((F.abs(F.col("px").cast("double")) < math.inf) & (F.abs(F.col("py").cast("double")) < math.inf)).select("px", "py").distinct()  # NaN is above all


def nearest_within(places: DataFrame, nodes: DataFrame, size: float) -> DataFrame:
    """(px, py, m: d2 and node_id of the nearest node) of the places with a node within ``size`` (ties: the lower id); a node goes to the nine buckets around it."""
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    b = lambda c: F.floor(F.col(c) / size).cast("long")
    wide = nodes.select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny")).withColumns({"cx": b("nx"), "cy": b("ny")})
    wide = wide.withColumn("sx", F.explode(near)).withColumn("sy", F.explode(near)).withColumns({"bx": F.col("cx") + F.col("sx"), "by": F.col("cy") + F.col("sy")})
    pt = places.withColumns({"bx": b("px"), "by": b("py")})
    d2 = F.pow(F.col("px") - F.col("nx"), F.lit(2)) + F.pow(F.col("py") - F.col("ny"), F.lit(2))
    return pt.join(wide.select("bx", "by", "node_id", "nx", "ny"), ["bx", "by"]).where(d2 <= size**2).groupBy("px", "py").agg(F.min(F.struct(d2.alias("d2"), "node_id")).alias("m"))


def too_close(points: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """points with ``close``: whether a node lies within the radius."""
    near = nearest_within(place_of(points), nodes, radius).select("px", "py", F.lit(True).alias("close"))
    return points.join(near, ["px", "py"], "left").withColumn("close", F.coalesce("close", F.lit(False))).select(*points.columns, "close")


def outward(places: DataFrame, some: bool, size: float, lookup) -> list[DataFrame]:
    """Rounds of ``lookup(places, size)`` (px, py, m), each over the places left, with twice the size of the one before, until none is left; a round's table is written."""
    found = []
    while some:
        step = written(places.join(lookup(places, size), ["px", "py"], "left"), "nearest")
        found.append(step.where("m is not null"))
        places = step.where("m is null").drop("m")
        some, size = not places.isEmpty(), 2 * size
    return found


def nearest_edge(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """points with the nearest edge (a, b) of edges (a, b, x1, y1, x2, y2), its squared distance d2 and the place t along it (0 at a, 1 at b); ties: the lower (a, b).

    As in ``nearest_vertex`` places without an edge within ``size`` are looked up again with twice the size.  Null without edges, or without a finite place.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy) / length))).otherwise(0.0)
    ex, ey = F.col("px") - F.col("x1") - F.col("t") * dx, F.col("py") - F.col("y1") - F.col("t") * dy

    def lookup(places: DataFrame, size: float) -> DataFrame:
        wide = bucketed(edges, F.least("x1", "x2") - size, F.greatest("x1", "x2") + size, F.least("y1", "y2") - size, F.greatest("y1", "y2") + size, size)
        pt = places.withColumns({"bx": F.floor(F.col("px") / size).cast("long"), "by": F.floor(F.col("py") / size).cast("long")})
        hit = pt.join(wide, ["bx", "by"]).withColumn("t", t).withColumn("d2", ex * ex + ey * ey).where(F.col("d2") <= size * size)
        return hit.groupBy("px", "py").agg(F.min(F.struct("d2", "a", "b", "t")).alias("m"))

    found = outward(place_of(points), not edges.isEmpty(), size, lookup)
    if not found:
        return points.select("*", *[F.lit(None).cast(k).alias(c) for c, k in (("a", "long"), ("b", "long"), ("d2", "double"), ("t", "double"))])
    return points.join(reduce(DataFrame.union, found), ["px", "py"], "left").select(*points.columns, "m.a", "m.b", "m.d2", "m.t")


def extrapolated(outside: DataFrame, edges: DataFrame, nodes: DataFrame, key: list[str], size: float, value: str) -> DataFrame:
    """(key, value) of points beyond a mesh: linear between the ends of the nearest boundary edge."""
    near = nearest_edge(outside, edges, size)
    ends = [nodes.select(F.col("node_id").alias(c), F.col(value).alias(f"_{c}")) for c in "ab"]
    return near.join(ends[0], "a").join(ends[1], "b").select(*key, ((1 - F.col("t")) * F.col("_a") + F.col("t") * F.col("_b")).alias(value))


#: Nodes that a node's own bucket has in the mean, at most, where a search begins.
CROWD = 8


def first_size(nodes: DataFrame) -> float:
    """The bucket side at which a search begins: from the nodes' own density, halved while the mean node shares its bucket with more than ``CROWD``."""
    n, x0, x1, y0, y1 = nodes.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    size = max(2 * math.sqrt(max(x1 - x0, 1e-300) * max(y1 - y0, 1e-300) / n), max(x1 - x0, y1 - y0) / n, 1e-9)
    for _ in range(24):
        by = nodes.groupBy(F.floor(F.col("x") / size).alias("a"), F.floor(F.col("y") / size).alias("b")).agg(F.count("*").cast("double").alias("c"))
        if by.agg(F.sum(F.col("c") * F.col("c"))).first()[0] <= CROWD * n:
            break
        size /= 2
    return size


def nearest_vertex(points: DataFrame, nodes: DataFrame, size: float | None = None) -> DataFrame:
    """points with node_id and d2 of the nearest node (ties: the lower id), however far.

    Places without a node within ``size`` (from the nodes' density, if it isn't given) are looked up again among buckets of
    twice the size, until none is left; each round's table is written into the shared folder.
    Null only without nodes, or for points without a finite place.
    """
    kind = dict(nodes.dtypes)["node_id"]
    # of nodes at one place the lowest id is nearest
    nodes = written(nodes.where(reduce(and_, [F.abs(F.col(c).cast("double")) < math.inf for c in "xy"])).groupBy("x", "y").agg(F.min("node_id").alias("node_id")), "nodes")
    some = not nodes.isEmpty()
    found = outward(place_of(points), some, (size or first_size(nodes)) if some else 1.0, lambda places, size: nearest_within(places, nodes, size))
    if not found:
        return points.select("*", F.lit(None).cast(kind).alias("node_id"), F.lit(None).cast("double").alias("d2"))
    return points.join(reduce(DataFrame.union, found), ["px", "py"], "left").select(*points.columns, "m.node_id", "m.d2")
