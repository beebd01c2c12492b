"""Triangle meshes as tables: node(node_id, x, y), elem(elem_id, nodes); geometry, adjacency, node and element fields."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyre.functions import geodesy
from gyre.functions import geometry as g
from gyre.functions.geodesy import MapSpec
from gyre.joins import dealt
from gyre.shared import written

from .fields import renumbered


def lattice(spark: SparkSession, nx: int, ny: int, step: float) -> tuple[DataFrame, DataFrame]:
    """A rectangle of nx by ny cells, each cut from its lower left to its upper right corner; node and element ids from 1."""
    w = nx + 1
    i, j = F.col("id") % w, F.floor(F.col("id") / w)
    nodes = spark.range(w * (ny + 1)).select((F.col("id") + 1).alias("node_id"), (i * step).cast("double").alias("x"), (j * step).cast("double").alias("y"))
    c = spark.range(2 * nx * ny).select((F.col("id") + 1).alias("elem_id"), F.floor(F.col("id") / 2).alias("cell"), (F.col("id") % 2).alias("up"))
    a = F.floor(F.col("cell") / nx) * w + F.col("cell") % nx + 1
    up = F.col("up") == 1
    return nodes, c.select("elem_id", F.array(a, F.when(up, a + w + 1).otherwise(a + 1), F.when(up, a + w).otherwise(a + w + 1)).cast("array<bigint>").alias("nodes"))


def corners(elems: DataFrame, nodes: DataFrame, *values: str) -> DataFrame:
    """elems with x1..x3, y1..y3 and the corner values of each column; one shuffle on node ids, one on element ids."""
    flat = elems.select("elem_id", F.posexplode("nodes").alias("k", "node_id")).join(dealt(nodes.select("node_id", "x", "y", *values)), "node_id")
    pick = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k + 1}") for k in range(3) for c in ("x", "y", *values)]
    return flat.groupBy("elem_id").agg(*pick)


def geometry(at: DataFrame) -> DataFrame:
    """area, jacobian, sides and least angle of elements with their corners."""
    p = [F.col(c) for c in ("x1", "y1", "x2", "y2", "x3", "y3")]
    a, b, c = g.sides(*p)
    out = at.withColumns({"jacobian": g.jacobian(*p), "area": g.area(*p), "side1": a, "side2": b, "side3": c})
    return out.withColumn("min_angle", g.min_angle(F.col("side1"), F.col("side2"), F.col("side3")))


def quality(geo: DataFrame) -> DataFrame:
    """One row: resolution (root of the mean area), mean shortest and longest side, least angle, whether triangles of both turns meet."""
    s = [F.col(f"side{k}") for k in (1, 2, 3)]
    return geo.agg(
        F.sqrt(F.avg("area")).alias("resolution"), F.avg(F.least(*s)).alias("min_side"), F.avg(F.greatest(*s)).alias("max_side"),
        F.min("min_angle").alias("min_angle"), ((F.min("jacobian") <= 0) & (F.max("jacobian") >= 0)).alias("flip"),
    )


def displaced(nodes: DataFrame, ux: str, uy: str, factor: float = 1.0) -> DataFrame:
    """Nodes moved by a share of a displacement."""
    return nodes.withColumns({"x": F.col("x") + factor * F.col(ux), "y": F.col("y") + factor * F.col(uy)})


def surface_factor(new_area, old_area):
    """Ratio of areas after a displacement; an element that turned over (a negative area) is an error."""
    return F.when(new_area < 0, F.raise_error(F.lit("an element turned over")).cast("double")).otherwise(new_area / old_area)


def node_sizes(elems: DataFrame, geo: DataFrame) -> DataFrame:
    """hmin and hmax of nodes from the areas of their elements."""
    by = elems.select("elem_id", F.explode("nodes").alias("node_id")).join(dealt(geo.select("elem_id", "area")), "elem_id").groupBy("node_id")
    return by.agg((0.8 * math.sqrt(2) * F.sqrt(F.min("area"))).alias("hmin"), (1.2 * math.sqrt(2) * F.sqrt(F.max("area"))).alias("hmax"))


def elements_to_nodes(elems: DataFrame, field: DataFrame, value: str) -> DataFrame:
    return elems.select("elem_id", F.explode("nodes").alias("node_id")).join(field.select("elem_id", value), "elem_id").groupBy("node_id").agg(F.avg(value).alias(value))


def nodes_to_elements(elems: DataFrame, field: DataFrame, value: str) -> DataFrame:
    return elems.select("elem_id", F.explode("nodes").alias("node_id")).join(field.select("node_id", value), "node_id").groupBy("elem_id").agg(F.avg(value).alias(value))


def edges(elems: DataFrame) -> DataFrame:
    """(a, b, elem_id), a < b: the three edges of each element."""
    n = F.col("nodes")
    pairs = F.array(*[F.struct(F.least(n[i], n[j]).alias("a"), F.greatest(n[i], n[j]).alias("b")) for i, j in ((0, 1), (1, 2), (0, 2))])
    return elems.select("elem_id", F.explode(pairs).alias("e")).select("e.a", "e.b", "elem_id")


def neighbours(elems: DataFrame) -> DataFrame:
    """(elem_id, neighbour) over shared edges, by one aggregation on the edge instead of a self-join."""
    both = edges(elems).groupBy("a", "b").agg(F.min("elem_id").alias("p"), F.max("elem_id").alias("q")).where("p <> q")
    return both.select(F.explode(F.array(F.struct(F.col("p").alias("elem_id"), F.col("q").alias("neighbour")), F.struct(F.col("q").alias("elem_id"), F.col("p").alias("neighbour")))).alias("n")).select("n.*")


def boundary(elems: DataFrame) -> DataFrame:
    return edges(elems).groupBy("a", "b").agg(F.count("*").alias("n"), F.max("elem_id").alias("elem_id")).where("n = 1").drop("n")


def boundary_edges(elems: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, elem_id, x1, y1, x2, y2) of the edges that one element has."""
    end = lambda c, k: nodes.select(F.col("node_id").alias(c), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    return boundary(elems).join(end("a", 1), "a").join(end("b", 2), "b")


def reordered(elems: DataFrame, nodes: DataFrame, node_map: DataFrame, elem_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elems, nodes) under new numbers: node_map(node_id, new_id), elem_map(elem_id, new_id)."""
    n = nodes.join(dealt(node_map), "node_id").drop("node_id").withColumnRenamed("new_id", "node_id").select(*nodes.columns)
    flat = elems.select("elem_id", F.posexplode("nodes").alias("k", "node_id")).join(dealt(node_map), "node_id")
    own = flat.groupBy("elem_id").agg(F.array_sort(F.collect_list(F.struct("k", "new_id"))).alias("n"))  # three of each
    moved = own.join(dealt(elem_map.withColumnRenamed("new_id", "_e")), "elem_id").select(F.col("_e").alias("elem_id"), F.col("n.new_id").alias("nodes"))
    return moved, n


def smoothed(nodes: DataFrame, elems: DataFrame, share: float, rounds: int = 1) -> DataFrame:
    """Nodes moved by ``share`` of the way to the mean of their neighbours; nodes of the boundary stay."""
    e = edges(elems).select("a", "b").distinct()
    both = e.union(e.select("b", "a")).toDF("node_id", "other")
    rim = boundary(elems).select(F.explode(F.array("a", "b")).alias("node_id")).distinct().withColumn("_rim", F.lit(True))
    out = nodes.join(rim, "node_id", "left")
    for _ in range(rounds):
        mean = both.join(out.select(F.col("node_id").alias("other"), "x", "y"), "other").groupBy("node_id").agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"))
        at = out.join(mean, "node_id", "left")
        new = {c: F.when(F.col("_rim").isNull() & F.col(f"_{c}").isNotNull(), F.col(c) + share * (F.col(f"_{c}") - F.col(c))).otherwise(F.col(c)) for c in "xy"}
        out = at.withColumns(new).select(*out.columns)
    return out.select(*nodes.columns)


def partitioned(at: DataFrame, parts: int, x: str, y: str, cells: int = 1024) -> DataFrame:
    """at with ``part``: elements in the order of a space-filling (Z) curve, cut into parts of about equal size by approximate quantiles of the key."""
    box = at.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1")).first()
    place = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) / max((hi or 0) - (lo or 0), 1e-300) * cells), F.lit(cells - 1)).cast("long")
    i, j, bits = place(x, box[0] or 0.0, box[1]), place(y, box[2] or 0.0, box[3]), cells.bit_length() - 1
    key = sum((F.shiftleft(F.shiftright(i, k).bitwiseAND(1), 2 * k) + F.shiftleft(F.shiftright(j, k).bitwiseAND(1), 2 * k + 1) for k in range(bits)), F.lit(0).cast("long"))
    keyed = at.withColumn("_key", key)
    cuts = sorted(set(keyed.agg(F.percentile_approx("_key", [k / parts for k in range(1, parts)], 10_000)).first()[0] or [])) if parts > 1 else []
    return keyed.withColumn("part", sum((F.when(F.col("_key") > c, 1).otherwise(0) for c in cuts), F.lit(0))).drop("_key")


def node_graph(elems: DataFrame) -> DataFrame:
    """(node_id, degree, adjacent): sparse adjacency of nodes."""
    e = edges(elems).select("a", "b").distinct()
    return e.union(e.select("b", "a")).toDF("node_id", "other").groupBy("node_id").agg(F.count("*").alias("degree"), F.sort_array(F.collect_list("other")).alias("adjacent"))


def barycentres(at: DataFrame) -> DataFrame:
    return at.select("elem_id", ((F.col("x1") + F.col("x2") + F.col("x3")) / 3).alias("bx"), ((F.col("y1") + F.col("y2") + F.col("y3")) / 3).alias("by"))


def sub_domains(elems: DataFrame) -> DataFrame:
    """(elem_id, label): label is the least element of the connected part.

    Labels move over shared edges and jump to the label of their label, so the rounds
    grow with the logarithm of a part's width; each round's table is written into the
    shared folder.
    """
    near = written(neighbours(elems), "neighbours")
    labels = elems.select("elem_id", F.col("elem_id").alias("label"))
    while True:
        best = near.join(labels.select(F.col("elem_id").alias("neighbour"), F.col("label").alias("l")), "neighbour").groupBy("elem_id").agg(F.min("l").alias("l"))
        jump = labels.select(F.col("elem_id").alias("label"), F.col("label").alias("j"))
        step = written(labels.join(best, "elem_id", "left").join(jump, "label").select("elem_id", "label", F.least("label", "l", "j").alias("new")), "labels")
        changed = step.where("new < label").limit(1).count()
        labels = step.select("elem_id", F.col("new").alias("label"))
        if not changed:
            return labels


def node_classes(parts: DataFrame) -> DataFrame:
    """(part, node_id, owner, class, number) of every part and node it has, from elements (nodes, part).

    A node that several parts see belongs to the least of them; it is a "ghost" of the others, "shared" with its owner, and
    "inner" where one part sees it.  number: from 0 without gaps within a part and class, in the order of nodes; a part is a task's share of the
    mesh, so its nodes are sorted in one task.
    """
    seen = parts.select("part", F.explode("nodes").alias("node_id")).distinct()
    owner = seen.groupBy("node_id").agg(F.min("part").alias("owner"), F.count("*").alias("_n"))
    kind = F.when(F.col("part") != F.col("owner"), "ghost").when(F.col("_n") > 1, "shared").otherwise("inner")
    out = seen.join(owner, "node_id").withColumn("class", kind)
    return out.withColumn("number", F.row_number().over(Window.partitionBy("part", "class").orderBy("node_id")).cast("long") - 1).select("part", "node_id", "owner", "class", "number")


def graded(nodes: DataFrame, elems: DataFrame, size: str, ratio: float) -> DataFrame:
    """nodes with sizes (of elements wished around them) that grow by log(ratio) times the way along edges at most: the greatest such sizes under the given ones.

    Relaxation over edges from a frontier: nodes whose size fell offer theirs to their neighbours, until none falls; each round's
    table is written.  Sizes alike in all directions; ratio is over 1.
    """
    e = edges(elems).select("a", "b").distinct()
    at = nodes.select("node_id", "x", "y")
    both = e.union(e.select("b", "a")).toDF("node_id", "other").join(at, "node_id").join(at.toDF("other", "ox", "oy"), "other")
    ways = written(both.select("node_id", "other", (math.log(ratio) * F.hypot(F.col("ox") - F.col("x"), F.col("oy") - F.col("y"))).alias("way")), "ways")
    sizes = frontier = nodes.select("node_id", F.col(size).cast("double").alias("h"))
    while True:
        offer = ways.join(frontier, "node_id").groupBy("other").agg(F.min(F.col("h") + F.col("way")).alias("o"))
        step = written(sizes.join(offer.withColumnRenamed("other", "node_id"), "node_id", "left").select("node_id", F.least("h", "o").alias("h"), (F.col("o") < F.col("h")).alias("fell")), "sizes")
        sizes, frontier = step.select("node_id", "h"), step.where("fell").select("node_id", "h")
        if frontier.isEmpty():
            return nodes.join(sizes.withColumnRenamed("h", "_h"), "node_id").withColumn(size, F.col("_h")).select(*nodes.columns)


def geographic(nodes: DataFrame, elems: DataFrame, name: str, m: MapSpec) -> tuple[DataFrame, DataFrame]:
    """(nodes with lat and lon, (elem_id, lat, lon): the means of elements' corners) of a mesh on a map; a mesh across the end of the longitudes counts them on from its first corner's."""
    lat, lon = geodesy.inverse(name, F.col("x"), F.col("y"), m)
    held = nodes.withColumns({"lat": lat, "lon": lon})
    at = corners(elems, held, "lat", "lon")
    near = [F.col("lon1"), *[F.col("lon1") + geodesy.wrap(F.col(f"lon{k}") - F.col("lon1"), -180.0) for k in (2, 3)]]
    return held, at.select("elem_id", ((F.col("lat1") + F.col("lat2") + F.col("lat3")) / 3).alias("lat"), geodesy.wrap((near[0] + near[1] + near[2]) / 3, -180.0).alias("lon"))


def turned(nodes: DataFrame, degrees: float) -> DataFrame:
    """Nodes in axes that are turned by an angle."""
    x, y = geodesy.rotate(F.col("x"), F.col("y"), degrees)
    return nodes.withColumns({"x": x, "y": y})


def renumbered_by_domain(elems: DataFrame) -> DataFrame:
    """elems with label (see ``sub_domains``) and new_id: gapless numbers, one domain after another."""
    return renumbered(elems.join(sub_domains(elems), "elem_id"), ["label", "elem_id"])
