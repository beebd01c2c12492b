"""Queries over an irregular mesh whose nodes are the rows of ``part``, each with SQL by another way; registered beside those of ``queries``.

A part is a node of a lattice of 20 to a row, moved by its size and key; two triangles lie between a node and those to
its right and above, where these are parts too, so the last row of the mesh may be ragged.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyre.functions import geometry
from gyre.functions.geodesy import MapSpec
from gyre.joins import dealt
from gyre.operators import advection, drifters, fields, locate, mesh, noise, remap, waves
from gyre.shared import written

from .field_queries import spectra
from .queries import query, r, table

WIDTH, STEP = 20, 5.0


def part_nodes(spark, sf_dir) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    i, j = k % WIDTH, F.floor(k / WIDTH)
    return table(spark, sf_dir, "part").select(
        k.alias("node_id"), i.alias("i"), j.alias("j"), (i * STEP + (size % 7 - 3) * 0.3).alias("x"), (j * STEP + (k * 7 % 11 - 5) * 0.2).alias("y"), F.col("p_retailprice").alias("f"),
        ((size % 5 - 2) * 0.4).alias("u"), ((size % 3 - 1) * 0.6).alias("v"), size.alias("size"),
    )


def part_mesh(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(nodes, elems): elements 2 k and 2 k + 1 lie above the node k, the first one to the right."""
    nodes = part_nodes(spark, sf_dir)
    far = nodes.select((F.col("node_id") - WIDTH - 1).alias("node_id"))
    k = F.col("node_id")
    cells = nodes.where(F.col("i") < WIDTH - 1).join(dealt(far), "node_id", "left_semi").select(k, "i", "j")
    both = F.array(F.struct((2 * k).alias("elem_id"), F.array(k, k + 1, k + WIDTH + 1).alias("nodes")), F.struct((2 * k + 1).alias("elem_id"), F.array(k, k + WIDTH + 1, k + WIDTH).alias("nodes")))
    return nodes, cells.select("i", "j", F.explode(both).alias("e")).select("e.elem_id", "e.nodes", "i", "j")


TN = """tn AS (SELECT p_partkey AS node_id, p_partkey % 20 AS i, p_partkey // 20 AS j, (p_partkey % 20) * 5.0::DOUBLE + (p_size % 7 - 3) * 0.3::DOUBLE AS x, (p_partkey // 20) * 5.0::DOUBLE + (p_partkey * 7 % 11 - 5) * 0.2::DOUBLE AS y,
p_retailprice AS f, (p_size % 5 - 2) * 0.4::DOUBLE AS u, (p_size % 3 - 1) * 0.6::DOUBLE AS v, p_size AS size FROM part)"""
TE = f"""{TN}, cell AS (SELECT a.node_id AS k, a.i, a.j FROM tn AS a JOIN tn AS b ON b.node_id = a.node_id + 21 WHERE a.i < 19),
te AS (SELECT 2 * k AS elem_id, k AS n1, k + 1 AS n2, k + 21 AS n3, i, j FROM cell UNION ALL SELECT 2 * k + 1, k, k + 21, k + 20, i, j FROM cell)"""
_AT = "SELECT elem_id, te.i, te.j, n1, n2, n3, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, c.x AS x3, c.y AS y3, a.f AS f1, b.f AS f2, c.f AS f3 FROM te JOIN {0} AS a ON a.node_id = n1 JOIN {0} AS b ON b.node_id = n2 JOIN {0} AS c ON c.node_id = n3"
_SHAPE = "SELECT *, (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1) AS jac, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS s1, sqrt(pow(x3 - x2, 2) + pow(y3 - y2, 2)) AS s2, sqrt(pow(x1 - x3, 2) + pow(y1 - y3, 2)) AS s3 FROM {0}"
_ANGLE = "degrees(acos((s1 * s1 + s2 * s2 + s3 * s3 - 2 * pow(least(s1, s2, s3), 2)) / (2 * s1 * s2 * s3 / least(s1, s2, s3))))"
TT = f"{TE}, tt AS ({_AT.format('tn')}), shape AS ({_SHAPE.format('tt')})"
SIDES = f"{TE}, side AS (SELECT elem_id, i, j, unnest([[least(n1, n2), greatest(n1, n2)], [least(n2, n3), greatest(n2, n3)], [least(n1, n3), greatest(n1, n3)]]) AS e FROM te)"


# -- geometry --------------------------------------------------------------------------------
@query(f"WITH {TT} SELECT elem_id, round(abs(jac) / 2, 6) AS area, round({_ANGLE}, 4) AS min_angle, round(greatest(s1, s2, s3), 6) AS longest FROM shape")
def elem_geometry(spark, sf_dir):
    nodes, elems = part_mesh(spark, sf_dir)
    geo = mesh.geometry(mesh.corners(elems, nodes))
    return geo.select("elem_id", r(F.col("area")).alias("area"), r(F.col("min_angle"), 4).alias("min_angle"), r(F.greatest("side1", "side2", "side3")).alias("longest"))


@query(f"WITH {TT} SELECT round(sqrt(avg(abs(jac) / 2)), 6) AS resolution, round(avg(least(s1, s2, s3)), 6) AS min_side, round(avg(greatest(s1, s2, s3)), 6) AS max_side, round(min({_ANGLE}), 4) AS min_angle, min(jac) <= 0 AND max(jac) >= 0 AS flip FROM shape")
def mesh_quality(spark, sf_dir):
    nodes, elems = part_mesh(spark, sf_dir)
    q = mesh.quality(mesh.geometry(mesh.corners(elems, nodes)))
    return q.select(*[r(F.col(c)).alias(c) for c in ("resolution", "min_side", "max_side")], r(F.col("min_angle"), 4).alias("min_angle"), "flip")


@query(f"""WITH {TT}, far AS (SELECT * REPLACE (x + 0.5 * u AS x, y + 0.5 * v AS y) FROM tn), new AS ({_AT.format('far')}), moved AS ({_SHAPE.format('new')})
SELECT elem_id, round(m.jac / 2, 6) AS area, round({_ANGLE.replace('s1', 'm.s1').replace('s2', 'm.s2').replace('s3', 'm.s3')}, 6) AS min_angle, round(m.jac / shape.jac, 6) AS factor FROM moved AS m JOIN shape USING (elem_id)""")
def irregular_quality(spark, sf_dir):
    """Area, least angle and change of area of each element after half a displacement of its nodes."""
    nodes, elems = part_mesh(spark, sf_dir)
    before = mesh.geometry(mesh.corners(elems, nodes)).select("elem_id", (F.col("jacobian") / 2).alias("old"))
    after = mesh.geometry(mesh.corners(elems, mesh.displaced(nodes, "u", "v", 0.5))).join(before, "elem_id")
    signed = F.col("jacobian") / 2
    return after.select("elem_id", r(signed).alias("area"), r(F.col("min_angle")).alias("min_angle"), r(mesh.surface_factor(signed, F.col("old"))).alias("factor"))


@query(f"""WITH {TT} SELECT elem_id, round(((f2 - f1) * (y3 - y1) - (f3 - f1) * (y2 - y1)) / jac, 8) + 0.0 AS dfdx, round(((x2 - x1) * (f3 - f1) - (x3 - x1) * (f2 - f1)) / jac, 8) + 0.0 AS dfdy FROM shape""")
def elem_gradient(spark, sf_dir):
    """Gradients of nodal fields by the shape functions; the SQL solves for the plane through three corners."""
    nodes, elems = part_mesh(spark, sf_dir)
    at = mesh.corners(elems, nodes, "f")
    b = geometry.shape_coefficients(*[F.col(f"{c}{k}") for k in (1, 2, 3) for c in "xy"])
    slope = lambda part: sum((b[part + k] * F.col(f"f{k + 1}") for k in range(3)), F.lit(0.0))
    return at.select("elem_id", r(slope(0), 8).alias("dfdx"), r(slope(3), 8).alias("dfdy"))


@query(f"WITH {TT}, n AS (SELECT unnest([n1, n2, n3]) AS node_id, abs(jac) / 2 AS area FROM shape) SELECT node_id, round(0.8 * sqrt(2) * sqrt(min(area)), 6) AS hmin, round(1.2 * sqrt(2) * sqrt(max(area)), 6) AS hmax FROM n GROUP BY node_id")
def node_hminmax(spark, sf_dir):
    nodes, elems = part_mesh(spark, sf_dir)
    s = mesh.node_sizes(elems, mesh.geometry(mesh.corners(elems, nodes)))
    return s.select("node_id", r(F.col("hmin")).alias("hmin"), r(F.col("hmax")).alias("hmax"))


# -- fields and numbers ----------------------------------------------------------------------
@query(f"WITH {TE}, n AS (SELECT unnest([n1, n2, n3]) AS node_id, size + elem_id % 2 AS v FROM te JOIN tn ON tn.node_id = n1) SELECT node_id, round(avg(v), 6) AS v FROM n GROUP BY node_id")
def elem_to_node(spark, sf_dir):
    nodes, elems = part_mesh(spark, sf_dir)
    field = elems.select("elem_id", F.col("nodes")[0].alias("node_id")).join(nodes, "node_id").select("elem_id", (F.col("size") + F.col("elem_id") % 2).alias("v"))
    return mesh.elements_to_nodes(elems, field, "v").withColumn("v", F.round("v", 6))


@query(f"WITH {TT} SELECT elem_id, round((f1 + f2 + f3) / 3, 6) AS v FROM tt")
def node_to_elem(spark, sf_dir):
    nodes, elems = part_mesh(spark, sf_dir)
    return mesh.nodes_to_elements(elems, nodes.select("node_id", F.col("f").alias("v")), "v").withColumn("v", F.round("v", 6))


@query(f"WITH {SIDES} SELECT p.elem_id, q.elem_id AS neighbour FROM side AS p JOIN side AS q ON p.e = q.e AND p.elem_id <> q.elem_id")
def elem_neighbours(spark, sf_dir):
    return mesh.neighbours(part_mesh(spark, sf_dir)[1])


@query(f"WITH {SIDES}, d AS (SELECT DISTINCT e FROM side), b AS (SELECT e[1] AS node_id, e[2] AS other FROM d UNION ALL SELECT e[2], e[1] FROM d) SELECT node_id, count(*) AS degree, sum(other)::BIGINT AS others FROM b GROUP BY node_id")
def node_graph(spark, sf_dir):
    g = mesh.node_graph(part_mesh(spark, sf_dir)[1])
    return g.select("node_id", "degree", F.aggregate("adjacent", F.lit(0).cast("long"), lambda a, x: a + x).alias("others"))


@query(f"WITH {TE}, m AS (SELECT p_partkey AS node_id, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS n FROM part) SELECT 1000000000 - elem_id AS elem_id, a.n AS n1, b.n AS n2, c.n AS n3 FROM te JOIN m AS a ON a.node_id = n1 JOIN m AS b ON b.node_id = n2 JOIN m AS c ON c.node_id = n3")
def reordered_mesh(spark, sf_dir):
    """Nodes numbered by a field, elements backwards."""
    nodes, elems = part_mesh(spark, sf_dir)
    node_map = fields.renumbered(nodes.select("node_id", "f"), ["f", "node_id"]).select("node_id", "new_id")
    e, _ = mesh.reordered(elems, nodes, node_map, elems.select("elem_id", (1_000_000_000 - F.col("elem_id")).alias("new_id")))
    n = F.col("nodes")
    return e.select("elem_id", n[0].alias("n1"), n[1].alias("n2"), n[2].alias("n3"))


@query("WITH m AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS n FROM part) SELECT n AS k, k AS n FROM m")
def inverse_numbers(spark, sf_dir):
    """The permutation that takes new numbers back to old ones."""
    m = fields.renumbered(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_retailprice"), ["p_retailprice", "k"], into="n")
    return fields.inverse_permutation(m, "k", "n").select("k", "n")


@query(f"""WITH {SIDES}, d AS (SELECT e, count(*) AS n FROM side GROUP BY e), b AS (SELECT e[1] AS node_id, e[2] AS other FROM d UNION ALL SELECT e[2], e[1] FROM d),
rim AS (SELECT DISTINCT unnest(e) AS node_id FROM d WHERE n = 1), s AS (SELECT b.node_id, avg(o.x) AS ax, avg(o.y) AS ay FROM b JOIN tn AS o ON o.node_id = other GROUP BY b.node_id)
SELECT tn.node_id, round(CASE WHEN rim.node_id IS NULL AND ax IS NOT NULL THEN x + 0.5 * (ax - x) ELSE x END, 6) + 0.0 AS x, round(CASE WHEN rim.node_id IS NULL AND ay IS NOT NULL THEN y + 0.5 * (ay - y) ELSE y END, 6) + 0.0 AS y FROM tn LEFT JOIN s USING (node_id) LEFT JOIN rim ON rim.node_id = tn.node_id""")
def smoothed_mesh(spark, sf_dir):
    nodes, elems = part_mesh(spark, sf_dir)
    return mesh.smoothed(nodes, elems, 0.5).select("node_id", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"))


@query(f"""WITH {TE}, k AS (SELECT * FROM te WHERE i % 7 <> 3 AND j % 13 <> 5) SELECT elem_id, min(elem_id) OVER (PARTITION BY (i + 3) // 7, (j + 7) // 13) AS label FROM k""")
def sub_domains(spark, sf_dir):
    """Connected parts of the mesh after every seventh column and every thirteenth row of cells has been left out."""
    return mesh.sub_domains(part_mesh(spark, sf_dir)[1].where("i % 7 <> 3 AND j % 13 <> 5").select("elem_id", "nodes"))


@query(f"""WITH {TE}, s AS (SELECT DISTINCT part, node_id FROM (SELECT j // 2 * 4 + i // 5 AS part, unnest([n1, n2, n3]) AS node_id FROM te)), o AS (SELECT node_id, min(part) AS owner, count(*) AS n FROM s GROUP BY node_id),
c AS (SELECT part, s.node_id, owner, CASE WHEN part <> owner THEN 'ghost' WHEN n > 1 THEN 'shared' ELSE 'inner' END AS class FROM s JOIN o USING (node_id)) SELECT part, node_id, owner, class, row_number() OVER (PARTITION BY part, class ORDER BY node_id) - 1 AS number FROM c""")
def node_owners(spark, sf_dir):
    """Owners, ghosts and numbers of nodes for a mesh dealt into blocks."""
    elems = part_mesh(spark, sf_dir)[1]
    return mesh.node_classes(elems.withColumn("part", F.floor(F.col("j") / 2) * 4 + F.floor(F.col("i") / 5)))


@query(f"""WITH RECURSIVE {SIDES}, d AS (SELECT DISTINCT e FROM side), b AS (SELECT e[1] AS p, e[2] AS q FROM d UNION ALL SELECT e[2], e[1] FROM d),
w AS (SELECT p, q, ln(1.5) * sqrt(pow(f.x - g.x, 2) + pow(f.y - g.y, 2)) AS way FROM b JOIN tn AS f ON f.node_id = p JOIN tn AS g ON g.node_id = q UNION ALL SELECT node_id, node_id, 0 FROM tn),
z AS (SELECT 0 AS k, node_id AS q, size * 1.0::DOUBLE AS h FROM tn UNION ALL SELECT k + 1, w.q, min(h + way) FROM z JOIN w ON w.p = z.q WHERE k < 30 GROUP BY k, w.q) SELECT q AS node_id, round(h, 6) AS size FROM z WHERE k = 30""")
def graded_sizes(spark, sf_dir):
    """Sizes that grow slowly from node to node; the SQL takes thirty rounds over all edges."""
    nodes, elems = part_mesh(spark, sf_dir)
    return mesh.graded(nodes.withColumn("size", F.col("size").cast("double")), elems, "size", 1.5).select("node_id", r(F.col("size")).alias("size"))


@query(f"""WITH {TE}, k AS (SELECT * FROM te WHERE i % 7 <> 3 AND j % 13 <> 5), l AS (SELECT elem_id, min(elem_id) OVER (PARTITION BY (i + 3) // 7, (j + 7) // 13) AS label FROM k) SELECT elem_id, label, row_number() OVER (ORDER BY label, elem_id) - 1 AS new_id FROM l""")
def numbers_by_domain(spark, sf_dir):
    """Elements numbered one connected part after another."""
    return mesh.renumbered_by_domain(part_mesh(spark, sf_dir)[1].where("i % 7 <> 3 AND j % 13 <> 5").select("elem_id", "nodes")).select("elem_id", "label", "new_id")


_POLAR = "6371.0::DOUBLE * (1 + sin(radians(60)))"


@query(f"""WITH {TE}, m AS (SELECT node_id, (x * cos(radians(25)) + y * sin(radians(25))) * 10 + 300 AS x, (y * cos(radians(25)) - x * sin(radians(25))) * 10 + 400 AS y FROM tn),
g AS (SELECT node_id, 90 - 2 * degrees(atan(sqrt(x * x + y * y) / ({_POLAR}))) AS lat, degrees(atan2(x, -y)) - 45 AS lon FROM m),
e AS (SELECT elem_id, (a.lat + b.lat + c.lat) / 3 AS lat, (a.lon + a.lon + (b.lon - a.lon + 900) % 360 - 180 + a.lon + (c.lon - a.lon + 900) % 360 - 180) / 3 AS lon FROM te JOIN g AS a ON a.node_id = n1 JOIN g AS b ON b.node_id = n2 JOIN g AS c ON c.node_id = n3)
SELECT 'node' AS kind, node_id AS id, round(lat, 6) AS lat, round((lon + 900) % 360 - 180, 5) + 0.0 AS lon FROM g UNION ALL SELECT 'elem', elem_id, round(lat, 6), round((lon + 900) % 360 - 180, 5) + 0.0 FROM e""")
def mesh_places(spark, sf_dir):
    """Latitudes and longitudes of the nodes and elements of a mesh, turned and set beside the pole."""
    nodes, elems = part_mesh(spark, sf_dir)
    far = mesh.turned(nodes, 25.0).withColumns({"x": F.col("x") * 10 + 300, "y": F.col("y") * 10 + 400})
    n, e = mesh.geographic(far, elems, "polar_stereographic_sphere", MapSpec(lat0=90.0, lon0=-45.0, lat1=60.0, radius=6371.0))
    both = n.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), "lat", "lon").union(e.select(F.lit("elem"), "elem_id", "lat", "lon"))
    return both.select("kind", "id", r(F.col("lat")).alias("lat"), r(F.col("lon"), 5).alias("lon"))


# -- location --------------------------------------------------------------------------------
def held_sql(points: str, name: str) -> str:
    """CTEs ``name``: rows of ``points`` (key, i, j: a cell near it, px, py) with the highest element that holds each, its weights, by testing the elements around."""
    return f"""{name}_c AS (SELECT p.key, elem_id, n1, n2, n3, ((x2 - px) * (y3 - py) - (x3 - px) * (y2 - py)) / jac AS l1, ((x3 - px) * (y1 - py) - (x1 - px) * (y3 - py)) / jac AS l2 FROM {points} AS p JOIN shape ON shape.i BETWEEN p.i - 2 AND p.i + 2 AND shape.j BETWEEN p.j - 2 AND p.j + 2),
{name}_b AS (SELECT key, max(elem_id) AS elem_id FROM {name}_c WHERE least(l1, l2, 1 - l1 - l2) >= -1e-11 GROUP BY key),
{name} AS (SELECT p.*, c.elem_id, n1, n2, n3, l1, l2, 1 - l1 - l2 AS l3 FROM {points} AS p LEFT JOIN {name}_b AS b USING (key) LEFT JOIN {name}_c AS c ON c.key = p.key AND c.elem_id = b.elem_id)"""


@query(f"""WITH {TT}, g AS (SELECT 4 * node_id + 2 * b + a AS key, i, j, i * 5 + a * 2.5::DOUBLE + 0.3::DOUBLE AS px, j * 5 + b * 2.5::DOUBLE + 0.7::DOUBLE AS py FROM tn, range(2) AS s(a), range(2) AS t(b)), {held_sql('g', 'h')}
SELECT key AS id, CASE WHEN elem_id IS NULL THEN -1e14 ELSE round((f1 + f2 + f3) / 3, 6) END AS v FROM h LEFT JOIN (SELECT elem_id AS e, f1, f2, f3 FROM tt) ON e = elem_id""")
def rasterise_last_wins(spark, sf_dir):
    """Element means on a raster of four points a node."""
    nodes, elems = part_mesh(spark, sf_dir)
    at = mesh.corners(elems, nodes, "f").withColumn("v", (F.col("f1") + F.col("f2") + F.col("f3")) / 3)
    two = lambda n: F.explode(F.array(F.lit(0), F.lit(1))).alias(n)
    g = nodes.select("node_id", "i", "j", two("a")).select("*", two("b"))
    g = g.select((4 * F.col("node_id") + 2 * F.col("b") + F.col("a")).alias("id"), (F.col("i") * 5 + F.col("a") * 2.5 + 0.3).alias("px"), (F.col("j") * 5 + F.col("b") * 2.5 + 0.7).alias("py"))
    return locate.rasterised(g, at, 5.0, "v", -1e14).select("id", r(F.col("v")).alias("v"))


@query(f"""WITH {TT}, d AS (SELECT node_id AS key, i, j, i * 5 + 1.3::DOUBLE AS px, j * 5 + 2.1::DOUBLE AS py FROM tn WHERE size < 30), {held_sql('d', 'h')},
m AS (SELECT key, h.i, h.j, px + 2 * coalesce(l1 * a.u + l2 * b.u + l3 * c.u, 0) AS px, py + 2 * coalesce(l1 * a.v + l2 * b.v + l3 * c.v, 0) AS py FROM h LEFT JOIN tn AS a ON a.node_id = n1 LEFT JOIN tn AS b ON b.node_id = n2 LEFT JOIN tn AS c ON c.node_id = n3), {held_sql('m', 'q')},
s AS (SELECT key, px, py, greatest(least(coalesce(l1 * (a.size % 10) / 6 + l2 * (b.size % 10) / 6 + l3 * (c.size % 10) / 6, 0), 1), 0) AS conc FROM q LEFT JOIN tn AS a ON a.node_id = n1 LEFT JOIN tn AS b ON b.node_id = n2 LEFT JOIN tn AS c ON c.node_id = n3)
SELECT key AS drifter_id, round(px, 6) AS x, round(py, 6) AS y, round(conc, 6) AS conc FROM s WHERE conc > 0.3""")
def drifter_step(spark, sf_dir):
    """Drifters move with the velocity of the mesh where they are, take the concentration of the place they come to, and stay if it is over the limit."""
    nodes, elems = part_mesh(spark, sf_dir)
    at = mesh.corners(elems, nodes.withColumn("conc", F.col("size") % 10 / 6), "u", "v", "conc")
    d = nodes.where("size < 30").select(F.col("node_id").alias("drifter_id"), (F.col("i") * 5 + 1.3).alias("x"), (F.col("j") * 5 + 2.1).alias("y"))
    m = drifters.stepped(d, at, 5.0, 2.0, 0.3)
    return m.select("drifter_id", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"), r(F.col("conc")).alias("conc"))


@query(f"""WITH {TT}, c AS (SELECT c_custkey AS key, c_custkey * 7 % 20 AS i, c_custkey * 3 % (SELECT max(j) + 1 FROM tn) AS j FROM customer), g AS (SELECT key, i, j, i * 5 + 1.7::DOUBLE AS px, j * 5 + 3.1::DOUBLE AS py FROM c), {held_sql('g', 'h')}
SELECT key AS c_custkey, h.elem_id, round(coalesce(l1 * a.f + l2 * b.f + l3 * c.f, -1), 6) AS f, round(coalesce(l1 * a.u + l2 * b.u + l3 * c.u, -1), 6) + 0.0 AS u FROM h LEFT JOIN tn AS a ON a.node_id = n1 LEFT JOIN tn AS b ON b.node_id = n2 LEFT JOIN tn AS c ON c.node_id = n3""")
def interpolated_places(spark, sf_dir):
    """Two variables in one location of customers on the mesh."""
    nodes, elems = part_mesh(spark, sf_dir)
    k, rows = F.col("c_custkey"), nodes.agg(F.max("j") + 1).first()[0]
    g = table(spark, sf_dir, "customer").select(k, (k * 7 % 20 * 5 + 1.7).alias("px"), (k * 3 % rows * 5 + 3.1).alias("py"))
    held = locate.in_triangles(g, mesh.corners(elems, nodes, "f", "u"), 5.0, [f"{c}{n}" for c in "fu" for n in (1, 2, 3)])
    out = locate.interpolated(held, ["f", "u"], -1.0)
    return out.select("c_custkey", "elem_id", r(F.col("f")).alias("f"), r(F.col("u")).alias("u"))


# -- remapping -------------------------------------------------------------------------------
def clipped_sql(pairs: str, name: str, clip: list[tuple[str, str, str, str]]) -> str:
    """CTEs that cut the polygon p (a list of x and y) of each row of ``pairs`` by one half-plane after another, left of (ax, ay) to (bx, by); ``name`` has its area as w."""
    out, last = [], pairs
    for k, (ax, ay, bx, by) in enumerate(clip):
        side = lambda q: f"(({bx}) - ({ax})) * ({q}.y - ({ay})) - (({by}) - ({ay})) * ({q}.x - ({ax}))"
        s, t = side("p[k]"), side("p[k % len(p) + 1]")
        cut = f"CASE WHEN ({s}) * ({t}) < 0 THEN [{{'x': p[k].x + (p[k % len(p) + 1].x - p[k].x) * ({s}) / (({s}) - ({t})), 'y': p[k].y + (p[k % len(p) + 1].y - p[k].y) * ({s}) / (({s}) - ({t}))}}] ELSE list_filter([p[k]], lambda q: false) END"
        out.append(f"{name}{k} AS (SELECT * REPLACE (flatten(list_transform(range(1, len(p) + 1), lambda k: list_concat(list_filter([p[k]], lambda q: ({side('q')}) >= 0), {cut}))) AS p) FROM {last})")
        last = f"{name}{k}"
    area = "abs(coalesce(list_sum(list_transform(range(1, len(p) + 1), lambda k: p[k].x * p[k % len(p) + 1].y - p[k % len(p) + 1].x * p[k].y)), 0)) / 2"
    return ", ".join(out) + f", {name} AS (SELECT * EXCLUDE (p), {area} AS w FROM {last})"


def raster(spark, sf_dir) -> DataFrame:
    """Cells of ten by ten, one for each square of four nodes."""
    ci, cj = F.floor(F.col("i") / 2), F.floor(F.col("j") / 2)
    c = part_nodes(spark, sf_dir).groupBy(ci.alias("ci"), cj.alias("cj")).agg(F.max("f").alias("f"))
    return c.select((F.col("cj") * 10 + F.col("ci")).alias("cell_id"), (F.col("ci") * 10 - 1.0).alias("x0"), (F.col("ci") * 10 + 9.0).alias("x1"), (F.col("cj") * 10 - 1.0).alias("y0"), (F.col("cj") * 10 + 9.0).alias("y1"), "f")


_TRI = "[{{'x': {0}x1, 'y': {0}y1}}, {{'x': {0}x2, 'y': {0}y2}}, {{'x': {0}x3, 'y': {0}y3}}]"
OVER = f"""{TT}, raster AS (SELECT i // 2 AS ci, j // 2 AS cj, max(f) AS f FROM tn GROUP BY ALL),
pairs AS (SELECT cj * 10 + ci AS cell_id, elem_id, f, (f1 + f2 + f3) / 3 AS v, ci * 10 - 1.0::DOUBLE AS gx0, ci * 10 + 9.0::DOUBLE AS gx1, cj * 10 - 1.0::DOUBLE AS gy0, cj * 10 + 9.0::DOUBLE AS gy1, {_TRI.format('')} AS p FROM raster JOIN shape ON i BETWEEN 2 * ci - 2 AND 2 * ci + 2 AND j BETWEEN 2 * cj - 2 AND 2 * cj + 2),
{clipped_sql('pairs', 'o', [('gx0', 'gy0', 'gx1', 'gy0'), ('gx1', 'gy0', 'gx1', 'gy1'), ('gx1', 'gy1', 'gx0', 'gy1'), ('gx0', 'gy1', 'gx0', 'gy0')])}"""


def raster_weights(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, elems = part_mesh(spark, sf_dir)
    cells, at = raster(spark, sf_dir), mesh.corners(elems, nodes, "f")
    field = at.select("elem_id", ((F.col("f1") + F.col("f2") + F.col("f3")) / 3).alias("v"))
    return remap.triangle_overlaps(cells, at, 5.0), field, cells.select("cell_id", F.col("f").alias("v"))


@query(f"WITH {OVER} SELECT cell_id, elem_id, round(w, 6) AS w FROM o WHERE w > 1e-6")
def triangle_overlap_weights(spark, sf_dir):
    """Overlaps of raster cells with the triangles of the mesh; the SQL cuts each triangle by the four sides."""
    return raster_weights(spark, sf_dir)[0].where("w > 1e-6").withColumn("w", F.round("w", 6))


@query(f"WITH {OVER} SELECT cell_id, round(sum(w * v) / 100, 5) AS v, round(sum(w) / 100, 6) AS covered FROM o WHERE w > 0 GROUP BY cell_id")
def triangles_to_grid(spark, sf_dir):
    w, field, _ = raster_weights(spark, sf_dir)
    return remap.mesh_to_grid(w, field, 100.0, "v").select("cell_id", F.round("v", 5).alias("v"), F.round("covered", 6).alias("covered"))


@query(f"WITH {OVER} SELECT elem_id, round(sum(w * f) / sum(w), 5) AS v FROM o WHERE w > 1e-9 GROUP BY elem_id")
def grid_to_triangles(spark, sf_dir):
    w, _, cells = raster_weights(spark, sf_dir)
    return remap.grid_to_mesh(w.where("w > 1e-9"), cells, "v").withColumn("v", F.round("v", 5))


BETWEEN = f"""{TT}, far AS (SELECT * REPLACE (CASE WHEN node_id % 3 > 0 THEN x + 0.5 * u ELSE x END AS x, CASE WHEN node_id % 3 > 0 THEN y + 0.5 * v ELSE y END AS y) FROM tn), new AS ({_AT.format('far')}),
pairs AS (SELECT new.elem_id, shape.elem_id AS source, (shape.f1 + shape.f2 + shape.f3) / 3 AS v, shape.x1 AS ox1, shape.y1 AS oy1, shape.x2 AS ox2, shape.y2 AS oy2, shape.x3 AS ox3, shape.y3 AS oy3, {_TRI.format('new.')} AS p FROM new JOIN shape ON shape.i BETWEEN new.i - 1 AND new.i + 1 AND shape.j BETWEEN new.j - 1 AND new.j + 1),
{clipped_sql('pairs', 'o', [('ox1', 'oy1', 'ox2', 'oy2'), ('ox2', 'oy2', 'ox3', 'oy3'), ('ox3', 'oy3', 'ox1', 'oy1')])}"""


@query(f"WITH {BETWEEN} SELECT elem_id, round(sum(w * v) / sum(w), 5) AS v, round(sum(w), 6) AS covered FROM o WHERE w > 1e-9 GROUP BY elem_id")
def remap_mesh_to_mesh(spark, sf_dir):
    """A field of elements on a mesh whose nodes have moved, two of three; the SQL cuts each new triangle by the sides of old ones."""
    nodes, elems = part_mesh(spark, sf_dir)
    stays = F.col("node_id") % 3 == 0
    moved = mesh.displaced(nodes.withColumns({c: F.when(stays, 0.0).otherwise(F.col(c)) for c in "uv"}), "u", "v", 0.5)
    old = mesh.corners(elems, nodes, "f")
    w = written(remap.mesh_overlaps(old, mesh.corners(elems, moved), 5.0).where("w > 1e-9"), "overlaps")  # read twice
    field = old.select("elem_id", ((F.col("f1") + F.col("f2") + F.col("f3")) / 3).alias("v"))
    covered = w.groupBy("elem_id").agg(F.round(F.sum("w"), 6).alias("covered"))
    return remap.mesh_to_mesh(w, field, "v").join(dealt(covered), "elem_id").select("elem_id", F.round("v", 5).alias("v"), "covered")


# -- advection -------------------------------------------------------------------------------
FLOW = f"""{TT}, flow AS (SELECT *, i = 0 OR j = 0 AS closed FROM tn), fl AS (SELECT elem_id, abs(jac) / 2 AS area, unnest([[n1, n2], [n2, n3], [n3, n1]]) AS e FROM shape),
fc AS (SELECT elem_id, area, least(e[1], e[2]) AS a, greatest(e[1], e[2]) AS b, (q.y - p.y) * (p.u + q.u) / 2 - (q.x - p.x) * (p.v + q.v) / 2 AS flux, p.closed AND q.closed AS closed FROM fl JOIN flow AS p ON p.node_id = e[1] JOIN flow AS q ON q.node_id = e[2]),
face AS (SELECT f.*, g.elem_id AS neighbour, g.area AS far FROM fc AS f LEFT JOIN fc AS g ON g.a = f.a AND g.b = f.b AND g.elem_id <> f.elem_id)"""
_MOVE = """CASE WHEN flux > 0 THEN least(flux, face.area / {dt} / 3) * o.h WHEN neighbour IS NOT NULL THEN -least(-flux, far / {dt} / 3) * t.h WHEN closed THEN 0 ELSE flux * 0.25 END"""


def flow_sql(new: str, old: str, dt: float) -> str:
    return f"""{new} AS (SELECT o.elem_id, any_value(o.h) - {dt} * sum({_MOVE.format(dt=dt)}) / any_value(face.area) AS h FROM face JOIN {old} AS o ON o.elem_id = face.elem_id LEFT JOIN {old} AS t ON t.elem_id = neighbour GROUP BY o.elem_id)"""


def flow_faces(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, elems = part_mesh(spark, sf_dir)
    at = mesh.corners(elems, nodes)
    area = mesh.geometry(at).select("elem_id", "area")
    return elems, advection.oriented_faces(elems, nodes.withColumn("closed", (F.col("i") == 0) | (F.col("j") == 0)), "u", "v", "closed"), area


@query(f"WITH {FLOW} SELECT elem_id, neighbour, round(flux, 6) + 0.0 AS flux, closed FROM face")
def face_fluxes(spark, sf_dir):
    """Volumes through the sides of elements, from nodal velocities."""
    return flow_faces(spark, sf_dir)[1].select("elem_id", "neighbour", r(F.col("flux")).alias("flux"), "closed")


@query(f"WITH {FLOW}, h0 AS (SELECT elem_id, size / 10.0::DOUBLE AS h FROM te JOIN tn ON node_id = n1), {flow_sql('h1', 'h0', 2.0)}, {flow_sql('h2', 'h1', 2.0)} SELECT elem_id, round(h, 6) + 0.0 AS h FROM h2")
def upwind_advection(spark, sf_dir):
    """Two steps, long enough for limits, on a mesh with two closed sides and two open ones."""
    elems, faces, area = flow_faces(spark, sf_dir)
    f = elems.select("elem_id", F.col("nodes")[0].alias("node_id")).join(dealt(part_nodes(spark, sf_dir)), "node_id").select("elem_id", (F.col("size") / 10).alias("h"))
    for _ in range(2):
        f = advection.upwind_step(f, faces, area, "h", 2.0, incoming=0.25)
    return f.select("elem_id", r(F.col("h")).alias("h"))


@query(f"""WITH {FLOW}, h AS (SELECT elem_id, n, (size * (n + 1)) % 5 * 1.0::DOUBLE AS h FROM te JOIN tn ON node_id = n1, range(4) AS t(n)),
way AS (SELECT * REPLACE (flux * (n + 1) / 4 AS flux), n FROM face, range(4) AS t(n)),
net AS (SELECT o.elem_id, o.n, o.h - 1.0 * sum({_MOVE.format(dt=1.0).replace('face.', 'way.')}) / any_value(way.area) AS h FROM way JOIN h AS o ON o.elem_id = way.elem_id AND o.n = way.n LEFT JOIN h AS t ON t.elem_id = neighbour AND t.n = o.n GROUP BY o.elem_id, o.n, o.h)
SELECT elem_id, n, round(h, 6) + 0.0 AS h FROM net""")
def advected_directions(spark, sf_dir):
    """Every direction of a spectrum moved with a speed of its own."""
    elems, faces, area = flow_faces(spark, sf_dir)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("n")
    own = faces.select("*", every).withColumn("flux", F.col("flux") * (F.col("n") + 1) / 4)
    h = elems.select("elem_id", F.col("nodes")[0].alias("node_id")).join(dealt(part_nodes(spark, sf_dir)), "node_id").select("elem_id", "size", every)
    h = h.select("elem_id", "n", (F.col("size") * (F.col("n") + 1) % 5 * 1.0).alias("h"))
    return advection.upwind_step(h, own, area, "h", 1.0, by=["n"], incoming=0.25).select("elem_id", "n", r(F.col("h")).alias("h"))


# -- random forcing --------------------------------------------------------------------------
@query(f"""WITH {TN} SELECT g.i, g.j, round(coalesce((g.f - w.f) / 10, 0), 6) + 0.0 AS gx, round(coalesce((g.f - s.f) / 10, 0), 6) + 0.0 AS gy
FROM tn AS g LEFT JOIN tn AS w ON w.i = g.i - 1 AND w.j = g.j AND g.j > 0 LEFT JOIN tn AS s ON s.i = g.i AND s.j = g.j - 1 AND g.i > 0""")
def stencil_gradient(spark, sf_dir):
    out = noise.pressure_gradient(part_nodes(spark, sf_dir).select("i", "j", F.col("f").alias("p")), "p", 10.0)
    return out.select("i", "j", r(F.col("gx")).alias("gx"), r(F.col("gy")).alias("gy"))


_WAVES = "list_sum(list_transform(range(-7, 9), lambda l: exp(-2 * pow(2 * pi() * l / 16 / ((lo + hi) / 2), 2)) * {}))"


@query(f"""WITH RECURSIVE cut AS (SELECT 0 AS k, 1e-6::DOUBLE AS lo, 64.0::DOUBLE AS hi UNION ALL SELECT k + 1, CASE WHEN up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END
FROM (SELECT *, {_WAVES.format('cos(2 * pi() * l / 16 * 3)')} / {_WAVES.format('1')} > exp(-1) AS up FROM cut WHERE k < 100)), s AS (SELECT lo AS s, list_sum(list_transform(range(-7, 9), lambda l: exp(-2 * pow(2 * pi() * l / 16 / lo, 2)))) AS total FROM cut WHERE k = 100),
ph AS (SELECT o_orderkey // 144 AS member, o_orderkey // 16 % 9 AS l, o_orderkey % 16 AS p, (round(o_totalprice * 100)::BIGINT % 10007) / 10007.0::DOUBLE AS phi FROM orders),
wv AS (SELECT member, l, p, phi, CASE WHEN l IN (0, 8) THEN 1 ELSE 2 END * exp(-(pow(2 * pi() * l / 16, 2) + pow(2 * pi() * least(p, 16 - p) / 16, 2)) / (s * s)) / total AS amp FROM ph, s)
SELECT member, i, j, round(sum(amp * cos(2 * pi() * (l * i / 16.0::DOUBLE + p * j / 16.0::DOUBLE + phi))), 6) + 0.0 AS value FROM wv, range(16) AS a(i), range(16) AS b(j) GROUP BY ALL""")
def gaussian_field(spark, sf_dir):
    """Fields of 16 x 16 cells whose phases are the orders' prices, 144 orders a field; the SQL sums all waves at each place."""
    k = F.col("o_orderkey")
    phi = F.round(F.col("o_totalprice") * 100).cast("long") % 10007 / 10007
    ph = table(spark, sf_dir, "orders").select(F.floor(k / 144).alias("member"), (F.floor(k / 16) % 9).alias("l"), (k % 16).alias("p"), phi.alias("phi"))
    return noise.random_fields(ph, ["member"], (16, 16), 3.0).select("member", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r(F.col("value")).alias("value"))


# -- wave medium -----------------------------------------------------------------------------
def _halving(name: str, source: str, plate: int, lift: str, deep: str, out: str) -> str:
    """CTE by halving: the positive root of (plate k^4 + lift) k tanh(k deep) = 1, of a left side that rises where it is positive."""
    mid = f"({plate} * pow((lo + hi) / 2, 4) + {lift}) * ((lo + hi) / 2) * (1 - 2 / (exp(least(2 * ((lo + hi) / 2) * {deep}, 700)) + 1)) > 1"
    return f"""{name}_r AS (SELECT 0 AS k, *, 0.0::DOUBLE AS lo, 100.0::DOUBLE AS hi FROM {source} UNION ALL SELECT k + 1, * EXCLUDE (k, lo, hi), CASE WHEN {mid} THEN lo ELSE (lo + hi) / 2 END, CASE WHEN {mid} THEN (lo + hi) / 2 ELSE hi END FROM {name}_r WHERE k < 80),
{name} AS (SELECT * EXCLUDE (k, lo, hi), (lo + hi) / 2 AS {out} FROM {name}_r WHERE k = 80)"""


#: A table of polynomials for the query, by regimes of squared frequency and thickness (made up: the operator takes any).
PERIODS, THICKNESSES = ([1e-6, 0.3, 1.5, 50.0], [True, True, False]), ([0.01, 0.2, 0.4], [True, False])
POLYNOMIALS = [(p, t, "log" if p < 2 else "plain", [[-2.0 + 0.5 * p, 0.3 - 0.1 * t, 0.05], [0.4, -0.2, 0.01 * (p + 1)]] if p < 2 else [[0.8, 0.1 * t], [0.2, 0.05], [-0.03, 0.02]]) for p in range(3) for t in range(2)]
_D = 5.49e9 / 12 / (1 - 0.3**2)


def _place_sql(value: str, edges, logs, number: str, at: str) -> str:
    x = f"greatest({edges[0]!r}, least({edges[-1]!r}, {value}))"
    n = "CASE " + " ".join(f"WHEN {x} >= {edges[k]!r} THEN {k}" for k in range(len(logs) - 1, 0, -1)) + " ELSE 0 END"
    place = lambda k: f"2 * (ln({x}) - ln({edges[k]!r})) / (ln({edges[k + 1]!r}) - ln({edges[k]!r})) - 1" if logs[k] else f"2 * ({x} - {edges[k]!r}) / ({edges[k + 1]!r} - {edges[k]!r}) - 1"
    return f"{n} AS {number}, CASE {n} " + " ".join(f"WHEN {k} THEN {place(k)}" for k in range(len(logs))) + f" END AS {at}"


_T = {0: "1", 1: "{x}", 2: "(2 * {x} * {x} - 1)"}
_SUM = "CASE " + " ".join(f"WHEN pr = {p} AND tr = {t} THEN " + " + ".join(f"({c!r} * {_T[m].format(x='pa')} * {_T[n].format(x='ta')})" for m, row in enumerate(cs) for n, c in enumerate(row)) for p, t, _, cs in POLYNOMIALS) + " END"


@query(f"""WITH RECURSIVE a AS (SELECT s_suppkey AS elem_id, f, 2 * pi() * (0.05 + 0.03 * f) AS om, 0.4 + s_suppkey % 8 * 0.3::DOUBLE AS h FROM supplier, range(6) AS t(f)), b AS (SELECT *, pow({_D!r} * pow(h, 3) / 1025 / (om * om), 0.2) AS un FROM a),
c AS (SELECT *, om * om / 9.81 * un AS al, h / un AS hn, 922.5 / 1025 * h / un AS dr FROM b), {_halving('ice', 'c', 1, '(1 / al - dr)', '4.0', 'ki')}, {_halving('sea', 'ice', 0, '(1 / al)', '(4.0 + dr)', 'kw')},
g AS (SELECT *, pow(ki, 4) + 1 / al - dr AS wi, 4.0 * (pow((pow(ki, 4) + 1 / al - dr) * ki, 2) - 1) + 5 * pow(ki, 4) + 1 / al - dr AS ri, (4.0 + dr) * (pow(kw / al, 2) - 1) + 1 / al AS rw FROM sea),
q AS (SELECT *, (kw / al / al / rw) / (wi * wi * ki / ri) AS adm, {_place_sql('al', *PERIODS, 'pr', 'pa')}, {_place_sql('hn', *THICKNESSES, 'tr', 'ta')} FROM g),
z AS (SELECT *, CASE WHEN pr < 2 THEN exp({_SUM}) ELSE {_SUM} END AS ac FROM q)
SELECT elem_id, f, round(2 * pi() / (ki / un), 5) AS wavelength, round(ki / ri * 13 / (1025 * om * un) / un, 12) AS damping, round(adm, 6) AS admittance, round(ac, 6) AS attenuation, round(ki * sqrt(exp(-ac / 2) / adm) / kw, 6) AS amplitude_ratio FROM z""")
def wave_medium(spark, sf_dir):
    """Wavelength, damping, admittance, attenuation and amplitude ratio by element and frequency; the SQL finds the roots by halving."""
    k = F.col("s_suppkey")
    ice = table(spark, sf_dir, "supplier").select(k.alias("elem_id"), (0.4 + k % 8 * 0.3).alias("thickness"))
    coefficients = spark.createDataFrame(POLYNOMIALS, "period_regime int, thickness_regime int, kind string, c array<array<double>>")
    out = waves.attenuation(waves.wave_medium(ice, [0.05 + 0.03 * f for f in range(6)]), coefficients, PERIODS, THICKNESSES)
    return out.select("elem_id", F.col("f").cast("long").alias("f"), r(2 * math.pi / F.col("k_ice"), 5).alias("wavelength"), r(F.col("damping"), 12).alias("damping"), *[r(F.col(c)).alias(c) for c in ("admittance", "attenuation", "amplitude_ratio")])


@query("""WITH sp AS (SELECT s_suppkey AS elem_id, f, n, n * 45.0::DOUBLE AS dir, pi() / 4 AS wd, (1 + (s_suppkey * 7 + f * 3 + n * 5) % 11) / 10.0::DOUBLE AS s, s_suppkey % 3 > 0 AS ice, 20 + s_suppkey % 13 * 20.0::DOUBLE AS size, 0.001::DOUBLE * (1 + f) AS att, 0.0002::DOUBLE * (1 + f) AS damp, 8.0::DOUBLE - f AS cg FROM supplier, range(5) AS a(f), range(8) AS b(n)),
q AS (SELECT *, CASE WHEN size < 200 THEN att ELSE 0 END AS qs, CASE WHEN size < 200 THEN damp ELSE att + damp END AS qa FROM sp), t AS (SELECT elem_id, f, sum(CASE WHEN ice THEN s * wd * cg * (att + damp) * cos(-radians(90 + dir)) ELSE 0 END) AS tx, sum(CASE WHEN ice THEN s * wd * cg * (att + damp) * sin(-radians(90 + dir)) ELSE 0 END) AS ty, avg(s) AS m FROM q GROUP BY elem_id, f)
SELECT elem_id, f, n, round(CASE WHEN ice THEN m * exp(-qa * cg * 60) + (s - m) * exp(-(qa + qs) * cg * 60) ELSE s END, 6) AS s, round(tx, 8) + 0.0 AS tau_x, round(ty, 8) + 0.0 AS tau_y FROM q JOIN t USING (elem_id, f)""")
def pack_scattering(spark, sf_dir):
    """Scattering by floe size: small floes scatter, pack ice takes the energy up; with the stress on the ice."""
    f, k = F.col("f"), F.col("elem_id")
    spec = waves.by_floe_size(spectra(spark, sf_dir).withColumns({"size": 20 + k % 13 * 20.0, "attenuation": 0.001 * (1 + f), "damping": 0.0002 * (1 + f)}), F.col("size"), 200.0)
    tau = waves.scattering_stress(spec, "s", "wd", "dir", ["elem_id", "f"]).select("elem_id", "f", r(F.col("tau_x"), 8).alias("tau_x"), r(F.col("tau_y"), 8).alias("tau_y"))
    return waves.scattered(spec, "s", 60.0, ["elem_id", "f"]).select("elem_id", "f", "n", r(F.col("s")).alias("s")).join(tau, ["elem_id", "f"])


@query("""WITH a AS (SELECT s_suppkey AS elem_id, 1 + s_suppkey % 7 * 0.5::DOUBLE AS hs, 5 + s_suppkey % 11 * 1.0::DOUBLE AS tp, s_suppkey % 12 * 30.0::DOUBLE AS d FROM supplier), b AS (SELECT *, 2 * pi() * (0.05 + 0.02 * f) AS o FROM a, range(5) AS t(f)),
w AS (SELECT *, 2 * pi() * 5 / 16.0::DOUBLE * hs * hs * pow(2 * pi() / tp, 4) * pow(o, -5) * exp(-1.25 * pow(2 * pi() / tp / o, 4)) AS e FROM b), c AS (SELECT *, greatest(n * 22.5 - 11.25 - d - turn * 360, -90) AS lo, least(n * 22.5 + 11.25 - d - turn * 360, 90) AS hi FROM w, range(16) AS u(n), range(-2, 3) AS v(turn))
SELECT elem_id, f, n, round(any_value(e) * sum(CASE WHEN hi > lo THEN (radians(hi) - radians(lo) + (sin(2 * radians(hi)) - sin(2 * radians(lo))) / 2) / pi() ELSE 0.0 END) / radians(22.5), 6) + 0.0 AS s FROM c GROUP BY elem_id, f, n""")
def incident_spectrum(spark, sf_dir):
    """Spectra of seas by frequency and direction."""
    k = F.col("s_suppkey")
    seas = table(spark, sf_dir, "supplier").select(k.alias("elem_id"), (1 + k % 7 * 0.5).alias("hs"), (5 + k % 11 * 1.0).alias("tp"), (k % 12 * 30.0).alias("mwd"))
    out = waves.incident(seas, [0.05 + 0.02 * f for f in range(5)], 16)
    return out.select("elem_id", F.col("f").cast("long").alias("f"), F.col("n").cast("long").alias("n"), r(F.col("s")).alias("s"))
