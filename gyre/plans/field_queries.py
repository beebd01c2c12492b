"""Queries of grids, remapping between meshes, places beyond a mesh, kinds of forcing and wave spectra; registered beside those of ``queries``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gyre.functions import geodesy, geometry, spectral
from gyre.operators import asof, grids, locate, mesh, noise, waves

from .queries import KEY, LOCATED_SQL, NODES_SQL, NPS, PLACES, POINTS, RHO, located, places, points, query, r, table, the_mesh

LAT, LON = "(30 + s_suppkey * 59.5 / 1000)", "(n_nationkey * 14.4 - 180)"


def long(k: int):
    return F.lit(k).cast("long")


# -- grids -----------------------------------------------------------------------------------
def geographic(spark, sf_dir):
    """A grid of a row for each supplier and a column for each nation."""
    lats = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("j"), (30 + F.col("s_suppkey") * 59.5 / 1000).alias("lat"))
    lons = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("i"), (F.col("n_nationkey") * 14.4 - 180).alias("lon"))
    return grids.from_axes(lats, lons)


GEOGRAPHIC = f"SELECT n_nationkey::BIGINT AS i, s_suppkey AS j, {LAT}::DOUBLE AS lat, {LON}::DOUBLE AS lon FROM supplier, nation"


@query(f"SELECT i, j, round(lat, 6) AS lat, round(lon, 6) AS lon, round({RHO} * sin(radians(lon + 45)), 3) + 0.0 AS x, round(-{RHO} * cos(radians(lon + 45)), 3) + 0.0 AS y FROM ({GEOGRAPHIC})")
def grid_lattice(spark, sf_dir):
    g = grids.projected(geographic(spark, sf_dir), "polar_stereographic", NPS)
    return g.select("i", "j", r(F.col("lat")).alias("lat"), r(F.col("lon")).alias("lon"), r(F.col("x"), 3).alias("x"), r(F.col("y"), 3).alias("y"))


@query(f"""WITH g AS ({GEOGRAPHIC}) SELECT 'x' AS axis, i AS k, round({RHO} * sin(radians(lon + 45)), 3) + 0.0 AS place FROM g WHERE j = (SELECT min(j) FROM g)
UNION ALL SELECT 'y', j, round(-{RHO} * cos(radians(lon + 45)), 3) + 0.0 FROM g WHERE i = 0""")
def grid_axes(spark, sf_dir):
    g = geographic(spark, sf_dir)
    first = table(spark, sf_dir, "supplier").agg(F.min("s_suppkey")).first()[0]
    x, y = grids.axes(g.withColumn("j", F.col("j") - first), "polar_stereographic", NPS)
    rows = x.select(F.lit("x").alias("axis"), F.col("i").alias("k"), r(F.col("x"), 3).alias("place"))
    return rows.union(y.select(F.lit("y"), F.col("j") + first, r(F.col("y"), 3)))


@query(f"WITH g AS ({GEOGRAPHIC}), e AS (SELECT lon FROM g WHERE i IN (SELECT min(i) FROM g UNION ALL SELECT max(i) FROM g)) SELECT round(min(lon), 6) AS least, round(max(lon), 6) AS most, round(min(lon), 6) AS cut FROM e")
def grid_lon_range(spark, sf_dir):
    return grids.lon_range(geographic(spark, sf_dir)).select(r(F.col("least")).alias("least"), r(F.col("most")).alias("most"), r(F.col("cut")).alias("cut"))


_K = 6371.0 * (1 + math.sin(math.radians(60)))


@query(f"""WITH n AS (SELECT count(*) AS n FROM supplier), g AS (SELECT j AS row, i AS col, (i - 20) * 25.0::DOUBLE + 3 AS x, (n // 2 - j) * 25.0::DOUBLE + 7 AS y FROM n, range(40) AS a(i), range(1000000) AS b(j) WHERE j < n)
SELECT row, col, round(90 - 2 * degrees(atan(sqrt(x * x + y * y) / {_K!r})), 6) AS lat, round((degrees(atan2(x, -y)) - 45 + 540) % 360 - 180, 6) + 0.0 AS lon FROM g""")
def grid_cell_places(spark, sf_dir):
    """Latitude and longitude of every cell of a map grid."""
    n = table(spark, sf_dir, "supplier").count()
    m = geodesy.MapSpec(lat0=90.0, lon0=-45.0, lat1=60.0, radius=6371.0)
    out = grids.cell_places(spark, n, 40, (20 - 3 / 25, n // 2 + 7 / 25), 1 / 25, "polar_stereographic_sphere", m)
    return out.select("row", "col", r(F.col("lat")).alias("lat"), r(F.col("lon")).alias("lon"))


@query("""WITH n AS (SELECT count(*) AS n FROM supplier), g AS (SELECT j * 30 + i AS id, i, j FROM n, range(30) AS a(i), range(1000000) AS b(j) WHERE j < n)
SELECT id, 5 + i * 2.0::DOUBLE AS qx, -3 + j * 0.5::DOUBLE AS qy, 6 + i * 2.0::DOUBLE AS px, -2.75 + j * 0.5::DOUBLE AS py FROM g""")
def wave_lattice(spark, sf_dir):
    return grids.regular(spark, 30, table(spark, sf_dir, "supplier").count(), (5.0, -3.0), (2.0, 0.5)).select("id", "qx", "qy", "px", "py")


@query(f"WITH g AS ({GEOGRAPHIC}), c AS (SELECT i, j, lon FROM g UNION ALL SELECT i + 25, j, lon + 360 FROM g WHERE i = 0) SELECT a.i, a.j, round((a.lon + b.lon) / 2, 6) + 0.0 AS middle FROM c AS a JOIN c AS b ON a.j = b.j AND b.i = a.i + 1")
def cyclic_column(spark, sf_dir):
    """Cell middles around a circle of latitude, the one across the seam too."""
    g = grids.cyclic(geographic(spark, sf_dir).select("i", "j", "lon"), 25, "lon")
    right = g.select((F.col("i") - 1).alias("i"), "j", F.col("lon").alias("right"))
    return g.join(right, ["i", "j"]).select("i", "j", r((F.col("lon") + F.col("right")) / 2).alias("middle"))


@query("""WITH e AS (SELECT event_id % 24 AS i, event_id // 24 % 20 AS j, event_type AS var, value AS v, event_id FROM events), m AS (SELECT var, avg(v) AS m FROM e WHERE j = 1 GROUP BY var)
SELECT event_id, round(CASE WHEN j = 0 THEN m ELSE v END, 6) + 0.0 AS v FROM e LEFT JOIN m ON e.var = m.var""")
def north_pole_fill(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 24).alias("i"), (F.floor(F.col("event_id") / 24) % 20).alias("j"), F.col("event_type").alias("var"), F.col("value").alias("v"), "event_id")
    return grids.pole_filled(e, 0, 1, "v", ["var"]).select("event_id", r(F.col("v")).alias("v"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey BETWEEN 3 AND 9 AND l_linenumber = (SELECT max(l_linenumber) FROM lineitem) AND l_quantity = 7")
def hyperslab(spark, sf_dir):
    """A window of one dimension, the last member of another, one index of a third."""
    return grids.hyperslab(table(spark, sf_dir, "lineitem"), {"l_suppkey": (3, 7)}, {"l_linenumber": "last", "l_quantity": 7}).select(*KEY)


@query("SELECT DISTINCT s_suppkey * 25 + n_nationkey AS drifter_id, round((30 + s_suppkey * 59.5 / 1000)::DOUBLE, 6) AS lat, round((n_nationkey * 14.4 - 180)::DOUBLE, 6) AS lon FROM supplier, nation")
def drifters_from_grid(spark, sf_dir):
    return grids.drifters_of(geographic(spark, sf_dir), 25).select("drifter_id", r(F.col("lat")).alias("lat"), r(F.col("lon")).alias("lon"))


# -- meshes ----------------------------------------------------------------------------------
def beyond(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", (F.col("c_custkey") * 17 % 1600 / 10.0 - 30).alias("px"), (F.col("c_custkey") * 29 % 1600 / 10.0 - 30).alias("py")).where("px < 0 OR px > 100 OR py < 0 OR py > 100")


BEYOND = "SELECT * FROM (SELECT c_custkey, c_custkey * 17 % 1600 / 10.0::DOUBLE - 30 AS px, c_custkey * 29 % 1600 / 10.0::DOUBLE - 30 AS py FROM customer) WHERE px < 0 OR px > 100 OR py < 0 OR py > 100"


@query(f"""WITH {NODES_SQL}, b AS ({BEYOND}), n AS (SELECT node_id, x, y, x * 0.5 + y * 0.25 + node_id % 7 AS f FROM nodes),
e AS (SELECT p.node_id AS a, q.node_id AS b, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2, p.f AS f1, q.f AS f2 FROM n AS p JOIN n AS q ON p.node_id < q.node_id AND (p.y = q.y AND p.y IN (0, 100) AND q.x = p.x + 5 OR p.x = q.x AND p.x IN (0, 100) AND q.y = p.y + 5)),
t AS (SELECT c_custkey, px, py, e.*, greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / 25)) AS t FROM b, e),
m AS (SELECT c_custkey, arg_min(f1 + t * (f2 - f1), {{'d': round(pow(px - x1 - t * (x2 - x1), 2) + pow(py - y1 - t * (y2 - y1), 2), 8), 'a': a, 'b': b}}) AS f FROM t GROUP BY c_custkey) SELECT c_custkey, round(f, 6) AS f FROM m""")
def outside_by_edge(spark, sf_dir):
    """Points beyond the mesh take their value from the nearest boundary edge."""
    nodes, elems = the_mesh(spark)
    out = locate.extrapolated(beyond(spark, sf_dir), mesh.boundary_edges(elems, nodes), nodes, ["c_custkey"], 5.0, "f")
    return out.select("c_custkey", r(F.col("f")).alias("f"))


@query(f"WITH {NODES_SQL}, b AS ({BEYOND}) SELECT c_custkey, EXISTS (SELECT 1 FROM nodes WHERE pow(px - x, 2) + pow(py - y, 2) <= 144) AS close FROM b")
def too_close(spark, sf_dir):
    nodes, _ = the_mesh(spark)
    return locate.too_close(beyond(spark, sf_dir), nodes, 12.0).select("c_custkey", "close")


@query(f"""WITH {LOCATED_SQL}, w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dx, dy, a FROM q), parts AS (SELECT *, unnest(CASE WHEN dy >= dx THEN [{{'node_id': a, 'w': 1 - dy / 50.0::DOUBLE}}, {{'node_id': a + 22, 'w': dx / 50.0::DOUBLE}}, {{'node_id': a + 21, 'w': (dy - dx) / 50.0::DOUBLE}}]
ELSE [{{'node_id': a, 'w': 1 - dx / 50.0::DOUBLE}}, {{'node_id': a + 1, 'w': (dx - dy) / 50.0::DOUBLE}}, {{'node_id': a + 22, 'w': dy / 50.0::DOUBLE}}] END) AS s FROM w)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s.node_id AS node_id, round(s.w, 6) + 0.0 AS w FROM parts""")
def stored_weights(spark, sf_dir):
    _, elems = the_mesh(spark)
    return locate.stored_weights(located(spark, sf_dir).select(*KEY, "elem_id", "l1", "l2", "l3"), KEY, elems).select(*KEY, "node_id", r(F.col("w")).alias("w"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity + l_tax) / 2 + sqrt(pow((l_quantity - l_tax) / 2, 2) + l_discount * l_discount), 6) AS l1, round((l_quantity * l_tax - l_discount * l_discount) / ((l_quantity + l_tax) / 2 + sqrt(pow((l_quantity - l_tax) / 2, 2) + l_discount * l_discount)), 6) + 0.0 AS l2 FROM lineitem")
def eigen_metric(spark, sf_dir):
    """Eigenvalues of symmetric matrices; the SQL has the second one from the determinant."""
    li = table(spark, sf_dir, "lineitem")
    a, b, _, _ = geometry.eigen2(li.l_quantity, li.l_discount, li.l_tax)
    return li.select(*KEY, r(a).alias("l1"), r(b).alias("l2"))


@query(f"""WITH p AS ({POINTS}), k AS (SELECT *, CASE WHEN px >= 60 THEN 2 WHEN px >= 25 THEN 1 ELSE 0 END AS k FROM p),
s AS (SELECT *, ([0.0, 25.0, 60.0, 100.0])[k + 1]::DOUBLE AS x0, ([0.0, 25.0, 60.0, 100.0])[k + 2]::DOUBLE AS x1, ([1.0, 3.0, 2.0, 5.0])[k + 1]::DOUBLE AS y0, ([1.0, 3.0, 2.0, 5.0])[k + 2]::DOUBLE AS y1, ([0.0, -0.01, 0.02, 0.0])[k + 1]::DOUBLE AS d0, ([0.0, -0.01, 0.02, 0.0])[k + 2]::DOUBLE AS d1 FROM k),
t AS (SELECT *, x1 - x0 AS h, (px - x0) / (x1 - x0) AS b FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((1 - b) * y0 + b * y1 + ((pow(1 - b, 3) - (1 - b)) * d0 + (pow(b, 3) - b) * d1) * h * h / 6, 6) + 0.0 AS v FROM t""")
def cubic_spline(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select(*KEY, r(geometry.cubic_spline([0.0, 25.0, 60.0, 100.0], [1.0, 3.0, 2.0, 5.0], [0.0, -0.01, 0.02, 0.0], p.px)).alias("v"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN px >= 62.5 THEN 3 WHEN px >= 30 THEN 2 WHEN px >= 12.5 THEN 1 ELSE 0 END AS up, CASE WHEN py <= 5 THEN 2 WHEN py <= 40 THEN 1 WHEN py <= 80 THEN 0 END::INT AS down FROM ({POINTS})")
def irregular_brackets(spark, sf_dir):
    """Intervals of a rising and of a falling irregular axis."""
    p = points(spark, sf_dir)
    return p.select(*KEY, geometry.bracket_any(p.px, [0.0, 12.5, 30.0, 62.5, 100.0]).cast("int").alias("up"), geometry.bracket_any(p.py, [80.0, 40.0, 5.0, -1.0]).cast("int").alias("down"))


# -- forcing ---------------------------------------------------------------------------------
@query("""WITH s AS (SELECT event_type, epoch_us(ts) AS t0, value AS v0, lead(epoch_us(ts)) OVER w AS t1 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), k AS (SELECT DISTINCT event_type FROM events),
a AS (SELECT event_type, epoch_us(TIMESTAMP '2024-01-01') + n * 3600000000 AS at_us FROM k, range(720) AS t(n)),
f AS (SELECT event_type, arg_min(value, ts) AS v FROM events GROUP BY ALL), d AS (SELECT event_type, epoch_us(ts) // 86400000000 AS d, arg_min(value, ts) AS v FROM events GROUP BY ALL)
SELECT a.event_type, a.at_us, s.v0 AS coupled, d.v AS daily, f.v AS constant FROM a LEFT JOIN s ON a.event_type = s.event_type AND t0 <= at_us AND at_us < t1 LEFT JOIN d ON a.event_type = d.event_type AND at_us // 86400000000 = d LEFT JOIN f ON a.event_type = f.event_type""")
def forcing_kinds(spark, sf_dir):
    """The value in force by half-open intervals, of the same day, and of the one step of a constant."""
    day = 86_400_000_000
    e = table(spark, sf_dir, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("v"))
    at = e.select("event_type").distinct().select("event_type", F.explode(F.sequence(long(0), long(719))).alias("n")).select("event_type", (1_704_067_200_000_000 + F.col("n") * 3_600_000_000).alias("at"))
    held = [asof.current(at, e, ["event_type"], "t", "v", day, kind, day).select("event_type", "at", F.col("v0").alias(kind)) for kind in ("coupled", "daily", "constant")]
    return held[0].join(held[1], ["event_type", "at"]).join(held[2], ["event_type", "at"]).withColumnRenamed("at", "at_us")


@query("""WITH n AS (SELECT user_id, sum(value) * 0.25 AS u, -sum(value) * 0.5 AS v FROM events GROUP BY user_id)
SELECT o_orderkey, o_totalprice + coalesce(round(u, 4), 0) AS u, 2 * o_totalprice + coalesce(round(v, 4), 0) AS v FROM orders LEFT JOIN n ON o_custkey = user_id""")
def perturbed_forcing(spark, sf_dir):
    """Noise times its deviation, added to both time steps of a forcing; places without noise stay."""
    n = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("o_custkey")).agg(F.sum("value").alias("nu"), (-F.sum("value")).alias("nv"))
    n = noise.scaled(n, {"nu": 0.25, "nv": 0.5}).withColumns({c: F.round(c, 4) for c in ("nu", "nv")})
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("u"), (2 * F.col("o_totalprice")).alias("v"))
    return noise.perturbed(o, n, ["o_custkey"], {"u": "nu", "v": "nv"}).drop("o_custkey")


# -- waves -----------------------------------------------------------------------------------
SPEC_SQL = """sp AS (SELECT s_suppkey AS elem_id, f, n, 0.05 + f * 0.02::DOUBLE AS freq, n * 45.0::DOUBLE AS dir, 0.02::DOUBLE AS wf, pi() / 4 AS wd, (1 + (s_suppkey * 7 + f * 3 + n * 5) % 11) / 10.0::DOUBLE AS s, 100.0::DOUBLE / (1 + f) AS wl, s_suppkey % 3 > 0 AS ice, 0.001::DOUBLE * (1 + f) AS rate, 8.0::DOUBLE - f AS cg FROM supplier, range(5) AS a(f), range(8) AS b(n))"""


def spectra(spark, sf_dir):
    k, f, n = F.col("elem_id"), F.col("f"), F.col("n")
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("elem_id")).withColumn("f", F.explode(F.sequence(long(0), long(4)))).withColumn("n", F.explode(F.sequence(long(0), long(7))))
    return base.withColumns({
        "freq": 0.05 + f * 0.02, "dir": n * 45.0, "wf": F.lit(0.02), "wd": F.lit(math.pi / 4), "s": (1 + (k * 7 + f * 3 + n * 5) % 11) / 10.0, "wl": 100.0 / (1 + f), "ice": k % 3 > 0, "rate": 0.001 * (1 + f), "cg": 8.0 - f,
    })


@query(f"WITH {SPEC_SQL} SELECT elem_id, f, round(sum(s * wd), 6) AS s, round(sum(s * wd * cos(-radians(90 + dir))), 6) + 0.0 AS sx, round(sum(s * wd * sin(-radians(90 + dir))), 6) + 0.0 AS sy FROM sp GROUP BY elem_id, f")
def direction_integrals(spark, sf_dir):
    out = waves.over_directions(spectra(spark, sf_dir), "s", "wd", "dir", ["elem_id", "f"])
    return out.select("elem_id", "f", *[r(F.col(c)).alias(c) for c in ("s", "sx", "sy")])


WAVE_SQL = """m AS (SELECT elem_id, sum(wf * wd * s) AS m0, sum(wf * wd * s * pow(2 * pi() * freq, 2)) AS m2, sum(wf * wd * s * cos(-radians(90 + dir))) AS mx, sum(wf * wd * s * sin(-radians(90 + dir))) AS my,
sum(wf * wd * s * cos(-radians(90 + dir)) * 8 * pi() * pi() * freq / wl) AS stokes_x, sum(wf * wd * s * sin(-radians(90 + dir)) * 8 * pi() * pi() * freq / wl) AS stokes_y FROM {0} GROUP BY elem_id)
SELECT elem_id, round(4 * sqrt(m0), 6) AS hs, round(2 * pi() * sqrt(m0 / m2), 6) AS tp, round(-90 - degrees(atan2(my, mx)), 4) + 0.0 AS mwd, round(stokes_x, 6) + 0.0 AS stokes_x, round(stokes_y, 6) + 0.0 AS stokes_y FROM m"""


def _integrated(spec):
    sums = waves.over_directions(spec, "s", "wd", "dir", ["elem_id", "freq", "wf", "wl"])
    out = waves.integrals(sums, "freq", "wf", "wl")
    return out.select("elem_id", *[r(F.col(c), 4 if c == "mwd" else 6).alias(c) for c in ("hs", "tp", "mwd", "stokes_x", "stokes_y")])


@query(f"WITH {SPEC_SQL}, {WAVE_SQL.format('sp')}")
def wave_integrals(spark, sf_dir):
    return _integrated(spectra(spark, sf_dir))


@query(f"WITH {SPEC_SQL}, sq AS (SELECT * REPLACE (s * (0.5 + elem_id % 4 * 0.25) AS s) FROM sp), {WAVE_SQL.format('sq')}")
def rescaled_spectrum(spark, sf_dir):
    """Integrals after the elements changed their areas."""
    spec = spectra(spark, sf_dir)
    factor = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("elem_id"), (0.5 + F.col("s_suppkey") % 4 * 0.25).alias("factor"))
    return _integrated(waves.rescaled(spec, factor, "s"))


@query(f"""WITH {SPEC_SQL}, t AS (SELECT elem_id, f, round(sum(CASE WHEN ice THEN cos(-radians(90 + dir)) * wd * s * rate * cg ELSE 0 END), 8) + 0.0 AS tau_x, round(sum(CASE WHEN ice THEN sin(-radians(90 + dir)) * wd * s * rate * cg ELSE 0 END), 8) + 0.0 AS tau_y FROM sp GROUP BY elem_id, f)
SELECT elem_id, f, n, round(CASE WHEN ice THEN s * exp(-rate * cg * 60) ELSE s END, 6) AS s, tau_x, tau_y FROM sp JOIN t USING (elem_id, f)""")
def attenuated_spectrum(spark, sf_dir):
    spec, stress = waves.attenuated(spectra(spark, sf_dir), "s", "wd", "dir", F.col("ice"), F.col("rate"), F.col("cg"), 60.0, ["elem_id", "f"])
    return spec.select("elem_id", "f", "n", r(F.col("s")).alias("s")).join(stress.select("elem_id", "f", r(F.col("tau_x"), 8).alias("tau_x"), r(F.col("tau_y"), 8).alias("tau_y")), ["elem_id", "f"])


@query(f"""WITH {SPEC_SQL}, h AS (SELECT p.elem_id, p.f, p.n, p.s, p.ice, k, exp(-(CASE WHEN k = 0 THEN 0 ELSE p.rate END + p.rate / 4) * p.cg * 60) AS g, sum(q.s * cos(2 * pi() * k * (q.n - p.n) / 8)) / 8 AS c
FROM sp AS p JOIN sp AS q USING (elem_id, f), range(8) AS t(k) GROUP BY p.elem_id, p.f, p.n, p.s, p.ice, p.rate, p.cg, k)
SELECT elem_id, f, n, round(CASE WHEN ice THEN sum(g * c) ELSE s END, 6) AS s FROM h GROUP BY elem_id, f, n, s, ice""")
def scattered_spectrum(spark, sf_dir):
    """Isotropic scattering; the SQL sums all harmonics."""
    spec = spectra(spark, sf_dir).withColumns({"q_scat": F.col("rate"), "q_abs": F.col("rate") / 4})
    return waves.scattered(spec, "s", 60.0, ["elem_id", "f"]).select("elem_id", "f", "n", r(F.col("s")).alias("s"))


@query("SELECT s_suppkey AS elem_id, CASE WHEN s_suppkey % 3 = 0 AND s_acctbal > 1e-3 THEN s_acctbal ELSE 0 END::DOUBLE AS hs, CASE WHEN s_suppkey % 3 = 0 AND s_acctbal > 1e-3 THEN s_suppkey % 9 * 1.5 ELSE 0 END::DOUBLE AS tp FROM supplier")
def prescribed_waves(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("elem_id"), (F.col("s_suppkey") % 3 == 0).alias("open"), F.col("s_acctbal").alias("hs"), (F.col("s_suppkey") % 9 * 1.5).alias("tp"))
    out = waves.prescribed(s.withColumns({"hs": F.lit(1.0), "tp": F.lit(1.0)}), s, F.col("open") & (F.col("_hs") > 1e-3), ("hs", "tp"))
    return out.select("elem_id", "hs", "tp")


_D, _L = 5.49e9 / (12 * (1 - 0.09)) / (1025 * 9.81), 922.5 / (1025 * 9.81)


@query(f"""WITH a AS (SELECT s_suppkey AS elem_id, 0.3 + s_suppkey % 8 * 0.25::DOUBLE AS h, 0.4 + s_suppkey % 5 * 0.2::DOUBLE AS om, 20 + s_suppkey % 13 * 15.0::DOUBLE AS size, s_suppkey % 4 > 0 AS ice, s_suppkey % 7 * 1e-10::DOUBLE AS strain FROM supplier),
b AS (SELECT *, {_D!r} * pow(h, 3) AS d, greatest(1 - {_L!r} * h * om * om, 1e-9) AS l, om * om / 9.81 AS w FROM a),
k AS (SELECT elem_id, ice, strain, size, list_reduce(list_prepend(w / l, list_transform(range(40), lambda x: 0.0::DOUBLE)), lambda k, i: k - (d * pow(k, 5) + l * k - w) / (5 * d * pow(k, 4) + l)) AS k FROM b),
c AS (SELECT elem_id, k, size, ice AND 2 * strain > 1e-10 AND 2 * pi() / k < 2 * size AS broken FROM k)
SELECT elem_id, broken, round(CASE WHEN broken THEN greatest(20, pi() / k) ELSE size END, 4) AS size, round(2 * pi() / k, 4) AS wavelength FROM c""")
def wave_breaking(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("elem_id"), (0.3 + k % 8 * 0.25).alias("thickness"), F.lit(1.0).alias("m0"), F.pow(0.4 + k % 5 * 0.2, F.lit(2)).alias("m2"), (20 + k % 13 * 15.0).alias("size"), F.lit(0.9).alias("conc"), (k % 4 > 0).alias("ice"), (k % 7 * 1e-10).alias("var_strain"))
    length = 2 * math.pi / waves.ice_wavenumber(F.sqrt(F.col("m2")), F.col("thickness"))
    return waves.broken(s, 1e-5, 20.0).select("elem_id", "broken", r(F.col("size"), 4).alias("size"), r(length, 4).alias("wavelength"))
