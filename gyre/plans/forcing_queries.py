"""Queries of forcing data: vectors on a map, resampling between map grids, loading of a dataset; registered beside those of ``queries``."""

from __future__ import annotations

import datetime
import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyre.functions import geodesy, geometry, spectral, timeconv
from gyre.operators import drifters, grids, locate, noise
from gyre.shared import shared_dir
from gyre.sources import catalog

from .field_queries import geographic
from .queries import NPS, PLACES, RHO, places, query, r, table

_R, _E = geodesy.RADIUS, geodesy.ECC


# -- vectors ---------------------------------------------------------------------------------
def _xy(lat: str, lon: str) -> tuple[str, str]:
    rho = RHO.replace("lat", "LAT").replace("LAT", f"({lat})")
    return f"({rho}) * sin(radians({lon} + 45))", f"-({rho}) * cos(radians({lon} + 45))"


_far = _xy("lat + degrees(v / 6378273.0::DOUBLE)", "(lon + degrees(u / (6378273.0::DOUBLE * cos(radians(lat)))))")
_here = _xy("lat", "lon")


@query(f"""WITH p AS (SELECT c_custkey, least(lat, 89.0) AS lat, lon, c_acctbal / 1000 AS u, c_custkey % 21 - 10.0::DOUBLE AS v FROM ({PLACES})), d AS (SELECT *, {_far[0]} - {_here[0]} AS dx, {_far[1]} - {_here[1]} AS dy FROM p)
SELECT c_custkey, round(dx / sqrt(dx * dx + dy * dy) * sqrt(u * u + v * v), 4) + 0.0 AS x, round(dy / sqrt(dx * dx + dy * dy) * sqrt(u * u + v * v), 4) + 0.0 AS y, round(u * cos(radians(30)) - v * sin(radians(30)), 6) + 0.0 AS tx, round(u * sin(radians(30)) + v * cos(radians(30)), 6) + 0.0 AS ty FROM d""")
def vectors_on_map(spark, sf_dir):
    """Winds to the east and north in map axes, and winds of another map turned into this one's."""
    p = places(spark, sf_dir).select("c_custkey", F.least("lat", F.lit(89.0)).alias("lat"), "lon", (F.col("c_acctbal") / 1000).alias("u"), (F.col("c_custkey") % 21 - 10.0).alias("v"))
    turned = grids.on_map(p, "u", "v", "map", "polar_stereographic", NPS, turn=30.0).select("c_custkey", r(F.col("u")).alias("tx"), r(F.col("v")).alias("ty"))
    out = grids.on_map(p, "u", "v", "east_north", "polar_stereographic", NPS)
    return out.select("c_custkey", r(F.col("u"), 4).alias("x"), r(F.col("v"), 4).alias("y")).join(turned, "c_custkey")


_along = f"sqrt(pow({_R * 1000!r} * sin(radians(lat)), 2) + pow({_R * 1000 * math.sqrt(1 - _E * _E)!r} * cos(radians(lat)), 2))"


def _waves_sql(sign: int) -> str:
    far = _xy(f"lat + degrees({10 * sign} * cos(radians(dir)) / {_along})", f"(lon + degrees({10 * sign} * sin(radians(dir)) / ({_R * 1000!r} * cos(radians(lat)))))")
    return f"SELECT c_custkey, {sign} AS s, dir, lat, {far[0]} - {_here[0]} AS dx, {far[1]} - {_here[1]} AS dy FROM p"


@query(f"""WITH p AS (SELECT c_custkey, lat, lon, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey * 37 % 360)::DOUBLE END AS dir FROM ({PLACES})), d AS ({_waves_sql(-1)} UNION ALL {_waves_sql(1)})
SELECT c_custkey, CASE s WHEN 1 THEN 'waves_to' ELSE 'waves_from' END AS kind, CASE WHEN dir IS NULL OR lat > 89.5 THEN 0 ELSE round(dx / sqrt(dx * dx + dy * dy), 5) + 0.0 END::DOUBLE AS x, CASE WHEN dir IS NULL OR lat > 89.5 THEN 0 ELSE round(dy / sqrt(dx * dx + dy * dy), 5) + 0.0 END::DOUBLE AS y FROM d""")
def wave_directions_on_map(spark, sf_dir):
    """Unit vectors of waves by where they come from or go to; none without a direction or near the pole."""
    k = F.col("c_custkey")
    p = places(spark, sf_dir).select(k, "lat", "lon", F.when(k % 5 > 0, (k * 37 % 360).cast("double")).alias("dir"))
    parts = []
    for kind in ("waves_from", "waves_to"):
        out = grids.on_map(p.withColumns({"x": F.col("dir"), "y": F.col("dir")}), "x", "y", kind, "polar_stereographic", NPS)
        parts.append(out.select("c_custkey", F.lit(kind).alias("kind"), r(F.col("x"), 5).alias("x"), r(F.col("y"), 5).alias("y")))
    return parts[0].union(parts[1])


@query("""WITH g AS (SELECT n_nationkey AS i, s_suppkey AS j, s_suppkey % 7 - 3.0::DOUBLE + n_nationkey / 10.0::DOUBLE AS u, n_nationkey % 5 - 2.0::DOUBLE AS v FROM supplier, nation),
m AS (SELECT avg(u * cos(radians(20)) - v * sin(radians(20))) AS x, avg(u * sin(radians(20)) + v * cos(radians(20))) AS y FROM g WHERE j = 1)
SELECT i, j, round(CASE WHEN j = 0 THEN m.x ELSE u * cos(radians(20)) - v * sin(radians(20)) END, 6) + 0.0 AS x, round(CASE WHEN j = 0 THEN m.y ELSE u * sin(radians(20)) + v * cos(radians(20)) END, 6) + 0.0 AS y FROM g, m""")
def pole_vectors(spark, sf_dir):
    """Vectors on a grid whose first row is the pole."""
    g = geographic(spark, sf_dir).withColumns({"u": F.col("j") % 7 - 3.0 + F.col("i") / 10, "v": F.col("i") % 5 - 2.0})
    out = grids.on_map(g, "u", "v", "map", "polar_stereographic", NPS, turn=20.0, pole=(0, 1))
    return out.select("i", "j", r(F.col("u")).alias("x"), r(F.col("v")).alias("y"))


# -- resampling ------------------------------------------------------------------------------
SPHERE = geodesy.MapSpec(lat0=90.0, lon0=-45.0, lat1=60.0, radius=6371.0)
PLATE = geodesy.MapSpec(lat0=0.0, lon0=0.0, lat1=0.0, radius=6371.0)
_K = 6371.0 * (1 + math.sin(math.radians(60)))
#: The source grid has a row a supplier and a column a nation, cells of 100 units, and the pole at column 12, row 5.
SOURCE = """s AS (SELECT n_nationkey AS i, s_suppkey AS j, (n_nationkey * 7 + s_suppkey * 3) % 11 + n_nationkey / 4.0::DOUBLE AS v FROM supplier, nation)"""


def source_grid(spark, sf_dir) -> DataFrame:
    g = geographic(spark, sf_dir).select("i", "j")
    return g.withColumn("v", (F.col("i") * 7 + F.col("j") * 3) % 11 + F.col("i") / 4)


@query(f"""WITH {SOURCE}, p AS (SELECT v, (i - 12.2::DOUBLE) * 100 AS x, (5.1::DOUBLE - j) * 100 AS y FROM s), g AS (SELECT v, radians(90 - 2 * degrees(atan(sqrt(x * x + y * y) / {_K!r}))) AS phi, radians((degrees(atan2(x, -y)) - 45 + 540) % 360 - 180) AS lam FROM p),
c AS (SELECT v, 30.3::DOUBLE + 6371.0::DOUBLE * lam / 700 AS a, 20.2::DOUBLE - 6371.0::DOUBLE * phi / 700 AS b FROM g) SELECT floor(a + 0.5)::BIGINT AS ci, floor(b + 0.5)::BIGINT AS cj, round(avg(v), 6) AS v, count(*) AS n FROM c WHERE a >= -0.5 AND a < 59.5 AND b >= -0.5 AND b < 39.5 GROUP BY ALL""")
def resampled_buckets(spark, sf_dir):
    """Means of a polar grid's values in the cells of a cylindrical one."""
    s = source_grid(spark, sf_dir)
    lat, lon = grids.cell_place(F.col("i"), F.col("j"), (12.2, 5.1), 1 / 100, "polar_stereographic_sphere", SPHERE)
    at = grids.target_cells(s.withColumns({"lat": lat, "lon": lon}), "cylindrical_equidistant", PLATE, (30.3, 20.2), 1 / 700, (40, 60))
    return grids.bucket_means(at, "v").select("ci", "cj", r(F.col("v")).alias("v"), "n")


_W = "CASE WHEN abs({0}) < 1 THEN 1 - 2 * pow({0}, 2) + pow(abs({0}), 3) WHEN abs({0}) < 2 THEN 4 - 8 * abs({0}) + 5 * pow({0}, 2) - pow(abs({0}), 3) ELSE 0 END"


@query(f"""WITH {SOURCE}, t AS (SELECT c_custkey, radians(82 + c_custkey % 70 / 10.0::DOUBLE) AS phi, (c_custkey * 29 % 360)::DOUBLE AS lon FROM customer), q AS (SELECT c_custkey, {_K!r} * tan(pi() / 4 - phi / 2) * sin(radians(lon + 45)) AS x, -{_K!r} * tan(pi() / 4 - phi / 2) * cos(radians(lon + 45)) AS y FROM t),
p AS (SELECT c_custkey, 12 + x / 100 AS a, 5 - y / 100 AS b FROM q), e AS (SELECT *, a >= -0.5 AND a < 24.5 AND b >= -0.5 AND b < (SELECT count(*) FROM supplier) - 0.5 AS ok FROM p),
w AS (SELECT c_custkey, v, ({_W.format('(a - i)')}) * ({_W.format('(b - j)')}) AS w FROM e JOIN s ON i BETWEEN floor(a) - 1 AND floor(a) + 2 AND j BETWEEN floor(b) - 1 AND floor(b) + 2 WHERE ok)
SELECT c_custkey, round(z.v, 5) AS v FROM customer LEFT JOIN (SELECT c_custkey, sum(w * v) / sum(w) AS v FROM w GROUP BY c_custkey HAVING abs(sum(w)) > 1e-9) AS z USING (c_custkey)""")
def resampled_cubic(spark, sf_dir):
    """A polar grid's values at customers' places by cubic convolution."""
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(k, (82 + k % 70 / 10).alias("lat"), (k * 29 % 360).cast("double").alias("lon"))
    rows = table(spark, sf_dir, "supplier").count()
    at = grids.target_cells(t, "polar_stereographic_sphere", SPHERE, (12.0, 5.0), 1 / 100, (rows, 25))
    return grids.cubic_values(at, source_grid(spark, sf_dir), ["c_custkey"], "v").select("c_custkey", r(F.col("v"), 5).alias("v"))


@query(f"""WITH {SOURCE}, t AS (SELECT c_custkey, radians(82 + c_custkey % 70 / 10.0::DOUBLE) AS phi, (c_custkey * 29 % 360)::DOUBLE AS lon FROM customer), q AS (SELECT c_custkey, {_K!r} * tan(pi() / 4 - phi / 2) * sin(radians(lon + 45)) AS x, -{_K!r} * tan(pi() / 4 - phi / 2) * cos(radians(lon + 45)) AS y FROM t),
p AS (SELECT c_custkey, 12 + x / 100 AS a, 5 - y / 100 AS b FROM q), e AS (SELECT *, floor(a)::BIGINT AS i, floor(b)::BIGINT AS j FROM p WHERE a >= 0 AND a < 24 AND b >= 0 AND b < (SELECT count(*) FROM supplier) - 1)
SELECT c_custkey, round(a.v * (1 - dx) * (1 - dy) + g.v * dx * (1 - dy) + h.v * (1 - dx) * dy + k.v * dx * dy, 5) AS bilinear, CASE WHEN dx <= 0.5 THEN CASE WHEN dy <= 0.5 THEN a.v ELSE h.v END ELSE CASE WHEN dy <= 0.5 THEN g.v ELSE k.v END END AS nearest
FROM (SELECT c_custkey, i, j, a - i AS dx, b - j AS dy FROM e) AS e JOIN s AS a ON a.i = e.i AND a.j = e.j JOIN s AS g ON g.i = e.i + 1 AND g.j = e.j JOIN s AS h ON h.i = e.i AND h.j = e.j + 1 JOIN s AS k ON k.i = e.i + 1 AND k.j = e.j + 1""")
def resampled_cells(spark, sf_dir):
    """A polar grid's values at customers' places, bilinear and of the nearest cell; places within the grid only, as a cell needs four corners."""
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(k, (82 + k % 70 / 10).alias("lat"), (k * 29 % 360).cast("double").alias("lon"))
    rows = table(spark, sf_dir, "supplier").count()
    at = grids.target_cells(t, "polar_stereographic_sphere", SPHERE, (12.0, 5.0), 1 / 100, (rows, 25)).where(f"col >= 0 AND col < 24 AND row >= 0 AND row < {rows - 1}")
    held = locate.cell_values(at.withColumnsRenamed({"col": "px", "row": "py"}), source_grid(spark, sf_dir), (0.0, 0.0), 1.0, (25, rows), "v")
    a = [F.col(c) for c in ("dx", "dy", "v00", "v10", "v01", "v11")]
    return held.select("c_custkey", r(geometry.bilinear(*a), 5).alias("bilinear"), geometry.nearest(*a).alias("nearest"))


@query(f"""WITH p AS (SELECT c_custkey, 6371 * cos(radians(lat)) * cos(radians(lon)) AS x, 6371 * cos(radians(lat)) * sin(radians(lon)) AS y, 6371 * sin(radians(lat)) AS z, lat, lon FROM ({PLACES}))
SELECT c_custkey, round(lat, 6) AS lat, round((lon + 360) % 360, 5) AS lon, round({_here[0]}, 3) + 0.0 AS x, round({_here[1]}, 3) + 0.0 AS y FROM p""")
def cartesian_on_map(spark, sf_dir):
    """Places in space, on a map."""
    p = places(spark, sf_dir)
    a, b = F.radians("lat"), F.radians("lon")
    p = p.select("c_custkey", *[(6371 * c).alias(n) for n, c in (("cx", F.cos(a) * F.cos(b)), ("cy", F.cos(a) * F.sin(b)), ("cz", F.sin(a)))])
    lat, lon = geodesy.from_cartesian(F.col("cx"), F.col("cy"), F.col("cz"))
    p = p.withColumns({"lat": lat, "lon": lon})
    x, y = geodesy.forward("polar_stereographic", F.col("lat"), F.col("lon"), NPS)
    return p.select("c_custkey", r(F.col("lat")).alias("lat"), r(F.col("lon"), 5).alias("lon"), r(x, 3).alias("x"), r(y, 3).alias("y"))


@query(f"""WITH p AS (SELECT c_custkey, (c_custkey * 37 % 5000) - 2500.0::DOUBLE + 0.5 AS x, (c_custkey * 53 % 4000) - 2000.0::DOUBLE + 0.25 AS y FROM customer)
SELECT c_custkey, round((degrees(atan2(x, -y)) - 45 + 710) % 360 + 10, 5) AS lon, round(90 - 2 * degrees(atan(sqrt(x * x + y * y) / {_K!r})), 6) AS lat, round(x * cos(radians(35)) + y * sin(radians(35)), 5) + 0.0 AS tx, round(y * cos(radians(35)) - x * sin(radians(35)), 5) + 0.0 AS ty FROM p""")
def targets_of_data(spark, sf_dir):
    """Places of a model's map in the axes of a dataset: longitudes from 10 degrees on, and a map turned by 35."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k, (k * 37 % 5000 - 2500.0 + 0.5).alias("x"), (k * 53 % 4000 - 2000.0 + 0.25).alias("y"))
    lon, lat = geodesy.to_data_axes("polar_stereographic_sphere", p.x, p.y, SPHERE, cut=10.0)
    tx, ty = geodesy.to_data_axes("polar_stereographic_sphere", p.x, p.y, SPHERE, turn=35.0)
    return p.select("c_custkey", r(lon, 5).alias("lon"), r(lat).alias("lat"), r(tx, 5).alias("tx"), r(ty, 5).alias("ty"))


@query(f"""WITH {SOURCE}, n AS (SELECT count(*) AS n FROM supplier), p AS (SELECT c_custkey, c_custkey * 37 % 240 / 10.0::DOUBLE + 0.03::DOUBLE AS px, c_custkey * 11 % (10 * (n - 1)) / 10.0::DOUBLE + 0.07::DOUBLE AS py FROM customer, n), e AS (SELECT *, floor(px)::BIGINT AS i, floor(py)::BIGINT AS j FROM p), d AS (SELECT c_custkey, i, j, px - i AS dx, py - j AS dy FROM e),
w AS (SELECT c_custkey, s.v, s.i * s.j AS u, CASE WHEN s.i = d.i THEN 1 - dx ELSE dx END * CASE WHEN s.j = d.j THEN 1 - dy ELSE dy END AS w FROM d JOIN s ON s.i IN (d.i, d.i + 1) AND s.j IN (d.j, d.j + 1)) SELECT c_custkey, round(sum(w * v), 5) AS v, round(sum(w * u), 5) + 0.0 AS u FROM w GROUP BY c_custkey""")
def grid_variables_at_places(spark, sf_dir):
    """Two variables of a grid at customers' places, by one look for the cell."""
    k, rows = F.col("c_custkey"), table(spark, sf_dir, "supplier").count()
    p = table(spark, sf_dir, "customer").select(k, (k * 37 % 240 / 10 + 0.03).alias("px"), (k * 11 % (10 * (rows - 1)) / 10 + 0.07).alias("py"))
    held = locate.cell_values(p, source_grid(spark, sf_dir).withColumn("u", F.col("i") * F.col("j")), (0.0, 0.0), 1.0, (25, rows), ["v", "u"])
    of = lambda n: geometry.bilinear(F.col("dx"), F.col("dy"), *[F.col(n + at) for at in ("00", "10", "01", "11")])
    return held.select("c_custkey", r(of("v"), 5).alias("v"), r(of("u"), 5).alias("u"))


# -- loading ---------------------------------------------------------------------------------
@query("""WITH g AS (SELECT n_nationkey AS i, s_suppkey AS j, n_nationkey * 10.0::DOUBLE AS x, s_suppkey * 5.0::DOUBLE AS y FROM supplier, nation WHERE (n_nationkey + s_suppkey) % 5 > 0), a AS (SELECT max(s_suppkey) // 2 AS top FROM supplier),
c AS (SELECT *, row_number() OVER (ORDER BY j, i) - 1 AS cell FROM g, a WHERE i BETWEEN 2 AND 13 AND j BETWEEN 0 AND top + 1)
SELECT cell, i, j, x, y, round(45292 + k / 4.0::DOUBLE, 6) AS days, (i * 3 + j * 7 + k) % 11 - 5.0::DOUBLE AS u, (i + j * 2 + k) % 7 * 0.5::DOUBLE AS v FROM c, (VALUES (4), (5)) AS t(k)""")
def loaded_dataset(spark, sf_dir):
    """The two steps around a time from the daily files of a dataset, staged from the tables: cropped to a box, wet cells numbered."""
    d = catalog.dataset("generic_ps_atm_nodes")
    root = f"{shared_dir(spark)}/gyre-staged-{uuid.uuid4().hex}"
    g = geographic(spark, sf_dir).select("i", "j", (F.col("i") * 10.0).alias("x"), (F.col("j") * 5.0).alias("y"))
    wet, k = (F.col("i") + F.col("j")) % 5 > 0, F.col("k")
    for day in range(3):
        steps = g.withColumn("k", F.explode(F.array(*[F.lit(4 * day + n) for n in range(4)])))
        u, v = (F.col("i") * 3 + F.col("j") * 7 + k) % 11 - 5.0, (F.col("i") + F.col("j") * 2 + k) % 7 * 0.5
        rows = steps.select("i", "j", "x", "y", (45292 + k / 4).alias("time"), F.when(wet, u).alias("x_wind_10m"), F.when(wet, v).alias("y_wind_10m"))
        rows.write.parquet(d.path(datetime.date(1900, 1, 1) + datetime.timedelta(days=45292 + day), root))
    top = table(spark, sf_dir, "supplier").agg(F.floor(F.max("s_suppkey") / 2)).first()[0]
    out = d.loaded(spark, 45292 + 1.1, root, box=(28.0, 122.0, -1.0, top * 5.0), halo=1, wet="x_wind_10m")
    return out.select("cell", "i", "j", "x", "y", r(F.col("days")).alias("days"), "u", "v")


# -- drifters --------------------------------------------------------------------------------
TRACKS = """e AS (SELECT user_id AS k, epoch_us(ts) // 3600000000 - 473352 AS t, value, event_id FROM events), d AS (SELECT k, t, (k % 30)::DOUBLE AS x0, (k % 17)::DOUBLE AS y0, round(sum(value), 2) / 100 AS u, count(*) * 0.5::DOUBLE AS v, min(event_id) % 10 / 10.0::DOUBLE AS conc, min(event_id) % 4 > 0 AS seen FROM e GROUP BY k, t),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS n FROM d)"""


@query(f"""WITH RECURSIVE {TRACKS}, run AS (SELECT k, 0::BIGINT AS n, 0::BIGINT AS t, false AS begun, false AS here, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 24::BIGINT AS start, 0.0::DOUBLE AS conc, false AS ended, 0.0::DOUBLE AS lx, 0.0::DOUBLE AS ly, false AS shown FROM (SELECT DISTINCT k FROM d)
UNION ALL SELECT k, n, t, begun, here, x, y, start, conc, ended, lx, ly, here AND t >= 24 AND (t - 24) % 3 = 0 FROM (SELECT * REPLACE (CASE WHEN begun AND (t - 24) % 6 = 0 THEN seen AND conc > 0.25 ELSE here END AS here, CASE WHEN begun AND (t - 24) % 6 = 0 AND NOT here THEN x0 ELSE x END AS x, CASE WHEN begun AND (t - 24) % 6 = 0 AND NOT here THEN y0 ELSE y END AS y)
FROM (SELECT * REPLACE (begun OR t >= start AS begun, CASE WHEN NOT begun AND t >= start THEN conc > 0.25 ELSE here END AS here, CASE WHEN NOT begun AND t >= start THEN x0 ELSE x END AS x, CASE WHEN NOT begun AND t >= start THEN y0 ELSE y END AS y)
FROM (SELECT *, over AND here0 AS ended, x AS lx, y AS ly, begun0 AND NOT over AS begun, here0 AND NOT over AS here, start0 + CASE WHEN over THEN 48 ELSE 0 END AS start
FROM (SELECT r.k, r.n, r.t, r.x0, r.y0, r.conc, r.seen, run.begun AS begun0, run.here AS here0, run.start AS start0, run.x + CASE WHEN run.here THEN u ELSE 0 END AS x, run.y + CASE WHEN run.here THEN v ELSE 0 END AS y, run.begun AND r.t - run.start >= 48 AS over FROM run JOIN r ON r.k = run.k AND r.n = run.n + 1)))))
SELECT k AS drifter_id, t, round(lx, 6) AS x, round(ly, 6) AS y, conc, 'last' AS kind FROM run WHERE ended UNION ALL SELECT k, t, round(x, 6), round(y, 6), conc, 'output' FROM run WHERE shown""")
def drifter_run(spark, sf_dir):
    """Users as drifters, hour by hour: sets of two days, buoys every six hours, output every three; the SQL folds each drifter's rows by recursion."""
    e = table(spark, sf_dir, "events")
    k = F.col("user_id")
    hour = F.floor(timeconv.micros(e.ts) / 3_600_000_000).cast("long") - 473_352
    rows = e.groupBy(k.alias("drifter_id"), hour.alias("t")).agg((F.round(F.sum("value"), 2) / 100).alias("u"), (F.count("*") * 0.5).alias("v"), F.min("event_id").alias("m"))
    d = F.col("drifter_id")
    rows = rows.select(d.cast("long").alias("drifter_id"), "t", (d % 30).cast("double").alias("x"), (d % 17).cast("double").alias("y"), "u", "v", (F.col("m") % 10 / 10).alias("conc"), (F.col("m") % 4 > 0).alias("reported"))
    out = drifters.run_steps(rows, drifters.Schedule(24, 48, 6, 3, 0.25))
    return out.select("drifter_id", "t", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"), "conc", "kind")


# -- grids, masks, noise ---------------------------------------------------------------------
@query(f"""WITH g AS (SELECT i, s_suppkey AS j, i * 25.0::DOUBLE - 300 AS x, s_suppkey * 25.0::DOUBLE - 100 AS y, s_acctbal AS v FROM supplier, range(30) AS a(i))
SELECT i, j, round(90 - 2 * degrees(atan(sqrt(x * x + y * y) / {_K!r})), 6) AS lat, round((degrees(atan2(x, -y)) - 45 + 540) % 360 - 180, 6) + 0.0 AS lon, v FROM g WHERE x <> 0 OR y <> 0""")
def regular_map_grid(spark, sf_dir):
    """A lattice on a map with a row for each supplier, its places and the supplier's value; not the pole, which has no longitude."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("j"), F.col("s_acctbal").alias("v"))
    g = grids.map_lattice(spark, 30, s.count(), 25.0, (-300.0, -100.0), "polar_stereographic_sphere", SPHERE).where("x <> 0 OR y <> 0")
    return g.join(s, "j").select("i", "j", r(F.col("lat")).alias("lat"), r(F.col("lon")).alias("lon"), "v")


_CORNER = [(-0.5, -1.0), (-0.5, 1.0), (0.5, 1.0), (0.5, -1.0)]


@query(f"""WITH g AS (SELECT n_nationkey AS i, s_suppkey AS j, (30 + s_suppkey * 59.5 / 1000)::DOUBLE AS lat, (n_nationkey * 14.4 - 180)::DOUBLE AS lon FROM supplier, nation)
SELECT i, j, {", ".join(f"round({_xy(f'lat + {a}', f'(lon + {b})')[0]}, 3) + 0.0 AS x{k}, round({_xy(f'lat + {a}', f'(lon + {b})')[1]}, 3) + 0.0 AS y{k}" for k, (a, b) in enumerate(_CORNER))} FROM g""")
def cell_corners_on_map(spark, sf_dir):
    """Corners of geographic cells on a map."""
    names = {f"{c}{k}": F.col(c) + d for k, ds in enumerate(_CORNER) for c, d in zip(("lat", "lon"), ds)}
    g = grids.with_corners(geographic(spark, sf_dir).withColumns(names), [(f"lat{k}", f"lon{k}") for k in range(4)], "polar_stereographic", NPS)
    return g.select("i", "j", *[r(F.col(f"{c}_corners")[k], 3).alias(f"{c}{k}") for k in range(4) for c in "xy"])


@query("""WITH w AS (SELECT s_suppkey, s_suppkey % 3 = 0 AS ice, s_suppkey % 7 = 0 AS land, s_acctbal / 1000 AS hs, s_suppkey % 11 * 1.5::DOUBLE AS period FROM supplier)
SELECT s_suppkey, NOT ice AND NOT land AND hs > 0.001 AND period > 1e-8 AND period < 12 AS waves, printf('%dh %dm %ds', s_suppkey * 977 // 3600, s_suppkey * 977 // 60 % 60, s_suppkey * 977 % 60) AS spent FROM w""")
def wave_masks(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    return s.select(k, spectral.wave_mask(k % 3 == 0, k % 7 == 0, F.col("s_acctbal") / 1000, k % 11 * 1.5, 8.0).alias("waves"), timeconv.time_spent(k * 977).alias("spent"))


_FACTOR = noise.speed_factor(10.0, 5.0, 50.0, 30000.0)


@query(f"""WITH p AS (SELECT s_suppkey AS j, i, (s_suppkey * 31 + i * i * 7) % 50 / 10.0::DOUBLE AS p FROM supplier, range(30) AS t(i)), k AS (SELECT 2 * sin(40 * pi() / 180) * 2 * pi() / 86400 AS c),
g AS (SELECT a.i, a.j, coalesce((a.p - w.p) / 30000, 0) AS gx, coalesce((a.p - s.p) / 30000, 0) AS gy FROM p AS a LEFT JOIN p AS w ON w.j = a.j AND w.i = a.i - 1 AND a.j > 0 LEFT JOIN p AS s ON s.j = a.j - 1 AND s.i = a.i AND a.i > 0), f AS (SELECT 5.0 / (3 * 100 * 10.0 / (50.0 * 30000) / c) AS f, c * 1.2 AS cor, sin(60) / 60 * pi() / 2 AS w FROM k)
SELECT i, j, round(100 * f * (-w * gy - (1 - w) * gx) / cor, 6) + 0.0 AS u, round(100 * f * (w * gx - (1 - w) * gy) / cor, 6) + 0.0 AS v FROM g, f""")
def scaled_wind(spark, sf_dir):
    """The wind of a random pressure, scaled to the wind's own deviation."""
    g = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("i")).withColumn("p", (F.col("j") * 31 + F.col("i") * F.col("i") * 7) % 50 / 10.0)
    u, v = noise.geostrophic(F.col("gx"), F.col("gy"), _FACTOR)
    return noise.pressure_gradient(g, "p", 30000.0).select("i", "j", r(u).alias("u"), r(v).alias("v"))
