"""Queries that write files of the given tables into the shared folder and read them back, and of plane shapes, texts of times and curves; registered beside those of ``queries``."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.functions import geodesy, geometry, timeconv
from gyre.operators import drifters, gridmean, mesh
from gyre.shared import shared_dir
from gyre.sources import catalog, columns, files

from .field_queries import geographic
from .mesh_queries import TE, TN, part_mesh, part_nodes
from .queries import KEY, PLACES, POINTS, places, points, query, r, table


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gyre-{name}-{uuid.uuid4().hex}"


# -- meshes and checkpoints ------------------------------------------------------------------
@query(f"WITH {TE} SELECT 'node' AS kind, node_id AS id, x, y, NULL AS n1, NULL AS n2, NULL AS n3 FROM tn UNION ALL SELECT 'elem', elem_id, NULL, NULL, n1, n2, n3 FROM te")
def mesh_text_back(spark, sf_dir):
    """A mesh written as a text of lines and read in splits."""
    nodes, elems = part_mesh(spark, sf_dir)
    path = folder(spark, "mesh-text")
    files.msh_text(nodes, elems).coalesce(1).sortWithinPartitions("part", "id").select("line").write.text(path)  # a text mesh is one file
    held = files.read_msh(spark, path)
    n, none = F.col("nodes"), F.lit(None)
    flat = held["node"].select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), "x", "y", *[none.cast("long").alias(f"n{k}") for k in (1, 2, 3)])
    return flat.union(held["elem"].select(F.lit("elem"), "elem_id", none.cast("double"), none.cast("double"), n[0], n[1], n[2]))


@query(f"WITH {TE} SELECT elem_id, round((a.x + b.x + c.x) / 3, 6) + 0.0 AS bx, round((a.y + b.y + c.y) / 3, 6) + 0.0 AS by FROM te JOIN tn AS a ON a.node_id = n1 JOIN tn AS b ON b.node_id = n2 JOIN tn AS c ON c.node_id = n3")
def mesh_tables_back(spark, sf_dir):
    """Barycentres of a mesh that was written as two tables."""
    path = folder(spark, "mesh-tables")
    files.write_mesh(*part_mesh(spark, sf_dir), path)
    nodes, elems = files.read_mesh(spark, path)
    return mesh.barycentres(mesh.corners(elems, nodes)).select("elem_id", r(F.col("bx")).alias("bx"), r(F.col("by")).alias("by"))


CHECKPOINT = [("id", "int"), ("M_price", "double"), ("M_share", "float")]


def checkpoint(spark, sf_dir) -> str:
    path = folder(spark, "checkpoint")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("M_price"), (F.col("o_custkey") % 16 / 4).alias("M_share"))
    columns.write_columns(o, path, "id", CHECKPOINT)
    return path


_ORDERED = "o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, o_orderkey, o_totalprice, o_custkey FROM orders)"


@query(f"WITH {_ORDERED} SELECT place, o_orderkey::DOUBLE AS id, o_totalprice AS M_price, o_custkey % 16 / 4.0::DOUBLE AS M_share FROM o")
def checkpoint_back(spark, sf_dir):
    """Columns written by some tasks and read by others, put together by place."""
    long = columns.read_columns(spark, checkpoint(spark, sf_dir), CHECKPOINT, 5000)
    return columns.wide(long, [n for n, _ in CHECKPOINT])


@query("""SELECT 'id' AS name, 'int' AS type, count(*) AS size, min(o_orderkey)::DOUBLE AS least, round(max(o_orderkey), 0)::DOUBLE AS most FROM orders UNION ALL SELECT 'M_share', 'float', count(*), min(o_custkey % 16) / 4.0::DOUBLE, max(o_custkey % 16) / 4.0::DOUBLE FROM orders""")
def checkpoint_records(spark, sf_dir):
    """The text of records beside a checkpoint."""
    held = files.read_records(spark, f"{checkpoint(spark, sf_dir)}/{columns.RECORDS}")
    return held.where("name <> 'M_price'").select("name", "type", "size", "least", "most")


@query("SELECT name, type, size, least, most FROM (SELECT 'Time' AS name, 'double' AS type, count(*) AS size, min(o_orderkey % 100 / 10.0::DOUBLE) AS least, max(o_orderkey % 100 / 10.0::DOUBLE) AS most FROM orders UNION ALL SELECT 'M_price', 'float', count(*), min(o_totalprice::FLOAT)::DOUBLE, max(o_totalprice::FLOAT)::DOUBLE FROM orders)")
def field_records(spark, sf_dir):
    """Records of fields written as columns, the time in full and the others in single precision."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 100 / 10).alias("Time"), F.col("o_totalprice").alias("M_price"))
    return files.write_fields(o, folder(spark, "fields"), "o_orderkey", ["Time", "M_price"])


@query(f"WITH {TN} SELECT j AS i, i AS j, f::FLOAT::DOUBLE AS value FROM tn WHERE j BETWEEN 2 AND 6 AND (SELECT max(j) FROM tn) > 6")
def matrix_window(spark, sf_dir):
    """Some rows of a matrix that was written as flat binary rows."""
    grid = part_nodes(spark, sf_dir).select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("f").alias("value"))
    path = folder(spark, "matrix")
    files.matrix_bytes(grid, 20, "value").write.parquet(path)
    return files.window_of(spark.read.parquet(path), "<f4", 2, 5)


# -- texts -----------------------------------------------------------------------------------
@query("SELECT l_orderkey % 1000 AS i, l_linenumber AS j, l_quantity AS uwind, -l_quantity AS vwind, l_discount * 100 AS airtmp, l_suppkey * 1.0::DOUBLE AS slp, l_tax * 100 AS precip, l_partkey % 1000 * 1000.0::DOUBLE AS relhum FROM lineitem".replace("l_discount * 100", "round(l_discount * 100)").replace("l_tax * 100", "round(l_tax * 100)"))
def synoptic_text_back(spark, sf_dir):
    """Numbers of up to seven figures through a text of fixed columns."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select((F.col("l_orderkey") % 1000).cast("int").alias("i"), F.col("l_linenumber").cast("int").alias("j"), F.col("l_quantity").alias("uwind"), (-F.col("l_quantity")).alias("vwind"), F.round(F.col("l_discount") * 100).alias("airtmp"), F.col("l_suppkey").cast("double").alias("slp"), F.round(F.col("l_tax") * 100).alias("precip"), (F.col("l_partkey") % 1000 * 1000.0).alias("relhum"))
    path = folder(spark, "synoptic")
    files.synoptic_lines(rows).write.text(path)
    return files.read_synoptic(spark, path)


@query("SELECT " + ", ".join(f"(l_quantity * {k + 1} - l_linenumber * {k})::DOUBLE AS {c}" for k, c in enumerate(files.RANDOM_FIELD)) + " FROM lineitem")
def random_field_text_back(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(*[(F.col("l_quantity") * (k + 1) - F.col("l_linenumber") * k).cast("double").alias(c) for k, c in enumerate(files.RANDOM_FIELD)])
    path = folder(spark, "random-field")
    files.random_field_lines(rows).write.text(path)
    return files.read_random_field(spark, path)


DRIFTS = "SELECT date_trunc('hour', ts) AS ts, event_id AS id, event_id % 90 + 0.25::DOUBLE AS lat, user_id % 180 - 0.5::DOUBLE AS lon, user_id % 8 / 8.0::DOUBLE AS conc FROM events"


def drifts(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.date_trunc("hour", e.ts).cast("timestamp").alias("ts"), F.col("event_id").alias("drifter_id"), (F.col("event_id") % 90 + 0.25).alias("lat"), (F.col("user_id") % 180 - 0.5).alias("lon"), (F.col("user_id") % 8 / 8).alias("conc"))


@query(f"WITH d AS ({DRIFTS}) SELECT id AS BuoyID, epoch_us(ts) // 3600000000 AS hour, round(lat, 5) AS Lat, round(lon, 5) AS Lon FROM d WHERE ts = (SELECT min(ts) + INTERVAL 1 DAY FROM d)")
def buoys_of_an_hour(spark, sf_dir):
    """Drifters written as texts with a header and read as buoys, of one input time."""
    d = drifts(spark, sf_dir)
    path, first = folder(spark, "drifters"), d.agg(F.min("ts")).first()[0]
    files.drifter_text(d).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)  # one header, so one file
    rows = files.read_buoys(spark, path).withColumn("t", F.col("ts"))
    own = drifters.buoys_at(rows, F.lit(first) + F.expr("INTERVAL 1 DAY"))
    return own.select("BuoyID", F.floor(timeconv.micros(F.col("ts")) / 3_600_000_000).alias("hour"), F.round("Lat", 5).alias("Lat"), F.round("Lon", 5).alias("Lon"))


@query(f"WITH d AS ({DRIFTS}), m AS (SELECT min(ts) + INTERVAL 10 DAY AS cut FROM d) SELECT id AS drifter_id, round(epoch_us(ts) / 86400000000.0::DOUBLE + 25567, 6) AS time, lat, lon, conc AS sic FROM d")
def drifter_records_after_restart(spark, sf_dir):
    """Records appended by a run, cut where a second one begins again, and appended by it: each once."""
    d = drifts(spark, sf_dir)
    cut = d.agg(F.min("ts")).first()[0]
    at = F.lit(cut) + F.expr("INTERVAL 10 DAY")
    first = d.where(F.col("ts") < F.lit(cut) + F.expr("INTERVAL 15 DAY"))
    path = folder(spark, "drifter-records")
    files.append_drifters(files.records_before(first, at), path)
    files.append_drifters(d.where(F.col("ts") >= at), path)
    return spark.read.parquet(path).select("drifter_id", r(F.col("time")).alias("time"), "lat", "lon", "sic")


@query("""WITH m AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 3 HOUR AS mid, event_type, avg(value) AS mean FROM events GROUP BY ALL)
SELECT printf('%04dd%03d', year(mid), dayofyear(mid)) AS period, event_type, round(epoch_us(mid) / 86400000000.0::DOUBLE + 25567, 6) AS time, round(epoch_us(mid) / 86400000000.0::DOUBLE + 25567 - 0.125, 6) AS bound0, round(epoch_us(mid) / 86400000000.0::DOUBLE + 25567 + 0.125, 6) AS bound1, round(mean, 7) AS mean FROM m""")
def grid_means_back(spark, sf_dir):
    """Means of six hours with their time bounds, in a folder for each day."""
    e = table(spark, sf_dir, "events")
    m = gridmean.window_mean(e, F.col("ts"), "6 hours", ["event_type"], F.col("value"))
    path = folder(spark, "grid-means")
    _, spec = files.map_spec({"map reference longitude": "-45", "map second reference latitude": "60"})
    held = files.with_projection(m.withColumn("at", F.col("window_start").cast("timestamp") + F.expr("INTERVAL 3 HOUR")), "mean", "polar_stereographic", spec)
    files.write_grid_means(held.select("at", "event_type", "mean"), path, F.col("at"), "daily", 0.25)
    return spark.read.parquet(path).select("period", "event_type", *[r(F.col(c)).alias(c) for c in ("time", "bound0", "bound1")], r(F.col("mean"), 7).alias("mean"))


# -- the catalogue ---------------------------------------------------------------------------
@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y/topaz_rean_%Y%m.nc') AS file, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y/topaz_rean_%Y%m.nc') AS before, round((o_orderkey * 7 + 12) / 24.0::DOUBLE + 18262, 6) AS days FROM orders""")
def dataset_files(spark, sf_dir):
    """The file of a dataset that holds each order's day, the one before it, and a decoded time."""
    d = catalog.dataset("topaz4r_nodes")
    o = table(spark, sf_dir, "orders")
    day = o.o_orderdate.cast("date")
    return o.select("o_orderkey", d.path_of(day).alias("file"), d.path_of(timeconv.shift_date(day, d.frequency, -1)).alias("before"), r(d.days(o.o_orderkey * 7)).alias("days"))


@query("""WITH n AS (SELECT count(*) AS n FROM supplier), g AS (SELECT n_nationkey AS i, s_suppkey AS j, 250 + (n_nationkey * 3 + s_suppkey * 5) % 17 - 273.15::DOUBLE AS v FROM supplier, nation), p AS (SELECT c_custkey, c_custkey * 37 % 3600 / 10.0::DOUBLE AS px, c_custkey * 11 % (144 * (n - 1)) / 10.0::DOUBLE AS py FROM customer, n),
c AS (SELECT *, floor(px / 14.4::DOUBLE)::BIGINT AS i, floor(py / 14.4::DOUBLE)::BIGINT AS j FROM p), d AS (SELECT *, px / 14.4::DOUBLE - i AS dx, py / 14.4::DOUBLE - j AS dy FROM c)
SELECT c_custkey, round(a.v * (1 - dx) * (1 - dy) + b.v * dx * (1 - dy) + e.v * (1 - dx) * dy + f.v * dx * dy, 5) + 0.0 AS tair FROM d JOIN g AS a ON a.i = d.i AND a.j = d.j JOIN g AS b ON b.i = (d.i + 1) % 25 AND b.j = d.j JOIN g AS e ON e.i = d.i AND e.j = d.j + 1 JOIN g AS f ON f.i = (d.i + 1) % 25 AND f.j = d.j + 1""")
def dataset_at_places(spark, sf_dir):
    """A dataset that goes around the globe, at customers' places, by its own method and units."""
    d = catalog.dataset("ERA5_elements")
    rows = table(spark, sf_dir, "supplier").count()
    g = geographic(spark, sf_dir).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), (250.0 + (F.col("i") * 3 + F.col("j") * 5) % 17).alias("t2m"))
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k, (k * 37 % 3600 / 10).alias("px"), (k * 11 % (144 * (rows - 1)) / 10).alias("py"))
    out = d.sampled(p, d.select(g, ["i", "j"]), (0.0, 0.0), 14.4, (25, rows), "tair")
    return out.select("c_custkey", r(F.col("tair"), 5).alias("tair"))


# -- times, shapes, curves -------------------------------------------------------------------
@query("""SELECT event_id, epoch_us(date_trunc('second', ts)) // 1000000 AS stamp, epoch_us(date_trunc('day', ts)) // 1000000 AS day, NULL::BIGINT AS other, round(epoch_us(date_trunc('second', ts)) / 86400000000.0::DOUBLE + 25567, 6) AS days FROM events""")
def times_of_texts(spark, sf_dir):
    """Texts of times, with and without a time of day, read back; other texts are null."""
    e = table(spark, sf_dir, "events")
    text = timeconv.to_text(e.ts.cast("timestamp"))
    stamp, day, other = timeconv.from_text(text), timeconv.from_text(F.substring(text, 1, 10)), timeconv.from_text(F.concat(F.lit("at "), text))
    seconds = lambda c: F.floor(timeconv.micros(c) / 1_000_000)
    return e.select("event_id", seconds(stamp).alias("stamp"), seconds(day).alias("day"), seconds(other).alias("other"), r(timeconv.datenum(stamp)).alias("days"))


@query("""WITH q AS (SELECT p_partkey, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS y1, 4 + p_size % 5 * 1.0::DOUBLE AS x2, p_size % 3 * 1.0::DOUBLE AS y2, 5 + p_size % 2 * 1.0::DOUBLE AS x3, 6 + p_size % 4 * 1.0::DOUBLE AS y3, -1.0::DOUBLE AS x4, 4 + p_size % 7 * 0.25::DOUBLE AS y4, p_partkey % 13 / 2.0::DOUBLE + 0.1371::DOUBLE AS px, p_partkey % 17 / 2.0::DOUBLE + 0.0713::DOUBLE AS py FROM part),
s AS (SELECT *, unnest([[x1, y1, x2, y2], [x2, y2, x3, y3], [x3, y3, x4, y4], [x4, y4, x1, y1]]) AS e FROM q),
f AS (SELECT p_partkey, sum(e[1] * e[4] - e[3] * e[2]) / 2 AS area, min((e[3] - e[1]) * (py - e[2]) - (e[4] - e[2]) * (px - e[1])) AS side, count(*) FILTER (d <> 0 AND t > 0 AND t < 1 AND u > 0 AND u < 1) AS met FROM (SELECT *, (10 * (e[4] - e[2]) - 10 * (e[3] - e[1])) AS d, (((e[1] - px) * (e[4] - e[2]) - (e[2] - py) * (e[3] - e[1])) / nullif(10 * (e[4] - e[2]) - 10 * (e[3] - e[1]), 0)) AS t,
(((e[1] - px) * 10 - (e[2] - py) * 10) / nullif(10 * (e[4] - e[2]) - 10 * (e[3] - e[1]), 0)) AS u FROM s) GROUP BY p_partkey) SELECT p_partkey, round(abs(area), 6) AS area, side >= -1e-8 AS inside, met, true AS turned FROM f""")
def polygons(spark, sf_dir):
    """Area, inside test and crossings of four-cornered cells whose corners come in any order and are sorted about their middle."""
    size, k = F.col("p_size"), F.col("p_partkey")
    xy = [(F.lit(0.0), F.lit(0.0)), (4 + size % 5 * 1.0, size % 3 * 1.0), (5 + size % 2 * 1.0, 6 + size % 4 * 1.0), (F.lit(-1.0), 4 + size % 7 * 0.25)]
    shuffled = F.array(*[F.struct(xy[n][0].alias("x"), xy[n][1].alias("y")) for n in (2, 0, 3, 1)])
    p = table(spark, sf_dir, "part").select(k, geometry.clockwise(shuffled).alias("c"), (k % 13 / 2 + 0.1371).alias("px"), (k % 17 / 2 + 0.0713).alias("py"))
    c, n = F.col("c"), F.lit(4)
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    signed = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + cross(F.get(c, i), F.get(c, (i + 1) % n)))
    met = F.size(geometry.crossings(F.col("px"), F.col("py"), F.col("px") + 10, F.col("py") + 10, c)).cast("long")
    return p.select("p_partkey", r(geometry.polygon_area(c)).alias("area"), geometry.in_convex(F.col("px"), F.col("py"), c).alias("inside"), met.alias("met"), (signed < 0).alias("turned"))


@query(f"""WITH p AS (SELECT *, px / 50 AS t, py / 50 AS s FROM ({POINTS}))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(3 + t * 2 - s * 1.5 + t * t * 0.5 + t * s * 0.25 - s * s * t + t * t * s * s * 0.125, 5) + 0.0 AS v FROM p""")
def lagrange_surface(spark, sf_dir):
    """A surface of nine values by Lagrange polynomials both ways; the SQL has the polynomial that the values are of."""
    f = lambda t, s: 3 + t * 2 - s * 1.5 + t * t * 0.5 + t * s * 0.25 - s * s * t + t * t * s * s * 0.125
    p = points(spark, sf_dir)
    v = geometry.lagrange2d([0.0, 1.0, 2.0], [0.0, 1.0, 2.0], [[f(a, b) for b in (0.0, 1.0, 2.0)] for a in (0.0, 1.0, 2.0)], p.px / 50, p.py / 50)
    return p.select(*KEY, r(v, 5).alias("v"))


_E2 = geodesy.ECC**2


def _q(phi: str) -> str:
    return f"({1 - _E2!r} * (sin({phi}) / (1 - {_E2!r} * pow(sin({phi}), 2)) - 1 / {2 * geodesy.ECC!r} * ln((1 - {geodesy.ECC!r} * sin({phi})) / (1 + {geodesy.ECC!r} * sin({phi})))))"


_m40 = math.cos(math.radians(40)) / math.sqrt(1 - _E2 * math.sin(math.radians(40)) ** 2)


@query(f"SELECT c_custkey, round({geodesy.RADIUS * _m40!r} * radians(lon - 10), 3) + 0.0 AS x, round({geodesy.RADIUS / 2 / _m40!r} * {_q('radians(lat)')}, 3) + 0.0 AS y FROM ({PLACES})")
def proj_cylindrical_equal_area_ellipsoid(spark, sf_dir):
    p = places(spark, sf_dir)
    x, y = geodesy.forward("cylindrical_equal_area_ellipsoid", p.lat, p.lon, geodesy.MapSpec(lon0=10.0, lat1=40.0))
    return p.select("c_custkey", r(x, 3).alias("x"), r(y, 3).alias("y"))


_QP = f"{_q('(pi() / 2)')}"
_B0, _BETA = f"asin({_q('radians(50)')} / {_QP})", f"asin(greatest(-1, least(1, {_q('radians(lat)')} / {_QP})))"
_M50 = math.cos(math.radians(50)) / math.sqrt(1 - _E2 * math.sin(math.radians(50)) ** 2)


@query(f"""WITH b AS (SELECT c_custkey, radians(lon - 10) AS lam, {_B0} AS b0, {_BETA} AS b, {geodesy.RADIUS!r} * sqrt({_QP} / 2) AS rq FROM ({PLACES})), k AS (SELECT *, rq * sqrt(2 / (1 + sin(b0) * sin(b) + cos(b0) * cos(b) * cos(lam))) AS k, {geodesy.RADIUS * _M50!r} / (rq * cos(b0)) AS d FROM b)
SELECT c_custkey, round(k * d * cos(b) * sin(lam), 3) + 0.0 AS x, round(k / d * (cos(b0) * sin(b) - sin(b0) * cos(b) * cos(lam)), 3) + 0.0 AS y FROM k""")
def proj_azimuthal_equal_area_ellipsoid(spark, sf_dir):
    p = places(spark, sf_dir)
    x, y = geodesy.forward("azimuthal_equal_area_ellipsoid", p.lat, p.lon, geodesy.MapSpec(lon0=10.0, lat0=50.0))
    return p.select("c_custkey", r(x, 3).alias("x"), r(y, 3).alias("y"))


def _mq(d: float) -> tuple[float, float]:
    s = math.sin(math.radians(d))
    return math.cos(math.radians(d)) / math.sqrt(1 - _E2 * s * s), (1 - _E2) * (s / (1 - _E2 * s * s) - 1 / (2 * geodesy.ECC) * math.log((1 - geodesy.ECC * s) / (1 + geodesy.ECC * s)))


_ma, _qa = _mq(30.0)
_mb, _qb = _mq(60.0)
_an = (_ma * _ma - _mb * _mb) / (_qb - _qa)
_ac = _ma * _ma + _an * _qa
_a0 = geodesy.RADIUS * math.sqrt(_ac - _an * _mq(50.0)[1]) / _an


@query(f"""WITH p AS (SELECT c_custkey, {_an!r} * radians(lon - 10) AS t, {geodesy.RADIUS!r} * sqrt({_ac!r} - {_an!r} * {_q('radians(lat)')}) / {_an!r} AS rho FROM ({PLACES}))
SELECT c_custkey, round(rho * sin(t), 3) + 0.0 AS x, round({_a0!r} - rho * cos(t), 3) + 0.0 AS y FROM p""")
def proj_albers_ellipsoid(spark, sf_dir):
    p = places(spark, sf_dir)
    x, y = geodesy.forward("albers_ellipsoid", p.lat, p.lon, geodesy.MapSpec(lon0=10.0, lat0=50.0, lat1=30.0, lat2=60.0))
    return p.select("c_custkey", r(x, 3).alias("x"), r(y, 3).alias("y"))


@query(f"SELECT c_custkey, round(lat, 5) AS lat, round(lon, 5) + 0.0 AS lon FROM ({PLACES})")
def inverse_azimuthal_equal_area_oblique(spark, sf_dir):
    """Forward and back about a centre that isn't a pole."""
    p = places(spark, sf_dir)
    m = geodesy.MapSpec(lon0=10.0, lat0=50.0)
    x, y = geodesy.forward("azimuthal_equal_area_ellipsoid", p.lat, p.lon, m)
    p = p.withColumns({"x": x, "y": y})
    lat, lon = geodesy.inverse("azimuthal_equal_area_ellipsoid", p.x, p.y, m)
    return p.select("c_custkey", r(lat, 5).alias("lat"), r(lon, 5).alias("lon"))
