"""Queries over the driver tables, each with the SQL that gives the same rows.

Positions come from keys, so that any engine can derive them: see ``places`` and
``points``.  Rounding is in both, since sums may be taken in any order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.functions import geodesy, geometry, spectral, timeconv
from gyre.operators import advection, asof, drifters, fields, gridmean, locate, mesh, noise, remap

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, n: int = 6):
    """Rounded, without a negative zero."""
    return F.round(c, n) + F.lit(0.0)


def places(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k, (40 + (k * 7919 % 5000) / 100).alias("lat"), ((k * 104729 % 36000) / 100 - 180).alias("lon"), "c_acctbal", "c_nationkey")


PLACES = "SELECT c_custkey, 40 + (c_custkey * 7919 % 5000) / 100.0::DOUBLE AS lat, (c_custkey * 104729 % 36000) / 100.0::DOUBLE - 180 AS lon, c_acctbal, c_nationkey FROM customer"
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def points(spark, sf_dir) -> DataFrame:
    """Line items as points of [0, 100) x [0, 100), in tenths."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(*KEY, "l_quantity", "l_discount", "l_tax", "l_extendedprice", (F.col("l_partkey") * 37 % 1000).alias("xi"), ((F.col("l_suppkey") * 53 + F.col("l_linenumber") * 7) % 1000).alias("yi")).withColumns({"px": F.col("xi") / 10.0, "py": F.col("yi") / 10.0})


POINTS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice, l_partkey * 37 % 1000 AS xi, (l_suppkey * 53 + l_linenumber * 7) % 1000 AS yi, (l_partkey * 37 % 1000) / 10.0::DOUBLE AS px, ((l_suppkey * 53 + l_linenumber * 7) % 1000) / 10.0::DOUBLE AS py FROM lineitem"
NX = 20
NODE_VALUE = "(i * 5 * 0.5 + j * 5 * 0.25 + (j * 21 + i + 1) % 7)"


def the_mesh(spark) -> tuple[DataFrame, DataFrame]:
    nodes, elems = mesh.lattice(spark, NX, NX, 5.0)
    return nodes.withColumn("f", F.col("x") * 0.5 + F.col("y") * 0.25 + F.col("node_id") % 7), elems


def located(spark, sf_dir) -> DataFrame:
    nodes, elems = the_mesh(spark)
    at = mesh.corners(elems, nodes, "f")
    return locate.in_triangles(points(spark, sf_dir), at, 5.0, ["f1", "f2", "f3"])


NODES_SQL = "nodes AS (SELECT j * 21 + i + 1 AS node_id, i * 5.0::DOUBLE AS x, j * 5.0::DOUBLE AS y, i, j FROM range(21) AS a(i), range(21) AS b(j))"
ELEMS_SQL = """cells AS (SELECT i, j, j * 20 + i AS c, j * 21 + i + 1 AS a FROM range(20) AS x(i), range(20) AS y(j)),
elems AS (SELECT 2 * c + 1 AS elem_id, a AS n1, a + 1 AS n2, a + 22 AS n3 FROM cells UNION ALL SELECT 2 * c + 2, a, a + 22, a + 21 FROM cells)"""
LOCATED_SQL = f"""
p AS (SELECT *, xi // 50 AS ci, yi // 50 AS cj, xi % 50 AS dx, yi % 50 AS dy FROM ({POINTS})),
q AS (SELECT *, 2 * (cj * 20 + ci) + CASE WHEN dy >= dx THEN 2 ELSE 1 END AS elem_id, cj * 21 + ci + 1 AS a FROM p)"""


# -- map projections -------------------------------------------------------------------------
NPS = geodesy.MapSpec(lat0=90, lon0=-45, lat1=60)
_e, _r, _p1 = geodesy.ECC, geodesy.RADIUS, math.radians(60)
_t1 = math.tan(math.pi / 4 - _p1 / 2) / ((1 - _e * math.sin(_p1)) / (1 + _e * math.sin(_p1))) ** (_e / 2)
_k = _r * math.cos(_p1) / math.sqrt(1 - (_e * math.sin(_p1)) ** 2) / _t1
RHO = f"({_k!r} * tan(pi() / 4 - radians(lat) / 2) / pow((1 - {_e!r} * sin(radians(lat))) / (1 + {_e!r} * sin(radians(lat))), {_e / 2!r}))"


@query(f"SELECT c_custkey, round({RHO} * sin(radians(lon + 45)), 3) + 0.0 AS x, round(-{RHO} * cos(radians(lon + 45)), 3) + 0.0 AS y FROM ({PLACES})")
def proj_forward(spark, sf_dir):
    p = places(spark, sf_dir)
    x, y = geodesy.forward("polar_stereographic", p.lat, p.lon, NPS)
    return p.select("c_custkey", r(x, 3).alias("x"), r(y, 3).alias("y"))


@query(f"SELECT c_custkey, round(lat, 5) AS lat, round(CASE WHEN lon = 180 THEN -180 ELSE lon END, 5) AS lon FROM ({PLACES})")
def proj_inverse(spark, sf_dir):
    """Forward and back again gives the places."""
    p = places(spark, sf_dir)
    x, y = geodesy.forward("polar_stereographic", p.lat, p.lon, NPS)
    lat, lon = geodesy.inverse("polar_stereographic", x, y, NPS)
    lon = F.round(lon, 5) + 0.0
    return p.select("c_custkey", F.round(lat, 5).alias("lat"), F.when(lon == 180, -180.0).otherwise(lon).alias("lon"))


@query(f"""WITH q AS (SELECT c_custkey, {RHO} * sin(radians(lon + 45)) AS x, -{RHO} * cos(radians(lon + 45)) AS y FROM ({PLACES}))
SELECT c_custkey, round((x * cos(radians(30)) + y * sin(radians(30))) / 12.5, 3) + 0.0 AS x, round((y * cos(radians(30)) - x * sin(radians(30))) / 12.5, 3) + 0.0 AS y FROM q""")
def proj_rotated(spark, sf_dir):
    p = places(spark, sf_dir)
    x, y = geodesy.forward("polar_stereographic", p.lat, p.lon, geodesy.MapSpec(lat0=90, lon0=-45, lat1=60, rotation=30, scale=12.5))
    return p.select("c_custkey", r(x, 3).alias("x"), r(y, 3).alias("y"))


def _family(name: str, x: str, y: str, **spec):
    spec = geodesy.MapSpec(**({"lon0": 10, "lat0": 50, "lat1": 30, "radius": 6371.0} | spec))

    def run(spark, sf_dir):
        p = places(spark, sf_dir)
        a, b = geodesy.forward(name, p.lat, p.lon, spec)
        return p.select("c_custkey", r(a, 3).alias("x"), r(b, 3).alias("y"))

    run.__name__ = f"proj_{name}"
    lam, phi = "radians(lon - 10)", "radians(lat)"
    sub = lambda s: s.replace("LAM", lam).replace("PHI", phi).replace("P0", "radians(50)").replace("R", "6371.0") if s else s
    query(f"SELECT c_custkey, round({sub(x)}, 3) + 0.0 AS x, round({sub(y)}, 3) + 0.0 AS y FROM ({PLACES})")(run)


_near = "CASE WHEN sin(P0) * sin(PHI) + cos(P0) * cos(PHI) * cos(LAM) >= 0 THEN {} END"
_family("cylindrical_equal_area", "R * cos(radians(30)) * LAM", "R * sin(PHI) / cos(radians(30))")
_family("cylindrical_equidistant", "R * cos(radians(30)) * LAM", "R * PHI")
_family("mercator", "R * LAM", "R * ln(tan(pi() / 4 + PHI / 2))")
_family("sinusoidal", "R * LAM * cos(PHI)", "R * PHI")
_family("polar_stereographic_sphere", "R * (1 + sin(radians(30))) * tan(pi() / 4 - PHI / 2) * sin(LAM)", "-R * (1 + sin(radians(30))) * tan(pi() / 4 - PHI / 2) * cos(LAM)")
_family("azimuthal_equal_area", "R * sqrt(2 / (1 + sin(P0) * sin(PHI) + cos(P0) * cos(PHI) * cos(LAM))) * cos(PHI) * sin(LAM)", "R * sqrt(2 / (1 + sin(P0) * sin(PHI) + cos(P0) * cos(PHI) * cos(LAM))) * (cos(P0) * sin(PHI) - sin(P0) * cos(PHI) * cos(LAM))")
_family("orthographic", _near.format("R * cos(PHI) * sin(LAM)"), _near.format("R * (cos(P0) * sin(PHI) - sin(P0) * cos(PHI) * cos(LAM))"))
_family("transverse_mercator", "0.5 * R * ln((1 + cos(PHI) * sin(LAM)) / (1 - cos(PHI) * sin(LAM)))", "R * (atan2(tan(PHI), cos(LAM)) - P0)")
_n = (math.sin(math.radians(30)) + math.sin(math.radians(60))) / 2
_c = math.cos(math.radians(30)) ** 2 + 2 * _n * math.sin(math.radians(30))
_family("albers", f"R * sqrt({_c!r} - 2 * {_n!r} * sin(PHI)) / {_n!r} * sin({_n!r} * LAM)", f"R * sqrt({_c!r} - 2 * {_n!r} * sin(P0)) / {_n!r} - R * sqrt({_c!r} - 2 * {_n!r} * sin(PHI)) / {_n!r} * cos({_n!r} * LAM)", lat2=60)


def _roundtrip(name: str, **more):
    """Forward and back again gives all places."""
    spec = geodesy.MapSpec(**({"lon0": 10.0, "lat1": 40.0} | more))

    def run(spark, sf_dir):
        p = places(spark, sf_dir)
        x, y = geodesy.forward(name, p.lat, p.lon, spec)
        p = p.withColumns({"x": x, "y": y})  # held, or the inverse would repeat it wherever it reads it
        lat, lon = geodesy.inverse(name, p.x, p.y, spec)
        return p.select("c_custkey", r(lat, 5).alias("lat"), r(lon, 5).alias("lon"))

    run.__name__ = f"inverse_{name}"
    query(f"SELECT c_custkey, round(lat, 5) AS lat, round(lon, 5) + 0.0 AS lon FROM ({PLACES})")(run)


for _name in ("polar_stereographic_sphere", "azimuthal_equal_area_ellipsoid", "cylindrical_equal_area", "cylindrical_equal_area_ellipsoid", "cylindrical_equidistant", "mercator", "mollweide", "sinusoidal", "integerized_sinusoidal"):
    _roundtrip(_name)
for _name in ("albers", "albers_ellipsoid", "lambert_conformal", "azimuthal_equal_area"):
    _roundtrip(_name, lat0=50.0, lat2=60.0)
_roundtrip("transverse_mercator", lat0=50.0)
_roundtrip("orthographic", lat0=60.0)


_ue = 0.0818191908426215**2
_uc = (1 - _ue / 4 - 3 * _ue**2 / 64 - 5 * _ue**3 / 256, 3 * _ue / 8 + 3 * _ue**2 / 32 + 45 * _ue**3 / 1024, 15 * _ue**2 / 256 + 45 * _ue**3 / 1024, 35 * _ue**3 / 3072)


@query(f"""WITH p AS (SELECT c_custkey, radians(lat) AS p, lat, lon, floor((lon + 180) / 6)::INT % 60 + 1 AS zone FROM (SELECT c_custkey, CASE WHEN lat < 84 THEN lat END AS lat, lon FROM ({PLACES}))),
s AS (SELECT *, 6378.137 / sqrt(1 - {_ue!r} * pow(sin(p), 2)) AS n, pow(tan(p), 2) AS t, {_ue / (1 - _ue)!r} * pow(cos(p), 2) AS c, cos(p) * radians(lon - (zone * 6 - 183)) AS a,
6378.137 * ({_uc[0]!r} * p - {_uc[1]!r} * sin(2 * p) + {_uc[2]!r} * sin(4 * p) - {_uc[3]!r} * sin(6 * p)) AS m FROM p)
SELECT c_custkey, zone, round(500 + 0.9996 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {_ue / (1 - _ue)!r}) * pow(a, 5) / 120), 3) + 0.0 AS x,
round(0.9996 * (m + n * tan(p) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {_ue / (1 - _ue)!r}) * pow(a, 6) / 720)), 3) + 0.0 AS y FROM s""")
def proj_utm(spark, sf_dir):
    p = places(spark, sf_dir).withColumn("lat", F.expr("CASE WHEN lat < 84 THEN lat END"))  # beyond, the zones end: null
    z, x, y = geodesy.utm(p.lat, p.lon)
    return p.select("c_custkey", z.alias("zone"), r(x, 3).alias("x"), r(y, 3).alias("y"))


def halved(rows: str) -> str:
    """SQL that solves theta + sin(theta) = pi sin(lat) by halving an interval, for half of theta ``h``; Spark's side takes Newton's steps."""
    mid = "(lo + hi) / 2 + sin((lo + hi) / 2) < pi() * sin(radians(lat))"
    return f"""WITH RECURSIVE rows AS ({rows}), cut AS (SELECT 0 AS k, *, -pi() AS lo, pi() AS hi FROM rows UNION ALL
SELECT k + 1, * EXCLUDE (k, lo, hi), CASE WHEN {mid} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {mid} THEN hi ELSE (lo + hi) / 2 END FROM cut WHERE k < 60), t AS (SELECT *, (lo + hi) / 4 AS h FROM cut WHERE k = 60)"""


@query(f"""{halved(f"SELECT c_custkey, lat, lon, CASE WHEN lon < -40 THEN -100 ELSE 30 END AS mid FROM ({PLACES}) UNION ALL SELECT NULL, 40.736666666666665::DOUBLE, 0, 0")},
seam AS (SELECT sqrt(2) * sin(h) - radians(lat) AS gap FROM t WHERE c_custkey IS NULL)
SELECT c_custkey, round(6371.0 * (radians(mid) + radians(lon - mid) * CASE WHEN lat <= 40.736666666666665::DOUBLE THEN cos(radians(lat)) ELSE 2 * sqrt(2) / pi() * cos(h) END), 3) + 0.0 AS x,
round(6371.0 * CASE WHEN lat <= 40.736666666666665::DOUBLE THEN radians(lat) ELSE sqrt(2) * sin(h) - gap END, 3) + 0.0 AS y FROM t, seam WHERE c_custkey IS NOT NULL""")
def proj_homolosine(spark, sf_dir):
    p = places(spark, sf_dir)
    x, y = geodesy.forward("homolosine", p.lat, p.lon, geodesy.MapSpec(lon0=0.0, radius=6371.0))
    return p.select("c_custkey", r(x, 3).alias("x"), r(y, 3).alias("y"))


@query(f"""WITH p AS (SELECT c_custkey, lat, lon, floor((90 - lat) / 180 * 1080) AS n FROM ({PLACES}))
SELECT c_custkey, round(6371.0 * radians(lon) * 2 * floor(1080 * cos(radians(90 - (n + 0.5) * 180 / 1080.0::DOUBLE)) + 0.5) / 2160, 3) + 0.0 AS x, round(6371.0 * radians(lat), 3) AS y FROM p""")
def proj_integerized_sinusoidal(spark, sf_dir):
    p = places(spark, sf_dir)
    x, y = geodesy.forward("integerized_sinusoidal", p.lat, p.lon, geodesy.MapSpec(lon0=0.0, radius=6371.0))
    return p.select("c_custkey", r(x, 3).alias("x"), r(y, 3).alias("y"))


@query(f"""{halved(PLACES)} SELECT c_custkey, round(6371.0 * 2 * sqrt(2) / pi() * radians(lon - 10) * cos(h), 3) + 0.0 AS x, round(6371.0 * sqrt(2) * sin(h), 3) + 0.0 AS y FROM t""")
def proj_mollweide(spark, sf_dir):
    p = places(spark, sf_dir)
    a, b = geodesy.forward("mollweide", p.lat, p.lon, geodesy.MapSpec(lon0=10, radius=6371.0))
    return p.select("c_custkey", r(a, 3).alias("x"), r(b, 3).alias("y"))


_lt = lambda d: math.tan(math.pi / 4 - math.radians(d) / 2) / ((1 - _e * math.sin(math.radians(d))) / (1 + _e * math.sin(math.radians(d)))) ** (_e / 2)
_lm = lambda d: math.cos(math.radians(d)) / math.sqrt(1 - (_e * math.sin(math.radians(d))) ** 2)
_ln = math.log(_lm(50) / _lm(70)) / math.log(_lt(50) / _lt(70))
_lf = _r * _lm(50) / (_ln * _lt(50) ** _ln)


@query(f"""WITH p AS (SELECT c_custkey, radians(lat) AS p, {_ln!r} * radians(lon - 10) AS a FROM ({PLACES})), s AS (SELECT *, {_lf!r} * pow(tan(pi() / 4 - p / 2) / pow((1 - {_e!r} * sin(p)) / (1 + {_e!r} * sin(p)), {_e / 2!r}), {_ln!r}) AS rho FROM p)
SELECT c_custkey, round(rho * sin(a), 3) + 0.0 AS x, round({_lf * _lt(40) ** _ln!r} - rho * cos(a), 3) + 0.0 AS y FROM s""")
def proj_lambert_conformal(spark, sf_dir):
    p = places(spark, sf_dir)
    a, b = geodesy.forward("lambert_conformal", p.lat, p.lon, geodesy.MapSpec(lon0=10, lat0=40, lat1=50, lat2=70))
    return p.select("c_custkey", r(a, 3).alias("x"), r(b, 3).alias("y"))


@query(f"SELECT c_custkey, CASE WHEN lon = 180 THEN lon ELSE round(lon - floor((lon + 180) / 360) * 360, 6) END AS closed, round(lon - floor(lon / 360) * 360, 6) AS half_open FROM ({PLACES})")
def angle_wrap(spark, sf_dir):
    p = places(spark, sf_dir)
    return p.select("c_custkey", r(geodesy.wrap_closed(p.lon, -180.0)).alias("closed"), r(geodesy.wrap(p.lon, 0.0)).alias("half_open"))


@query(f"SELECT c_custkey, round(2 * 6371.228 * asin(least(1.0, sqrt(pow(sin(radians(90 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(90)) * pow(sin(radians(0 - lon) / 2), 2)))), 3) AS to_pole, lat BETWEEN 60 AND 80 AND (lon >= 150 OR lon <= -150) AS inside, (floor((lon + 180) / 6) + 1)::INT AS zone FROM ({PLACES})")
def distance_and_bounds(spark, sf_dir):
    p = places(spark, sf_dir)
    return p.select("c_custkey", r(geodesy.dist_km(p.lat, p.lon, F.lit(90.0), F.lit(0.0)), 3).alias("to_pole"), geodesy.within(p.lat, p.lon, 60, 80, 150, -150).alias("inside"), geodesy.utm_zone(p.lon).alias("zone"))


@query(f"""WITH q AS (SELECT c_custkey, 50 + {RHO} * sin(radians(lon + 45)) / 100 AS c, 60 + {RHO} * cos(radians(lon + 45)) / 100 AS s FROM ({PLACES}))
SELECT c_custkey, CASE WHEN ok THEN round(c, 4) END AS col, CASE WHEN ok THEN round(s, 4) END AS row FROM (SELECT *, c >= -0.5 AND c < 99.5 AND s >= -0.5 AND s < 119.5 AS ok FROM q)""")
def grid_cell_of_place(spark, sf_dir):
    p = places(spark, sf_dir)
    x, y = geodesy.forward("polar_stereographic", p.lat, p.lon, NPS)
    c, s = geodesy.grid_forward(x, y, (50, 60), 0.01, (120, 100))
    return p.select("c_custkey", r(c, 4).alias("col"), r(s, 4).alias("row"))


# -- time ------------------------------------------------------------------------------------
@query("SELECT o_orderkey, round(epoch_us(o_orderdate) / 86400000000.0::DOUBLE + 25567, 6) AS days FROM orders")
def datenum(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", r(timeconv.datenum(o.o_orderdate)).alias("days"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, (epoch_us(ts) // 1000 % 86400000)::BIGINT AS ms, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events")
def datenum_roundtrip(spark, sf_dir):
    """Times through decimal days and back."""
    e = table(spark, sf_dir, "events")
    days = timeconv.datenum(F.timestamp_millis(F.floor(timeconv.micros(e.ts) / 1000)))
    back = timeconv.from_datenum(days)
    return e.select("event_id", timeconv.parse_date(days).cast("string").alias("day"), timeconv.parse_time_ms(days).alias("ms"), timeconv.filename_stamp(back).alias("stamp"), timeconv.to_text(back).alias("text"))


@query("""SELECT o_orderkey, printf('%04dw%02d', isoyear(o_orderdate), weekofyear(o_orderdate)) AS week, printf('%04dd%03d', year(o_orderdate), dayofyear(o_orderdate)) AS day,
strftime(o_orderdate, '%Ym%m') AS month, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_file FROM orders""")
def period_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = lambda kind: timeconv.period_key(o.o_orderdate, kind)
    return o.select("o_orderkey", k("weekly").alias("week"), k("daily").alias("day"), k("monthly").alias("month"), timeconv.shift_date(o.o_orderdate.cast("date"), "monthly", 1).cast("string").alias("next_file"))


@query("SELECT isoyear(o_orderdate)::INT AS iso_year, weekofyear(o_orderdate)::INT AS week, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def iso_week_total(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.extract(F.lit("YEAROFWEEK"), o.o_orderdate).cast("int").alias("iso_year"), F.weekofyear(o.o_orderdate).alias("week")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# -- units, masks, sets ----------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity * 0.01 + 250) * 1.0 - 273.15, 6) AS tair, CASE WHEN l_discount = 0 THEN 0.0 ELSE l_tax END AS filled, greatest(0.01, least(0.05, l_tax)) AS clipped FROM lineitem")
def unit_transform(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    nan = F.when(li.l_discount == 0, F.lit(float("nan"))).otherwise(li.l_tax)
    return li.select(*KEY, r(fields.unit_transform(li.l_quantity, 0.01, 250.0, 1.0, -273.15)).alias("tair"), fields.nan_to_zero(nan).alias("filled"), fields.clip(li.l_tax, 0.01, 0.05).alias("clipped"))


@query(f"""WITH p AS (SELECT min(lat) + 5 AS lo, max(lat) - 5 AS hi FROM ({PLACES})), ax AS (SELECT i, 30 + i * 0.5::DOUBLE AS lat FROM range(140) AS t(i)),
b AS (SELECT min(i) AS a, max(i) AS b FROM ax, p WHERE lat BETWEEN lo AND hi) SELECT i, lat FROM ax, b WHERE i BETWEEN a - 2 AND b + 2""")
def bbox_halo_crop(spark, sf_dir):
    box = fields.bounding_box(places(spark, sf_dir), "lat", "lon").first()  # four numbers
    axis = spark.range(140).select(F.col("id").alias("i"), (30 + F.col("id") * 0.5).alias("lat"))
    return fields.crop(axis, "i", "lat", box.x0 + 5, box.x1 - 5, halo=2)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount <= 0.02 THEN 0.0 ELSE l_extendedprice END AS masked, CASE WHEN l_quantity > 10 THEN l_extendedprice ELSE -1e14 END AS sea, CASE WHEN l_tax < 0.03 THEN 0.0 ELSE l_quantity END AS ice FROM lineitem WHERE l_tax NOT IN (0.01, 0.08)")
def wet_ice_land_masks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(fields.is_wet(F.col("l_tax"), 0.01, 0.08))
    return li.select(*KEY, fields.ice_mask(li.l_extendedprice, F.when(li.l_discount <= 0.02, 0).otherwise(1)).alias("masked"), fields.land_mask(li.l_extendedprice, li.l_quantity > 10).alias("sea"), fields.ice_threshold(li.l_tax, li.l_quantity, 0.03).alias("ice"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 1000 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def keepers_semi(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return fields.keepers(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ids, "c_custkey", F.col("c_acctbal"), 1000)


@query("SELECT DISTINCT o_custkey AS id FROM orders UNION ALL SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def add_missing_anti(spark, sf_dir):
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return fields.add_missing(known, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id")


@query("SELECT l_partkey AS id FROM lineitem EXCEPT SELECT l_suppkey FROM lineitem")
def set_difference(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("id")).subtract(li.select("l_suppkey"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY year(o_orderdate), o_orderdate, o_orderkey) - 1 AS new_id FROM orders")
def renumber(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.year("o_orderdate").alias("y"))
    return fields.renumbered(o, ["o_orderdate", "o_orderkey"], "y").select("o_orderkey", "new_id")


@query("SELECT 'l_discount' AS var, min(l_discount) AS least, max(l_discount) AS most FROM lineitem UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem UNION ALL SELECT 'l_quantity', min(l_quantity), max(l_quantity) FROM lineitem")
def minmax_by_var(spark, sf_dir):
    return fields.value_ranges(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


# -- location and interpolation --------------------------------------------------------------
@query(f"WITH {LOCATED_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, elem_id FROM q")
def locate_triangle(spark, sf_dir):
    return located(spark, sf_dir).select(*KEY, "elem_id")


@query(f"""WITH {NODES_SQL}, f AS (SELECT node_id, {NODE_VALUE} AS f FROM nodes), {LOCATED_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, elem_id, round(CASE WHEN dy >= dx THEN a0.f * (1 - dy / 50.0::DOUBLE) + a3.f * ((dy - dx) / 50.0::DOUBLE) + a2.f * (dx / 50.0::DOUBLE)
ELSE a0.f * (1 - dx / 50.0::DOUBLE) + a1.f * ((dx - dy) / 50.0::DOUBLE) + a2.f * (dy / 50.0::DOUBLE) END, 6) AS f
FROM q JOIN f AS a0 ON a0.node_id = a JOIN f AS a1 ON a1.node_id = a + 1 JOIN f AS a2 ON a2.node_id = a + 22 JOIN f AS a3 ON a3.node_id = a + 21""")
def p1_interp(spark, sf_dir):
    return locate.interpolated(located(spark, sf_dir), "f", -1e14).select(*KEY, "elem_id", r(F.col("f")).alias("f"))


@query(f"""WITH p AS ({POINTS}) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN xi < 500 AND yi < 500 OR xi = 500 AND yi <= 500 OR yi = 500 AND xi <= 500 THEN 1 ELSE 0 END AS inside FROM p""")
def default_outside(spark, sf_dir):
    """A land-sea mask by point location: 1 within a mesh of a quarter of the domain."""
    nodes, elems = mesh.lattice(spark, 10, 10, 5.0)
    held = locate.in_triangles(points(spark, sf_dir), mesh.corners(elems, nodes), 5.0)
    return held.select(*KEY, F.when(F.col("elem_id").isNull(), 0).otherwise(1).alias("inside"))


@query(f"""WITH g AS (SELECT i, j, (i * 3 + j * j) % 17 + 0.5 AS v FROM range(21) AS a(i), range(21) AS b(j)), p AS (SELECT *, xi // 50 AS ci, yi // 50 AS cj, (xi % 50) / 50.0::DOUBLE AS dx, (yi % 50) / 50.0::DOUBLE AS dy FROM ({POINTS}))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(a.v * (1 - dx) * (1 - dy) + b.v * dx * (1 - dy) + c.v * (1 - dx) * dy + d.v * dx * dy, 5) AS bilinear,
round(CASE WHEN xi % 50 + yi % 50 <= 50 THEN a.v + (b.v - a.v) * dx + (c.v - a.v) * dy ELSE d.v + (c.v - d.v) * (1 - dx) + (b.v - d.v) * (1 - dy) END, 5) AS split,
round(CASE WHEN xi % 50 < yi % 50 THEN ((50 - yi % 50) * a.v + xi % 50 * d.v + (yi % 50 - xi % 50) * c.v) / 50.0::DOUBLE ELSE (yi % 50 * d.v + (50 - xi % 50) * a.v + (xi % 50 - yi % 50) * b.v) / 50.0::DOUBLE END, 5) AS triangle,
CASE WHEN xi % 50 <= 25 THEN CASE WHEN yi % 50 <= 25 THEN a.v ELSE c.v END ELSE CASE WHEN yi % 50 <= 25 THEN b.v ELSE d.v END END::DOUBLE AS nearest
FROM p JOIN g AS a ON a.i = ci AND a.j = cj JOIN g AS b ON b.i = ci + 1 AND b.j = cj JOIN g AS c ON c.i = ci AND c.j = cj + 1 JOIN g AS d ON d.i = ci + 1 AND d.j = cj + 1""")
def bilinear_split_nearest(spark, sf_dir):
    k = spark.range(441)
    grid = k.select((F.col("id") % 21).cast("int").alias("i"), F.floor(F.col("id") / 21).cast("int").alias("j")).withColumn("v", ((F.col("i") * 3 + F.col("j") * F.col("j")) % 17 + 0.5).cast("double"))
    at = locate.cell_values(points(spark, sf_dir), grid, (0.0, 0.0), 5.0, (21, 21), "v")
    # Fifths have no exact binary form; places within a cell are taken in whole fiftieths.
    a = [F.round(F.col("dx") * 50) / 50, F.round(F.col("dy") * 50) / 50, *map(F.col, ("v00", "v10", "v01", "v11"))]
    return at.select(*KEY, r(geometry.bilinear(*a), 5).alias("bilinear"), r(geometry.triangle_split(*a), 5).alias("split"), r(geometry.triangle_split_up(*a), 5).alias("triangle"), geometry.nearest(*a).alias("nearest"))


def vertices(spark, sf_dir) -> DataFrame:
    """Customers with their nearest supplier, however far."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") * 37 % 100).cast("double").alias("x"), (F.col("s_suppkey") * 61 % 100).cast("double").alias("y"))
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 17 % 1000 / 10.0).alias("px"), (F.col("c_custkey") * 29 % 1000 / 10.0).alias("py"))
    return locate.nearest_vertex(c, s)


@query("""WITH s AS (SELECT s_suppkey, (s_suppkey * 37 % 100) * 1.0::DOUBLE AS x, (s_suppkey * 61 % 100) * 1.0::DOUBLE AS y FROM supplier), c AS (SELECT c_custkey, (c_custkey * 17 % 1000) / 10.0::DOUBLE AS px, (c_custkey * 29 % 1000) / 10.0::DOUBLE AS py FROM customer)
SELECT c_custkey, arg_min(s_suppkey, {'d': pow(px - x, 2) + pow(py - y, 2), 's': s_suppkey}) AS node_id, round(min(pow(px - x, 2) + pow(py - y, 2)), 6) AS d2 FROM c, s GROUP BY c_custkey""")
def knn_vertex(spark, sf_dir):
    return vertices(spark, sf_dir).select("c_custkey", "node_id", r(F.col("d2")).alias("d2"))


# -- remapping -------------------------------------------------------------------------------
BOXES = "SELECT p_partkey AS box_id, (p_partkey * 13 % 900) / 10.0::DOUBLE AS x0, (p_partkey * 13 % 900) / 10.0::DOUBLE + 1 + p_size % 7 AS x1, (p_partkey * 29 % 900) / 10.0::DOUBLE AS y0, (p_partkey * 29 % 900) / 10.0::DOUBLE + 1 + p_size % 5 AS y1 FROM part"
OVERLAP_SQL = f"""b AS ({BOXES}), g AS (SELECT j * 20 + i AS cell_id, i * 5.0::DOUBLE AS gx0, i * 5.0::DOUBLE + 5 AS gx1, j * 5.0::DOUBLE AS gy0, j * 5.0::DOUBLE + 5 AS gy1 FROM range(20) AS a(i), range(20) AS c(j)),
o AS (SELECT cell_id, box_id, (least(gx1, x1) - greatest(gx0, x0)) * (least(gy1, y1) - greatest(gy0, y0)) AS w FROM b, g WHERE least(gx1, x1) > greatest(gx0, x0) AND least(gy1, y1) > greatest(gy0, y0))"""


def cells(spark) -> DataFrame:
    x, y = F.col("id") % 20 * 5.0, F.floor(F.col("id") / 20) * 5.0
    return spark.range(400).select(F.col("id").alias("cell_id"), x.alias("x0"), (x + 5).alias("x1"), y.alias("y0"), (y + 5).alias("y1"))


def boxes(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    x, y = F.col("p_partkey") * 13 % 900 / 10.0, F.col("p_partkey") * 29 % 900 / 10.0
    return p.select(F.col("p_partkey").alias("box_id"), x.alias("x0"), (x + 1 + F.col("p_size") % 7).alias("x1"), y.alias("y0"), (y + 1 + F.col("p_size") % 5).alias("y1"), F.col("p_retailprice").alias("v"))


@query(f"WITH {OVERLAP_SQL} SELECT cell_id, box_id, round(w, 5) AS w FROM o WHERE w > 1e-6")
def cell_overlap_rect(spark, sf_dir):
    return remap.box_overlaps(cells(spark), boxes(spark, sf_dir), 5.0).where("w > 1e-6").withColumn("w", F.round("w", 5))


@query(f"WITH {OVERLAP_SQL} SELECT cell_id, round(sum(w * p_retailprice) / 25, 2) AS v, round(sum(w) / 25, 4) AS covered FROM o JOIN part ON box_id = p_partkey GROUP BY cell_id")
def remap_mesh_to_grid(spark, sf_dir):
    b = boxes(spark, sf_dir)
    w = remap.box_overlaps(cells(spark), b, 5.0).withColumnRenamed("box_id", "elem_id")
    return remap.mesh_to_grid(w, b.select(F.col("box_id").alias("elem_id"), "v"), 25.0, "v").select("cell_id", F.round("v", 2).alias("v"), F.round("covered", 4).alias("covered"))


@query(f"WITH {OVERLAP_SQL} SELECT box_id AS elem_id, round(sum(w * (cell_id % 11)) / sum(w), 4) AS v FROM o GROUP BY box_id")
def remap_grid_to_mesh(spark, sf_dir):
    c = cells(spark)
    w = remap.box_overlaps(c, boxes(spark, sf_dir), 5.0).withColumnRenamed("box_id", "elem_id")
    return remap.grid_to_mesh(w, c.select("cell_id", (F.col("cell_id") % 11).alias("v")), "v").withColumn("v", F.round("v", 4))


@query("SELECT l_suppkey, round(sum(l_discount * p_retailprice), 2) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey")
def weights_apply(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey"), F.col("l_discount").alias("w"))
    return remap.applied(w, table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("v")), "l_suppkey", "p_partkey", "v").withColumn("v", F.round("v", 2))


# -- series ----------------------------------------------------------------------------------
ASOF_SQL = """s AS (SELECT event_type, epoch_us(ts) AS t0, value AS v0, lead(epoch_us(ts)) OVER w AS t1, lead(value) OVER w AS v1 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
k AS (SELECT DISTINCT event_type FROM events), a AS (SELECT event_type, epoch_us(TIMESTAMP '2024-01-01') + n * 3600000000 AS at_us FROM k, range(720) AS t(n)),
m AS (SELECT a.event_type, a.at_us, t0, v0, t1, v1, row_number() OVER (PARTITION BY a.event_type, a.at_us ORDER BY t0 DESC NULLS LAST) AS rn FROM a LEFT JOIN s ON a.event_type = s.event_type AND t0 <= at_us AND at_us <= t1)"""


def series(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.select("event_type", timeconv.micros(e.ts).alias("t"), "value")
    start = 1_704_067_200_000_000
    at = s.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(0), F.lit(719))).alias("n")).select("event_type", (F.lit(start) + F.col("n") * 3_600_000_000).alias("at"))
    return asof.bracketed(at, s, ["event_type"], "t", "value", 6 * 3_600_000_000)


@query(f"WITH {ASOF_SQL} SELECT event_type, at_us, round((v0 * (t1 - at_us) + v1 * (at_us - t0)) / (t1 - t0)::DOUBLE, 4) AS value, v0 AS stepwise FROM m WHERE rn = 1")
def asof_linear(spark, sf_dir):
    return series(spark, sf_dir).select("event_type", F.col("at").alias("at_us"), r(asof.linear(), 4).alias("value"), asof.step().alias("stepwise"))


@query(f"WITH {ASOF_SQL} SELECT event_type, at_us, round(least(1.0, (at_us - 1704067200000000) / 864000000000.0::DOUBLE) * v0 + 1.5, 8) AS value FROM m WHERE rn = 1")
def spinup_bias(spark, sf_dir):
    """Stepwise values with a factor that rises over ten days, then a bias."""
    f = asof.spin_up(F.col("at"), F.lit(1_704_067_200_000_000), 864_000_000_000.0)
    return series(spark, sf_dir).select("event_type", F.col("at").alias("at_us"), r(asof.step(f, 1.5), 8).alias("value"))


@query("SELECT e.event_id, n FROM events AS e LEFT JOIN (SELECT o_orderdate::DATE AS d, count(*) AS n FROM (SELECT CAST(ts AS DATE) AS o_orderdate FROM events WHERE event_type = 'purchase') GROUP BY 1) ON CAST(e.ts AS DATE) = d")
def nearest_daily(spark, sf_dir):
    """Each event with the purchases of its calendar day."""
    e = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    return e.join(e.where("event_type = 'purchase'").groupBy("d").agg(F.count("*").alias("n")), "d", "left").select("event_id", "n")


@query("""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS w, user_id % 20 AS cell, round(avg(value), 4) AS mean, count(*) AS n FROM events GROUP BY ALL""")
def grid_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("cell", F.col("user_id") % 20)
    m = gridmean.window_mean(e, F.col("ts"), "6 hours", ["cell"], F.col("value"))
    return m.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("w"), "cell", F.round("mean", 4).alias("mean"), "n")


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS w, event_type, arg_max(value, ts) AS last FROM events GROUP BY ALL""")
def coupling_last(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = gridmean.last_value(e, F.col("ts"), "1 day", ["event_type"], F.col("value"), F.col("event_id"))
    return m.select(F.date_format("window_start", "yyyy-MM-dd").alias("w"), "event_type", "last")


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS w, event_type, round(sum(value * (1 + user_id % 3)) / sum(1 + user_id % 3), 4) AS mean, count(*) AS n FROM events GROUP BY ALL""")
def coupling_avg(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = gridmean.window_mean(e, F.col("ts"), "1 day", ["event_type"], F.col("value"), 1 + F.col("user_id") % 3)
    return m.select(F.date_format("window_start", "yyyy-MM-dd").alias("w"), "event_type", F.round("mean", 4).alias("mean"), "n")


# -- gridding --------------------------------------------------------------------------------
@query(f"SELECT xi // 100 AS bi, yi // 100 AS bj, coalesce(floor(avg(l_quantity) FILTER (l_quantity <> 50) + 0.5), 50)::DOUBLE AS l_quantity FROM ({POINTS}) GROUP BY ALL")
def block_mean(spark, sf_dir):
    p = points(spark, sf_dir).select(F.col("xi").alias("i"), F.col("yi").alias("j"), "l_quantity")
    return gridmean.block_mean(p, 100, "l_quantity", fill=50.0)


@query(f"SELECT * FROM (SELECT xi AS i, yi AS j, count(*) AS n FROM ({POINTS}) GROUP BY ALL) WHERE i % 5 = 3 AND j % 5 = 3")
def block_sample(spark, sf_dir):
    p = points(spark, sf_dir).groupBy(F.col("xi").alias("i"), F.col("yi").alias("j")).agg(F.count("*").alias("n"))
    return gridmean.block_sample(p, 5)


@query(f"WITH n AS (SELECT xi // 200 AS bi, l_returnflag, count(*) AS n FROM (SELECT l_partkey * 37 % 1000 AS xi, l_returnflag FROM lineitem) GROUP BY ALL) SELECT bi, l_returnflag, round(100 * n / sum(n) OVER (PARTITION BY bi), 6) AS percent FROM n")
def mask_percent(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_partkey") * 37 % 1000 / 200).alias("bi"), "l_returnflag")
    return gridmean.coverage(li, ["bi"], "l_returnflag").withColumn("percent", F.round("percent", 6))


def _scattered(kind: str, weight: str):
    def run(spark, sf_dir):
        p = places(spark, sf_dir).select((F.col("lat") - 40).alias("px"), ((F.col("lon") + 180) / 10).alias("py"), "c_acctbal")
        g = spark.range(400).select(F.col("id").alias("cell_id"), (F.col("id") % 20 * 2.5).alias("gx"), (F.floor(F.col("id") / 20) * 1.8).alias("gy"))
        return gridmean.scattered(p, g, 2.0, "c_acctbal", kind).withColumn("c_acctbal", F.round("c_acctbal", 5))

    run.__name__ = f"scattered_{kind}"
    query(f"""WITH p AS (SELECT lat - 40 AS px, (lon + 180) / 10 AS py, c_acctbal FROM ({PLACES})), g AS (SELECT id AS cell_id, id % 20 * 2.5::DOUBLE AS gx, id // 20 * 1.8::DOUBLE AS gy FROM range(400) AS t(id)),
d AS (SELECT cell_id, c_acctbal, pow(px - gx, 2) + pow(py - gy, 2) AS d2 FROM p, g)
SELECT cell_id, round(sum({weight} * c_acctbal) / sum({weight}), 5) AS c_acctbal, count(*) AS n FROM d WHERE d2 <= 4 GROUP BY cell_id""")(run)


_scattered("cressman", "((4 - d2) / (4 + d2))")
_scattered("idw", "(1 / greatest(d2, 1e-12))")
_scattered("bucket", "1.0")


# -- meshes ----------------------------------------------------------------------------------
@query(f"""WITH p AS (SELECT *, px / 25 AS t FROM ({POINTS})), b AS (SELECT *, (t - 1) * (t - 2) / 2 AS l0, t * (2 - t) AS l1, t * (t - 1) / 2 AS l2 FROM (SELECT * EXCLUDE (t), least(t, 2) AS t FROM p))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l0 * 3 + l1 * 5 + l2 * 4, 6) + 0.0 AS v, round(1 + 0.5 * px - 0.25 * px * py + 0.125 * py * py, 5) + 0.0 AS w FROM b""")
def lagrange_and_polynomial(spark, sf_dir):
    p = points(spark, sf_dir)
    t = F.least(p.px / 25, F.lit(2.0))
    v = sum((geometry.lagrange([0.0, 1.0, 2.0], i, t) * c for i, c in enumerate((3.0, 5.0, 4.0))), F.lit(0.0))
    w = geometry.polynomial2d(p.px, p.py, {(0, 0): 1.0, (1, 0): 0.5, (1, 1): -0.25, (0, 2): 0.125})
    return p.select(*KEY, r(v).alias("v"), r(w, 5).alias("w"))


# -- waves, ice, noise -----------------------------------------------------------------------
OMEGA = "(2 * pi() / (2.5 + f * 1.5))"
SPECTRUM = f"""s AS (SELECT s_suppkey, 1 + s_suppkey % 7 * 0.5::DOUBLE AS hs, 5 + s_suppkey % 11 * 1.0::DOUBLE AS tp, (s_suppkey % 12) * 30.0::DOUBLE AS d FROM supplier)"""


def seas(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k, (1 + k % 7 * 0.5).alias("hs"), (5 + k % 11 * 1.0).alias("tp"), (k % 12 * 30.0).alias("d"))


@query(f"""WITH {SPECTRUM}, w AS (SELECT s_suppkey, {OMEGA} AS o, 5 / 16.0::DOUBLE * hs * hs * pow(2 * pi() / tp, 4) * pow({OMEGA}, -5) * exp(-1.25 * pow(2 * pi() / tp / {OMEGA}, 4)) AS e FROM s, range(16) AS t(f))
SELECT s_suppkey, round(4 * sqrt(sum(e * 0.1)), 4) AS hs, round(2 * pi() * sqrt(sum(e * 0.1) / sum(e * o * o * 0.1)), 4) AS tp FROM w GROUP BY s_suppkey""")
def spectrum_moments(spark, sf_dir):
    w = seas(spark, sf_dir).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("o", 2 * math.pi / (2.5 + F.col("f") * 1.5))
    w = w.withColumn("e", spectral.bretschneider(F.col("hs"), F.col("tp"), F.col("o")))
    m = w.groupBy("s_suppkey").agg(F.sum(F.col("e") * 0.1).alias("m0"), F.sum(F.col("e") * F.col("o") * F.col("o") * 0.1).alias("m2"))
    p = spectral.wave_parameters(F.col("m0"), F.col("m2"), F.lit(1.0), F.lit(0.0))
    return m.select("s_suppkey", r(p["hs"], 4).alias("hs"), r(p["tp"], 4).alias("tp"))


@query(f"""WITH {SPECTRUM}, b AS (SELECT s_suppkey, n, greatest(n * 22.5 - 11.25 - d - turn * 360, -90) AS lo, least(n * 22.5 + 11.25 - d - turn * 360, 90) AS hi FROM s, range(16) AS t(n), range(-2, 3) AS w(turn))
SELECT s_suppkey, n, round(sum(CASE WHEN hi > lo THEN (radians(hi) - radians(lo) + (sin(2 * radians(hi)) - sin(2 * radians(lo))) / 2) / pi() ELSE 0.0 END), 6) + 0.0 AS share FROM b GROUP BY s_suppkey, n""")
def directional_share(spark, sf_dir):
    b = seas(spark, sf_dir).withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    return b.select("s_suppkey", "n", r(spectral.direction_share(F.col("n") * 22.5 - 11.25, F.col("n") * 22.5 + 11.25, F.col("d"))).alias("share"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_discount > 0 THEN l_discount / (l_quantity * l_quantity) ELSE 0 END, 8) AS n, round(CASE WHEN l_discount > 0 THEN least(l_quantity, 30) ELSE 0 END, 6) AS capped, round(CASE WHEN l_discount > 0 THEN CASE WHEN l_quantity > 30.5 THEN 10 ELSE l_quantity END ELSE 0 END, 6) AS reset FROM lineitem")
def floe_convert(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n = spectral.floes(li.l_discount, li.l_quantity)
    return li.select(*KEY, r(n, 8).alias("n"), r(spectral.floe_size(li.l_discount, n, 30.0)).alias("capped"), r(spectral.floe_size_reset(li.l_discount, n, 30.5, 10.0)).alias("reset"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 50 AS c, l_tax AS v0, l_tax / 4 AS vs, l_discount AS new, 1 - l_quantity / 50 AS o FROM lineitem),
b AS (SELECT *, least(v0 / 0.01, sqrt(2 * v0 / 2.5)) AS c0 FROM a), v AS (SELECT *, v0 + new * greatest(0, o - c0) AS vol, CASE WHEN c0 > 0 THEN vs / c0 ELSE 0 END AS hs FROM b),
h AS (SELECT *, CASE WHEN least(vol / 0.01, sqrt(2 * vol / 2.5)) <= o THEN sqrt(2 * vol * 2.5) ELSE vol / nullif(o, 0) + 0.5 * o * 2.5 END AS h0 FROM v), d AS (SELECT *, greatest(0, h0 - 0.3) / 2.5 AS dc FROM h)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN c = 1 THEN 0 ELSE round(vol - CASE WHEN dc <= o THEN 0.5 * dc * (h0 + 0.3) ELSE vol END, 8) + 0.0 END::DOUBLE AS thin, round(CASE WHEN c = 1 OR dc > o THEN vol ELSE 0.5 * dc * (h0 + 0.3) END, 8) + 0.0 AS new_volume,
round(CASE WHEN c = 1 THEN 0 WHEN dc <= o THEN dc ELSE o END, 8) + 0.0 AS new_conc, round(CASE WHEN c = 1 THEN vs ELSE least(vs, dc * hs) END, 8) + 0.0 AS new_snow FROM d""")
def thin_ice(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = spectral.thin_ice(li.l_tax, li.l_tax / 4, li.l_discount, li.l_quantity / 50, 2.5, 0.3)
    return li.select(*KEY, *[r(c, 8).alias(n) for n, c in out.items()])


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 8 AS d FROM lineitem),
m AS (SELECT DISTINCT d, k, CASE WHEN k < n THEN 0.1 ELSE 1 END * pow(3.6, k) AS f, n FROM (SELECT d, CASE WHEN d >= 320 THEN 4 WHEN d >= 160 THEN 3 WHEN d >= 80 THEN 2 WHEN d >= 40 THEN 1 ELSE 0 END AS n FROM d), range(5) AS t(k) WHERE k <= n),
s AS (SELECT d, sum(f * d / pow(2, k)) / sum(f) AS one, sum(f * pow(d / pow(2, k), 2)) / sum(f) AS two FROM m GROUP BY d)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN d < 40 THEN greatest(d, 20) ELSE one END, 6) AS one, round(CASE WHEN d < 40 THEN greatest(d * d, 400) ELSE two END, 6) AS two,
round(CASE WHEN d <= 20 THEN 20 ELSE (2 + ln(0.9) / ln(2)) / (1 + ln(0.9) / ln(2)) * (pow(20, -(1 + ln(0.9) / ln(2))) - pow(d, -(1 + ln(0.9) / ln(2)))) / (pow(20, -(2 + ln(0.9) / ln(2))) - pow(d, -(2 + ln(0.9) / ln(2)))) END, 6) AS smooth,
round(CASE WHEN l_linenumber = 1 THEN 0 WHEN d < 200 THEN CASE WHEN d < 40 THEN greatest(d, 20) ELSE one END ELSE d END, 6) AS mean_size,
round(CASE WHEN l_linenumber = 1 THEN 0 WHEN d < 200 THEN CASE WHEN d < 40 THEN greatest(d * d, 400) ELSE two END ELSE d END, 6) AS mean_square FROM d JOIN s USING (d)""")
def floe_moments(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("d", F.col("l_quantity") * 8)
    c = F.col("d")
    smooth = spectral.floe_moment_smooth(c, 20.0, 2 + math.log(0.9) / math.log(2), 1)
    mean, square = (spectral.mean_floe_size(F.col("l_linenumber") != 1, c, 200.0, 20.0, 0.9, 2.0, m) for m in (1, 2))
    return d.select(*KEY, *[r(x).alias(n) for n, x in (("one", spectral.floe_moment_steps(c, 20.0, 0.9, 2.0, 1)), ("two", spectral.floe_moment_steps(c, 20.0, 0.9, 2.0, 2)), ("smooth", smooth), ("mean_size", mean), ("mean_square", square))])


_A = noise.alpha(8.0, 48.0)


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, value / 100 AS w, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
x AS (SELECT user_id, event_id, n, w AS x FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, {_A!r} * x.x + {math.sqrt(1 - _A * _A)!r} * e.w FROM x JOIN e ON e.user_id = x.user_id AND e.n = x.n + 1)
SELECT event_id, round(x, 6) AS x FROM x""")
def ar1_noise(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 100).alias("w"))
    return noise.ar1(e, ["user_id"], "event_id", "w", _A).select("event_id", r(F.col("x")).alias("x"))


@query("""WITH p AS (SELECT s_suppkey AS j, i, (s_suppkey * 31 + i * i * 7) % 50 / 10.0::DOUBLE AS p FROM supplier, range(30) AS t(i)), k AS (SELECT 2 * sin(40 * pi() / 180) * 2 * pi() / 86400 * 1.2 AS f, sin(60) / 60 * pi() / 2 AS w),
g AS (SELECT a.i, a.j, coalesce(100 * (a.p - w.p) / 30000, 0) AS gx, coalesce(100 * (a.p - s.p) / 30000, 0) AS gy FROM p AS a LEFT JOIN p AS w ON w.j = a.j AND w.i = a.i - 1 AND a.j > 0 LEFT JOIN p AS s ON s.j = a.j - 1 AND s.i = a.i AND a.i > 0)
SELECT i, j, round(-w * gy / f - (1 - w) * gx / f, 6) + 0.0 AS u, round(w * gx / f - (1 - w) * gy / f, 6) + 0.0 AS v FROM g, k""")
def random_wind(spark, sf_dir):
    """Wind of a pressure field on a grid of one row for each supplier."""
    g = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("i")).withColumn("p", (F.col("j") * 31 + F.col("i") * F.col("i") * 7) % 50 / 10.0)
    g = noise.pressure_gradient(g, "p", 30000.0)
    u, v = noise.geostrophic(F.col("gx"), F.col("gy"))
    return g.select("i", "j", r(u).alias("u"), r(v).alias("v"))


def _weno_sql(h: str, source: str, name: str) -> str:
    """The spatial operator of column h of a padded table (j, i, u) by CTEs named after ``name``."""
    up = f"CASE WHEN u > 0 THEN u * ((-0.5 * m2 + 1.5 * m1) / 3 + 2.0 / 3 * (abs(m2 - m1) + 1e-12) / (abs(m1 - c) + 1e-12) * (m1 + c) / 2) / (1.0 / 3 + 2.0 / 3 * (abs(m2 - m1) + 1e-12) / (abs(m1 - c) + 1e-12))"
    down = f"u * (2.0 / 3 * (m1 + c) / 2 + (abs(m1 - c) + 1e-12) / (abs(c - p1) + 1e-12) / 3 * (1.5 * c - 0.5 * p1)) / (2.0 / 3 + (abs(m1 - c) + 1e-12) / (abs(c - p1) + 1e-12) / 3)"
    return f"""{name}0 AS (SELECT *, {h} AS c, coalesce(lag({h}, 2) OVER w, 0) AS m2, coalesce(lag({h}) OVER w, 0) AS m1, coalesce(lead({h}) OVER w, 0) AS p1 FROM {source} WINDOW w AS (PARTITION BY j ORDER BY i)),
{name}1 AS (SELECT *, CASE WHEN u > 0 THEN u * m1 ELSE u * c END AS lo, {up} ELSE {down} END AS hi FROM {name}0),
{name}2 AS (SELECT *, c - 0.25 * (coalesce(lead(lo) OVER (PARTITION BY j ORDER BY i), 0) - lo) AS g FROM {name}1),
{name}3 AS (SELECT *, lo + greatest(-g, least(coalesce(lag(g) OVER (PARTITION BY j ORDER BY i), 0), hi - lo)) AS fl FROM {name}2),
{name} AS (SELECT * EXCLUDE (c, m2, m1, p1, lo, hi, g, fl), fl - coalesce(lead(fl) OVER (PARTITION BY j ORDER BY i), 0) AS sao_{name} FROM {name}3)"""


@query(f"""WITH g AS (SELECT s_suppkey AS j, i, CASE WHEN i BETWEEN 10 AND 20 THEN 1.0 + i * s_suppkey % 3 ELSE 0.0 END::DOUBLE AS h, CASE WHEN s_suppkey % 2 = 0 THEN 1.0 ELSE -1.0 END + i % 3 * 0.25::DOUBLE AS u FROM supplier, range(40) AS a(i)),
pad AS (SELECT j, i + n AS i, h, u FROM g, (VALUES (0), (40), (-40)) AS t(n) WHERE n = 0 OR n = 40 AND i < 4 OR n = -40 AND i >= 36), {_weno_sql("h", "pad", "a")}, fst AS (SELECT *, h + 0.25 * sao_a AS hp FROM a), {_weno_sql("hp", "fst", "b")}
SELECT i, j, CASE WHEN i = 30 THEN 0 ELSE round(0.5 * (h + hp + 0.25 * sao_b), 6) + 0.0 END::DOUBLE AS h FROM b WHERE i BETWEEN 0 AND 39""")
def weno_step(spark, sf_dir):
    """A step along rows, one for each supplier, around a channel with land at one place."""
    cell = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("i"))
    h = F.when(F.col("i").between(10, 20), (1.0 + F.col("i") * F.col("j") % 3).cast("double")).otherwise(0.0)
    g = cell.withColumns({"h": h, "u": F.when(F.col("j") % 2 == 0, 1.0).otherwise(-1.0) + F.col("i") % 3 * 0.25, "land": F.col("i") == 30})
    out = advection.weno_step(g.withColumnRenamed("j", "row").withColumn("j", F.lit(0)), "h", 0.25, (40, 1), {"i": "u"}, by=["row"], land="land")
    return out.select("i", F.col("row").alias("j"), r(F.col("h")).alias("h"))


# -- drifters --------------------------------------------------------------------------------
@query("""SELECT event_id, (epoch_us(ts) - 1704067200000000) // 259200000000 AS set_no, (epoch_us(ts) // 1000000 - 1704067200) % 60 = 0 AS due FROM events""")
def drifter_lifetimes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = timeconv.micros(e.ts)
    sec = F.floor(t / 1_000_000)
    return e.select("event_id", drifters.lifetime(t, F.lit(1_704_067_200_000_000), 259_200_000_000).alias("set_no"), drifters.is_due(sec, F.lit(1_704_067_200), 60).alias("due"))


P1_SQL = """CASE WHEN dy >= dx THEN a0.f * (1 - dy / 50.0::DOUBLE) + a3.f * ((dy - dx) / 50.0::DOUBLE) + a2.f * (dx / 50.0::DOUBLE)
ELSE a0.f * (1 - dx / 50.0::DOUBLE) + a1.f * ((dx - dy) / 50.0::DOUBLE) + a2.f * (dy / 50.0::DOUBLE) END"""


@query(f"""WITH {NODES_SQL}, f AS (SELECT node_id, {NODE_VALUE} AS f FROM nodes), e AS (SELECT ts, value, user_id * 37 % 1000 AS xi, event_id * 53 % 1000 AS yi FROM events),
q AS (SELECT *, xi // 50 AS ci, yi // 50 AS cj, xi % 50 AS dx, yi % 50 AS dy, yi // 50 * 21 + xi // 50 + 1 AS a FROM e),
v AS (SELECT ts, value, 2 * (cj * 20 + ci) + CASE WHEN dy >= dx THEN 2 ELSE 1 END AS elem_id, {P1_SQL} AS f
FROM q JOIN f AS a0 ON a0.node_id = a JOIN f AS a1 ON a1.node_id = a + 1 JOIN f AS a2 ON a2.node_id = a + 22 JOIN f AS a3 ON a3.node_id = a + 21)
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS w, elem_id, round(avg(f * value), 8) AS mean, count(*) AS n FROM v GROUP BY ALL""")
def flagship_grid_mean(spark, sf_dir):
    m = flagship(spark, sf_dir)
    return m.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("w"), "elem_id", r(F.col("mean"), 8).alias("mean"), "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly grid means of a field sampled at the places of events: locate, interpolate, window, mask."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "value", (F.col("user_id") * 37 % 1000 / 10.0).alias("px"), (F.col("event_id") * 53 % 1000 / 10.0).alias("py"))
    nodes, elems = the_mesh(spark)
    held = locate.interpolated(locate.in_triangles(e, mesh.corners(elems, nodes, "f"), 5.0, ["f1", "f2", "f3"]), "f", fields.MISSING)
    m = gridmean.window_mean(held, F.col("ts"), "1 hour", ["elem_id"], F.col("f") * F.col("value"))
    return m.withColumn("mean", fields.land_mask(F.col("mean"), F.col("elem_id").isNotNull()))

