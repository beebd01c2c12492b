import math
import re
import struct
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gyre.functions import geodesy, geometry, spectral, timeconv
from gyre.operators import advection, asof, drifters, fields, gridmean, locate, mesh, noise, remap
from gyre.sources import catalog, files
from gyre.streaming import streams


def one(df):
    return df.first()[0]


def test_datenum_constants(spark):
    df = spark.createDataFrame([(datetime(1900, 1, 2, 18),), (datetime(2006, 12, 1),)], "t timestamp")
    assert [r[0] for r in df.select(timeconv.datenum(F.col("t"))).collect()] == [1.75, 39050.0]
    assert one(df.select(timeconv.filename_stamp(timeconv.from_datenum(F.lit(1.75))))) == "19000102T180000Z"
    with pytest.raises(PySparkException):
        spark.createDataFrame([(datetime(1899, 12, 31),)], "t timestamp").select(timeconv.datenum(F.col("t"))).collect()


def test_iso_week_and_period_keys(spark):
    df = spark.createDataFrame([(datetime(2021, 1, 1),)], "t timestamp")
    keys = [one(df.select(timeconv.period_key(F.col("t"), k))) for k in ("weekly", "daily", "monthly", "yearly")]
    assert keys == ["2020w53", "2021d001", "2021m01", "2021"]
    with pytest.raises(ValueError):
        timeconv.period_key(F.col("t"), "hourly")


def spec_of(name, **more):
    """A centre that suits the projection: cones and cylinders need a middle latitude, polar maps the pole."""
    base = {"lat0": 50.0, "lat1": 40.0, "lat2": 60.0} if re.search("albers|lambert|mercator|^azimuthal_equal_area$", name) else {"lat1": 40.0}
    return geodesy.MapSpec(**({"lon0": -45.0} | base | more))


@pytest.mark.parametrize("name", sorted(geodesy.INVERSE))
@pytest.mark.parametrize("more", [{}, {"rotation": 33.0, "scale": 2.5, "x0": 10.0, "y0": -4.0}])
def test_projection_round_trip(spark, name, more):
    m = spec_of(name, **more)
    wide = 2.5 if name == "transverse_mercator_ellipsoid" else 80.0
    df = spark.range(200).select((F.col("id") * 0.24 + 41).alias("lat"), (F.col("id") * (wide / 100) - wide - 45).alias("lon"))
    x, y = geodesy.forward(name, F.col("lat"), F.col("lon"), m)
    there = spark.createDataFrame(df.select("lat", "lon", x.alias("x"), y.alias("y")).collect())
    lat, lon = geodesy.inverse(name, F.col("x"), F.col("y"), m)
    for r in there.select("lat", "lon", lat.alias("a"), lon.alias("b")).collect():
        assert abs(r.a - r.lat) < 1e-6 and abs(r.b - r.lon) < 1e-6


def test_utm_of_a_known_place(spark):
    """Snyder's example: 40.5 N, 73.5 W on Clarke's 1866 ellipsoid."""
    zone, x, y = geodesy.utm(F.lit(40.5), F.lit(-73.5), 6378.2064, math.sqrt(0.00676866))
    r = spark.range(1).select(zone.alias("z"), x.alias("x"), y.alias("y")).first()
    assert r.z == 18 and abs(r.x - 627.1065) < 1e-3 and abs(r.y - 4484.1244) < 1e-3


def test_homolosine_is_continuous_at_its_seam(spark):
    df = spark.createDataFrame([(geodesy.SEAM - 1e-7,), (geodesy.SEAM + 1e-7,)], "lat double")
    (x0, y0), (x1, y1) = df.select(*geodesy.forward("homolosine", F.col("lat"), F.lit(10.0), geodesy.MapSpec(lon0=0.0))).collect()
    assert abs(x0 - x1) < 1 and abs(y0 - y1) < 1


@pytest.mark.parametrize("name", ["mollweide", "sinusoidal", "azimuthal_equal_area"])
def test_places_at_the_end_of_the_longitudes_come_back_there(spark, name):
    """Rounding leaves them on either side of it; places a little off it stay where they are."""
    m = spec_of(name, lon0=10.0)
    rows = [(float(lat), lon) for lat in range(40, 90, 5) for lon in (-180.0, 179.9999, -179.9999)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    x, y = geodesy.forward(name, F.col("lat"), F.col("lon"), m)
    held = df.withColumns({"x": x, "y": y})
    _, lon = geodesy.inverse(name, F.col("x"), F.col("y"), m)
    assert [round(r[0], 6) for r in held.select(lon).collect()] == [lon for _, lon in rows]


def test_mollweide_solves_its_equation(spark):
    df = spark.range(-89, 90).select(F.col("id").cast("double").alias("lat"))
    _, y = geodesy.forward("mollweide", F.col("lat"), F.lit(0.0), geodesy.MapSpec(radius=1.0))
    for lat, v in df.select("lat", y).collect():
        t = 2 * math.asin(v / math.sqrt(2))
        assert abs(t + math.sin(t) - math.pi * math.sin(math.radians(lat))) < 1e-6


def test_the_two_angle_wraps_differ_at_the_end(spark):
    df = spark.createDataFrame([(180.0,)], "a double")
    assert one(df.select(geodesy.wrap_closed(F.col("a"), -180.0))) == 180.0
    assert one(df.select(geodesy.wrap(F.col("a"), -180.0))) == -180.0


def test_polygons(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)],)], "p array<struct<x:double,y:double>>")
    assert one(df.select(geometry.polygon_area(F.col("p")))) == 2.0
    assert one(df.select(geometry.polygon_area(geometry.clockwise(F.shuffle("p", 3))))) == 2.0
    assert one(df.select(geometry.in_convex(F.lit(2.0), F.lit(0.5), F.col("p")))) and not one(df.select(geometry.in_convex(F.lit(2.1), F.lit(0.5), F.col("p"))))
    assert one(df.select(geometry.polygon_area(F.slice("p", 1, 2)))) == 0.0


def test_linear_fields_are_exact_and_constants_kept(spark):
    nodes, elems = mesh.lattice(spark, 6, 5, 2.0)
    nodes = nodes.withColumn("f", 3 * F.col("x") - F.col("y") + 1)
    pts = spark.range(60).select(F.col("id"), (F.col("id") * 0.19 + 0.01).alias("px"), (F.col("id") * 0.15 + 0.02).alias("py"))
    held = locate.interpolated(locate.in_triangles(pts, mesh.corners(elems, nodes, "f"), 2.0, ["f1", "f2", "f3"]), "f", -1.0)
    assert all(abs(r.f - (3 * r.px - r.py + 1)) < 1e-9 for r in held.collect())


def test_a_shared_edge_belongs_to_the_highest_element(spark):
    nodes, elems = mesh.lattice(spark, 2, 2, 1.0)
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.5, 0.5), (3, 9.0, 9.0)], "id int, px double, py double")
    assert {r.id: r.elem_id for r in locate.in_triangles(pts, mesh.corners(elems, nodes), 1.0).collect()} == {1: 8, 2: 2, 3: None}


def test_overlap_weights_sum_to_the_covered_area(spark):
    nodes, elems = mesh.lattice(spark, 4, 4, 1.0)
    cells = spark.createDataFrame([(1, 0.3, 2.1, 0.2, 1.7), (2, 3.5, 5.0, 3.5, 5.0)], "cell_id long, x0 double, x1 double, y0 double, y1 double")
    w = remap.triangle_overlaps(cells, mesh.corners(elems, nodes), 1.0).groupBy("cell_id").agg(F.sum("w").alias("w"))
    got = {r.cell_id: r.w for r in w.collect()}
    assert abs(got[1] - 1.8 * 1.5) < 1e-9 and abs(got[2] - 0.25) < 1e-9


def test_asof_ends_and_middle(spark):
    s = spark.createDataFrame([("a", 0, 1.0), ("a", 10, 3.0), ("a", 20, 7.0)], "k string, t long, v double")
    at = spark.createDataFrame([("a", t) for t in (0, 5, 10, 20, 21)], "k string, at long")
    got = {r["at"]: r.x for r in asof.bracketed(at, s, ["k"], "t", "v", 7).select("at", asof.linear(2.0, 1.0).alias("x")).collect()}
    assert got == {0: 3.0, 5: 5.0, 10: 7.0, 20: 15.0, 21: None}


def test_drifter_rules(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.6), (3, 0.6)], "id int, c double")
    kept = fields.keepers(rows, spark.createDataFrame([(1,), (2,)], "id int"), "id", F.col("c"), 0.5)
    assert [r.id for r in kept.collect()] == [2]
    with pytest.raises(ValueError):
        drifters.checked_interval(100, 30, "output")
    assert drifters.seeded(spark, 0, 10, 0, 5, 5).count() == 6


def test_ar1_matches_its_recurrence(spark):
    a = noise.alpha(8, 48)
    w = np.random.default_rng(0).standard_normal(500)
    df = spark.createDataFrame([(i // 250, i, float(x)) for i, x in enumerate(w)], "k int, i int, w double")
    got = [r.x for r in noise.ar1(df, ["k"], "i", "w", a).orderBy("i").collect()]
    want = []
    for i, x in enumerate(w):
        want.append(x if i % 250 == 0 else a * want[-1] + math.sqrt(1 - a * a) * x)
    assert np.allclose(got, want, atol=1e-9)


def test_random_fields_of_one_wave_are_that_wave(spark):
    ph = spark.createDataFrame([(3, 1, 2, 0.125)], "member int, l int, p int, phi double")
    v = np.zeros((8, 16))
    for r in noise.random_fields(ph, ["member"], (8, 16), 2.0).collect():
        v[r.i, r.j] = r.value
    i, j = np.meshgrid(np.arange(8), np.arange(16), indexing="ij")
    wave = np.cos(2 * np.pi * (i / 8 + 2 * j / 16 + 0.125))
    assert v.max() > 0 and np.allclose(v, wave * (v[0, 0] / wave[0, 0]))


def test_upwind_step_keeps_the_integral(spark):
    f = spark.createDataFrame([(1, 1.0), (2, 0.0)], "elem_id long, h double")
    faces = spark.createDataFrame([(1, 2, 0.3), (2, 1, -0.3)], "elem_id long, neighbour long, flux double")
    area = spark.createDataFrame([(1, 1.0), (2, 1.0)], "elem_id long, area double")
    assert sorted(r.h for r in advection.upwind_step(f, faces, area, "h", 1.0).collect()) == pytest.approx([0.3, 0.7])


def test_floe_moments(spark):
    df = spark.createDataFrame([(100.0,), (10.0,)], "d double")
    smooth = [r[0] for r in df.select(spectral.floe_moment_smooth(F.col("d"), 20.0, 1.85, 1)).collect()]
    steps = [r[0] for r in df.select(spectral.floe_moment_steps(F.col("d"), 20.0, 0.9, 2.0, 1)).collect()]
    assert 20 < smooth[0] < 100 and smooth[1] == 20 and 20 < steps[0] < 100 and steps[1] == 20  # no floe is under the least size
    assert df.select(spectral.floe_moment_steps(F.lit(200.0), 20.0, 0.9, 2.0, 1)).first()[0] == pytest.approx(26.589, abs=1e-3)


@pytest.mark.parametrize("mean", [0.0, 17.0, 90.0, 180.0, 271.5, 350.0, -400.0])
def test_directional_shares_sum_to_one(spark, mean):
    low = F.col("id") * 22.5 - 11.25
    assert spark.range(16).select(F.sum(spectral.direction_share(low, low + 22.5, F.lit(mean)))).first()[0] == pytest.approx(1.0)


def test_strong_flow_keeps_mass_and_sign(spark):
    f = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 0.5)], "elem_id long, h double")
    faces = spark.createDataFrame([(1, 2, 9.0), (2, 1, -9.0), (2, 3, 7.0), (3, 2, -7.0), (3, None, -5.0), (1, None, -2.0)], "elem_id long, neighbour long, flux double").withColumn("closed", F.col("elem_id") == 3)
    area = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 3.0)], "elem_id long, area double")
    out = {r.elem_id: r.h for r in advection.upwind_step(f, faces, area, "h", 1.0).collect()}
    assert out == pytest.approx({1: 2 / 3, 2: 1 / 3, 3: 0.5})
    again = {r.elem_id: r.h for r in advection.upwind_step(f, faces, area, "h", 1.0, incoming=0.25).collect()}
    assert again[1] == pytest.approx(2 / 3 + 0.5)  # the open boundary brings its value


def test_weno_in_two_dimensions_keeps_mass_and_moves_with_the_flow(spark):
    g = spark.range(12 * 10).select((F.col("id") % 12).alias("i"), F.floor(F.col("id") / 12).alias("j")).withColumns({"h": F.when(F.col("i").between(3, 5) & F.col("j").between(3, 5), 1.0).otherwise(0.0), "u": F.lit(1.0), "v": F.lit(0.5)})
    out = advection.weno_step(g, "h", 0.25, (12, 10), {"i": "u", "j": "v"}).collect()
    assert sum(r.h for r in out) == pytest.approx(9.0) and len(out) == 120
    assert sum(r.h * r.i for r in out) / 9 == pytest.approx(4.25, abs=0.03) and sum(r.h * r.j for r in out) / 9 == pytest.approx(4.125, abs=0.03)


def test_blocks_and_halo(spark):
    axis = spark.range(10).select(F.col("id").alias("i"), (F.col("id") * 1.0).alias("v"))
    assert [r.i for r in fields.crop(axis, "i", "v", 0.5, 3.5, halo=2).orderBy("i").collect()] == [0, 1, 2, 3, 4, 5]
    g = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, -9.0)], "i int, j int, v double")
    assert gridmean.block_mean(g, 2, "v", fill=-9.0).first().v == 2


def test_nearest_vertex_has_no_radius(spark):
    """Points near, far and very far from a cluster; a tie; points without a place."""
    rng = np.random.default_rng(4)
    nodes = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 50, (60, 2)))] + [(90, math.nan, 0.0), (91, None, 0.0), (92, math.inf, 0.0)]
    places = [(float(x), float(y)) for s in (1, 40, 3000, 10**6) for x, y in rng.integers(-50, 100, (25, 2)) * s] + [(math.nan, 0.0), (None, 1.0), (math.inf, 0.0)]
    n = spark.createDataFrame(nodes, "node_id long, x double, y double")
    p = spark.createDataFrame([(i, *q) for i, q in enumerate(places)], "k long, px double, py double")
    got = {r.k: (r.d2, r.node_id) for r in locate.nearest_vertex(p, n, 3.0).collect()}
    want = {i: min(((px - x) ** 2 + (py - y) ** 2, k) for k, x, y in nodes[:60]) for i, (px, py) in enumerate(places[:100])}
    assert got == want | {i: (None, None) for i in (100, 101, 102)}
    assert {(r.node_id, r.d2) for r in locate.nearest_vertex(p, n.where("node_id > 89"), 3.0).collect()} == {(None, None)}


def test_catalogue():
    assert len(catalog.CATALOGUE) == 51 and sum(len(d.variables) for d in catalog.CATALOGUE.values()) == 171
    d = catalog.dataset("ERA5_nodes")
    assert d.path(date(2020, 3, 1), varstring="u10") == "ERA5_u10_y2020.nc" and d.frequency == "yearly"
    with pytest.raises(ValueError):
        catalog.dataset("none")


def test_files_around_a_day(spark, tmp_path):
    d = catalog.dataset("generic_ps_atm_nodes")
    assert d.days_around(date(2020, 1, 1)) == [date(2019, 12, 31), date(2020, 1, 1), date(2020, 1, 2)]
    assert catalog.dataset("asr_nodes").days_around(date(2020, 1, 31)) == [date(2019, 12, 1), date(2020, 1, 1), date(2020, 2, 1)]
    source = d.variables[0].source
    for day, t in (("20200101", 43829.0), ("20200102", 43830.0)):
        spark.createDataFrame([(1, t, 2.5)], f"node_id int, time double, `{source}` double").write.parquet(f"{tmp_path}/generic_ps_atm_{day}.nc")
    got = d.opened(spark, date(2020, 1, 1), ["node_id"], str(tmp_path)).orderBy("days").collect()
    assert [r.days for r in got] == [43829.0, 43830.0] and got[0][d.variables[0].name] == 2.5
    with pytest.raises(PySparkException):
        d.opened(spark, date(2021, 1, 1), ["node_id"], str(tmp_path))


def test_a_cyclic_grid_is_sampled_across_its_seam(spark):
    grid = spark.range(8).select((F.col("id") % 4).alias("i"), F.floor(F.col("id") / 4).alias("j"), (F.col("id") % 4 * 1.0).alias("tair"))
    p = spark.createDataFrame([(315.0, 45.0), (45.0, 0.0)], "px double, py double")
    got = catalog.dataset("ERA5_elements").sampled(p, grid, (0.0, 0.0), 90.0, (4, 2), "tair").orderBy("px").collect()
    assert [r.tair for r in got] == [0.5, 1.5]


def test_mesh_files(spark, tmp_path):
    text = "$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$PhysicalNames\n1\n1 7 \"coast\"\n$EndPhysicalNames\n$Nodes\n3\n1 0 0 0\n2 1 0 0\n3 0 1 0\n$EndNodes\n$Elements\n2\n1 1 2 7 1 1 2\n2 2 4 1 1 1 3 1 2 3\n$EndElements\n"
    (tmp_path / "a.msh").write_text(text)
    m = files.read_msh(spark, str(tmp_path / "a.msh"))
    assert m["node"].count() == 3 and m["name"].first().name == "coast"
    e = {r.elem_id: r for r in m["elem"].collect()}
    assert e[1].nodes == [1, 2] and e[1].physical == 7 and e[2].nodes == [1, 2, 3]
    raw = b"$MeshFormat\n2.2 1 8\n" + struct.pack("<i", 1) + b"\n$EndMeshFormat\n$Nodes\n2\n" + b"".join(struct.pack("<iddd", i, i, 2 * i, 0) for i in (1, 2)) + b"\n$EndNodes\n$Elements\n1\n" + struct.pack("<iii", 2, 1, 2) + struct.pack("<6i", 5, 1, 1, 1, 2, 3) + b"\n$EndElements\n"
    (tmp_path / "b.msh").write_bytes(raw)
    rows = files.read_msh_binary(spark, str(tmp_path / "b.msh")).collect()
    assert [r.nodes for r in rows if r.kind == "elem"] == [[1, 2, 3]] and [r.y for r in rows if r.kind == "node"] == [2.0, 4.0]


def test_definition_reads_every_line(spark, tmp_path):
    (tmp_path / "a.mpp").write_text("; a note: none\n" * 300 + "".join(f"Key {i}: {i}  ; note\n" for i in range(300)))
    assert files.definition(spark, str(tmp_path / "a.mpp")) == {f"key {i}": str(i) for i in range(300)}


def test_checkpoint_columns_and_buoys(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(struct.pack("<i2d", 2, 1.5, 2.5) + struct.pack("<i3i", 3, 1, 2, 3))
    got = [(r.name, r.value) for r in files.read_columns(spark, str(tmp_path / "f.bin"), [("x", "double"), ("id", "int")]).collect()]
    assert got == [("x", 1.5), ("x", 2.5), ("id", 1.0), ("id", 2.0), ("id", 3.0)]
    with pytest.raises(ValueError):
        files.read_columns(spark, "x", [("x", "string")])
    (tmp_path / "b.txt").write_text("Year Month Day Hour BuoyID Lat Lon\n2008 1 2 3 7 80.5 -10.25\n2008 1 2 4 7 80.6 -10.5\n")
    b = files.read_buoys(spark, str(tmp_path / "b.txt"))
    assert drifters.buoys_at(b.withColumn("t", F.col("ts")), F.lit("2008-01-02 04:00:00").cast("timestamp")).first().Lat == 80.6


def test_streamed_means_equal_the_batch(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_type", "value")
    df.write.parquet(str(tmp_path / "in"))
    s = streams.events(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double")
    q = streams.window_means(s, "ts", "6 hours", ["event_type"], "value").writeStream.format("memory").queryName("means").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window_start, r.event_type): r.n for r in spark.sql("SELECT * FROM means").collect()}
    want = {(r.window_start, r.event_type): r.n for r in gridmean.window_mean(df, F.col("ts"), "6 hours", ["event_type"], F.col("value")).collect()}
    assert got == want


def test_streamed_drifters(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, h), 0.0, 0.0, 1.0, 2.0, c, 0.5) for h, c in ((0, 1.0), (1, 1.0), (2, 0.5), (3, 1.0))]
    schema = "drifter_id long, ts timestamp, x double, y double, u double, v double, conc double, limit double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.drifters(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 86400).writeStream.format("memory").queryName("moves").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [(r.x, r.y, r.alive) for r in spark.sql("SELECT * FROM moves ORDER BY ts").collect()]
    assert got == [(0.0, 0.0, True), (1.0, 2.0, True), (2.0, 4.0, False)]


@pytest.mark.parametrize("restarted", [False, True])
def test_streamed_drifter_steps_equal_a_table_s(spark, tmp_path, restarted):
    """The order reset, begin, input and mask, output; micro-batches, and a restart in the middle, change nothing."""
    rng = np.random.default_rng(3)
    rows = [(d, t, float(d), float(-d), *map(float, rng.normal(size=2)), float(rng.uniform()), bool(rng.uniform() < 0.8)) for d in range(5) for t in range(30)]
    schema = "drifter_id long, t long, x double, y double, u double, v double, conc double, reported boolean"
    s = drifters.Schedule(2, 10, 4, 3, 0.3)
    want = sorted(map(tuple, drifters.run_steps(spark.createDataFrame(rows, schema), s).collect()))
    assert {r[5] for r in want} == {"last", "output"}
    restart, late = None, rows
    if restarted:
        late, kept = [r for r in rows if r[1] >= 13], []
        for d in range(5):
            for state, _ in drifters.drifter_steps(None, [r[1:] for r in rows if r[0] == d and r[1] < 13], s):
                pass
            kept.append((d, *state, 12))
        restart = spark.createDataFrame(kept, f"drifter_id long, {drifters.KEPT}, last long")
        want = [r for r in want if r[1] >= 13]
        late = late + [r for r in rows if r[1] == 12]  # comes again, and is dropped
    late.sort(key=lambda r: r[1])  # files come by time, in two batches
    for own in (late[: len(late) // 2], late[len(late) // 2 :]):
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = streams.drifter_updates(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), s, restart).writeStream.format("memory").queryName(f"steps{restarted}").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(tuple, spark.sql(f"SELECT * FROM steps{restarted}").collect())) == want


def test_start_at_restart():
    assert drifters.start_at_restart(10.5, 9.0, True) == 10.5 and drifters.start_at_restart(10.5, 20.25, False) == 21.5
    with pytest.raises(ValueError):
        drifters.start_at_restart(10.5, 11.0, True)


def test_other_inverse_projections_give_the_places_back(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(-80, 80, 300), rng.uniform(-180, 180, 300))], "lat double, lon double")
    m = geodesy.MapSpec(lon0=20.0, radius=6371.0)
    for name in ("homolosine", "integerized_sinusoidal"):
        lat, lon = geodesy.inverse(name, *geodesy.forward(name, F.col("lat"), F.col("lon"), m), m)
        for r in df.select("lat", "lon", lat.alias("a"), lon.alias("b")).collect():
            assert r.a == pytest.approx(r.lat, abs=1e-5) and r.b == pytest.approx(r.lon, abs=1e-4)
    zone, x, y = geodesy.utm(F.col("lat"), F.col("lon"))
    lat, lon = geodesy.utm_inverse(zone, x, y, F.col("lat") < 0)
    for r in df.select("lat", "lon", lat.alias("a"), lon.alias("b")).collect():
        assert r.a == pytest.approx(r.lat, abs=1e-5) and r.b == pytest.approx(r.lon, abs=1e-5)
    assert spark.range(1).select(*geodesy.inverse("orthographic", F.lit(7000.0), F.lit(0.0), m), *geodesy.inverse("homolosine", F.lit(-4000.0), F.lit(9000.0), m)).first()[0] is None


def test_texts_go_round(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [tuple(float(x) for x in rng.standard_normal(10) * 10.0 ** rng.integers(-9, 9, 10)) for _ in range(20)] + [(0.0, 1.0, -1.0, 0.9996, -0.09999, 123456.0, 1e-12, -5e20, 0.1, 10.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in files.RANDOM_FIELD))
    lines = files.random_field_lines(df)
    assert all(len(r.value) == 140 for r in lines.collect()) and "     0.100E+01    -0.100E+01     0.100E+01    -0.100E+00" in lines.collect()[-1].value
    lines.coalesce(1).write.text(str(tmp_path / "f"))
    got = files.read_random_field(spark, str(tmp_path / "f")).collect()
    assert np.allclose([list(r) for r in got], rows, rtol=1e-2, atol=0)
    syn = spark.createDataFrame([(1, 12345, *rows[0][:6])], "i int, j int, " + ", ".join(f"{c} double" for c in files.SYNOPTIC))
    files.synoptic_lines(syn).write.text(str(tmp_path / "s"))
    assert files.read_synoptic(spark, str(tmp_path / "s")).first()[:2] == (1, 12345)


def test_synoptic_texts_keep_seven_figures(spark, tmp_path):
    rows = [(999, 7, 1001.0, -5999.0, 0.0, 9999999.0, -1234567.0, -0.001234567), (1, 1, 59999.0, -50.0, 1e-9, 999000.0, 8.0, 123456.7)]
    df = spark.createDataFrame(rows, "i int, j int, " + ", ".join(f"{c} double" for c in files.SYNOPTIC))
    lines = files.synoptic_lines(df)
    assert {len(r.value) for r in lines.collect()} == {94}
    lines.coalesce(1).write.text(str(tmp_path / "s"))
    assert [tuple(r) for r in files.read_synoptic(spark, str(tmp_path / "s")).collect()] == rows


def test_meshes_and_matrices_go_round(spark, tmp_path):
    nodes, elems = mesh.lattice(spark, 3, 2, 1.5)
    lines = files.msh_text(nodes, elems).orderBy("part", "id").select("line").collect()
    (tmp_path / "m.msh").write_text("\n".join(r.line for r in lines) + "\n")
    held = files.read_msh(spark, str(tmp_path / "m.msh"))
    assert sorted(map(tuple, held["node"].select("node_id", "x", "y").collect())) == sorted(map(tuple, nodes.collect()))
    assert sorted((r.elem_id, list(r.nodes)) for r in held["elem"].collect()) == sorted((r.elem_id, list(r.nodes)) for r in elems.collect())
    files.write_mesh(nodes, elems, str(tmp_path / "t"))
    assert [t.count() for t in files.read_mesh(spark, str(tmp_path / "t"))] == [12, 12]
    grid = spark.range(12).select(F.floor(F.col("id") / 4).alias("i"), (F.col("id") % 4).alias("j"), (F.col("id") * 1.5).alias("v"))
    flat = files.matrix_bytes(grid, 4, "v")
    raw = b"".join(bytes(r.bytes) for r in flat.orderBy("i").collect())
    assert np.frombuffer(raw, "<f4").tolist() == [k * 1.5 for k in range(12)]
    assert sorted(r.value for r in files.window_of(flat, "<f4", 1, 2).collect()) == [k * 1.5 for k in range(4, 12)]


def test_polygon_crossings_and_vertices(spark):
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])
    row = spark.range(1).select(
        geometry.crossings(F.lit(-1.0), F.lit(1.0), F.lit(3.0), F.lit(1.0), square).alias("two"), geometry.crossings(F.lit(0.5), F.lit(0.5), F.lit(1.0), F.lit(1.5), square).alias("none"),
        geometry.in_convex(F.lit(2.0005), F.lit(2.0), square).alias("corner"), geometry.in_convex(F.lit(1.9995), F.lit(2.0), square, inclusive=False).alias("strict"), geometry.in_convex(F.lit(2.01), F.lit(1.0), square).alias("out"),
        geometry.lagrange2d([0.0, 1.0], [0.0, 2.0], [[1.0, 3.0], [2.0, 4.0]], F.lit(0.5), F.lit(1.0)).alias("l"),
    ).first()
    assert [tuple(p) for p in row.two] == [(2.0, 1.0), (0.0, 1.0)] and row.none == [] and row.corner and not row.strict and not row.out and row.l == 2.5


def test_clipping_many_pairs_at_once_equals_known_areas():
    tri = np.array([[(0, 0), (4, 0), (0, 4)], [(0, 0), (4, 0), (0, 4)], [(0, 0), (4, 0), (0, 4)], [(10, 10), (11, 10), (10, 11)]], float)
    box = np.array([[(0, 0), (2, 0), (2, 2), (0, 2)], [(1, 1), (9, 1), (9, 9), (1, 9)], [(-5, -5), (5, -5), (5, 5), (-5, 5)], [(0, 0), (1, 0), (1, 1), (0, 1)]], float)
    assert remap.clipped_areas(tri, box).tolist() == pytest.approx([4, 2, 8, 0])


def test_parts_of_a_mesh_are_even(spark):
    nodes, elems = mesh.lattice(spark, 16, 16, 1.0)
    n = [r["count"] for r in mesh.partitioned(mesh.barycentres(mesh.corners(elems, nodes)), 4, "bx", "by").groupBy("part").count().collect()]
    assert len(n) == 4 and min(n) > 100


def test_projection_is_kept_in_metadata(spark, tmp_path):
    name, m = files.map_spec({"map projection": "Polar Stereographic Ellipsoid", "map reference longitude": "-45", "map second reference latitude": "60"})
    files.with_projection(spark.range(1), "id", name, m).write.parquet(str(tmp_path / "p"))
    held = spark.read.parquet(str(tmp_path / "p")).schema["id"].metadata
    assert held["grid_mapping_name"] == "polar_stereographic" and "+lon_0=-45" in held["proj4"]
