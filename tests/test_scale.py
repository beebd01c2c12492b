"""Operators on inputs of unlike sizes, repeated rows and hot keys, by plain versions of themselves."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyre.functions import spectral
from gyre.operators import advection, asof, fields, grids, locate, mesh, noise, waves


def triangles(spark, rows):
    flat = [(i, *[float(c) for p in t for c in p]) for i, t in rows]
    return spark.createDataFrame(flat, "elem_id long, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")


def plain_location(rows, points):
    out = []
    for px, py in points:
        best = None
        for i, ((x1, y1), (x2, y2), (x3, y3)) in rows:
            j = (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)
            if j and px is not None and not math.isnan(px):
                a, b = ((x2 - px) * (y3 - py) - (x3 - px) * (y2 - py)) / j, ((px - x1) * (y3 - y1) - (x3 - x1) * (py - y1)) / j
                if min(a, b, 1 - a - b) >= -1e-11:
                    best = i if best is None else max(best, i)
        out.append(best)
    return out


@pytest.mark.parametrize("most", [100_000, 0])
def test_location_among_elements_of_very_unlike_sizes(spark, monkeypatch, most):
    """Elements a thousand times each other's size, flat ones, repeated points, points without a place; broadcast and shuffled."""
    monkeypatch.setattr(locate, "BROADCAST_ELEMENTS", most)
    rng = np.random.default_rng(2)
    rows = [(i, [tuple(rng.uniform(0, 1000, 2)) for _ in range(3)]) for i in range(6)]
    rows += [(i, [tuple(c + rng.uniform(0, 2, 2)) for _ in range(3)]) for i, c in enumerate(rng.uniform(0, 1000, (150, 2)), 10)]
    rows += [(900, [(1, 1), (2, 2), (3, 3)]), (901, [(5, 5), (5, 5), (5, 5)])]
    points = [tuple(map(float, p)) for p in rng.uniform(0, 1000, (200, 2))] + [tuple(float(v) for v in np.mean(t, axis=0)) for _, t in rows[6:60]]
    points += points[:20] + [(None, 1.0), (float("nan"), 2.0), (-50.0, 2000.0)]
    df = spark.createDataFrame([(n % 7, x, y) for n, (x, y) in enumerate(points)], "k int, px double, py double")
    got = [(r.k, repr(r.px), r.py, r.elem_id) for r in locate.in_triangles(df, triangles(spark, rows), 1.0).collect()]
    want = [(n % 7, repr(x), y, e) for n, ((x, y), e) in enumerate(zip(points, plain_location(rows, points)))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r.elem_id for r in locate.in_triangles(df, triangles(spark, []), 1.0).collect()} == {None}


def test_location_with_few_elements_moves_no_point(spark):
    nodes, elems = mesh.lattice(spark, 4, 4, 1.0)
    df = spark.range(100).select("id", (F.col("id") % 10 / 3.0).alias("px"), (F.col("id") % 7 / 2.0).alias("py"))
    plan = locate.in_triangles(df, mesh.corners(elems, nodes), 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "NestedLoop" not in plan


def test_nearest_vertex_of_repeated_rows_and_crowds(spark):
    """Half of the nodes lie in a hundredth of the domain; rows that share a key or a place keep their own answers."""
    rng = np.random.default_rng(5)
    nodes = np.concatenate([rng.uniform(0, 100, (400, 2)), rng.uniform(50, 51, (400, 2))])
    points = np.concatenate([rng.uniform(-20, 120, (150, 2)), rng.uniform(50, 51, (50, 2))])
    rows = [(n % 9, float(x), float(y)) for n, (x, y) in enumerate(points)] * 2
    n = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(nodes)], "node_id long, x double, y double")
    p = spark.createDataFrame([*rows, (1, float("nan"), 0.0), (None, 3.0, None)], "k int, px double, py double")
    got = sorted((r.k, r.px, r.py, r.node_id) for r in locate.nearest_vertex(p, n).where("node_id is not null").collect())
    assert got == sorted((k, x, y, int(np.argmin((nodes[:, 0] - x) ** 2 + (nodes[:, 1] - y) ** 2))) for k, x, y in rows)
    close = locate.too_close(p, n, 2.0)
    assert close.count() == len(rows) + 2
    assert {(r.px, r.py): r.close for r in close.where("px is not null and py is not null and not isnan(px)").collect()} == {(x, y): bool(((nodes[:, 0] - x) ** 2 + (nodes[:, 1] - y) ** 2).min() <= 4) for _, x, y in rows}


def test_crowded_nodes_begin_with_small_buckets(spark):
    n = spark.range(30_000).select(F.col("id").alias("node_id"), (F.rand(1) * 30).alias("x"), (F.rand(2) * 30).alias("y")).union(spark.createDataFrame([(30_000, 1000.0, 1000.0)], "node_id long, x double, y double"))
    size = locate.first_size(n)
    by = n.groupBy(F.floor(F.col("x") / size), F.floor(F.col("y") / size)).count().agg(F.max("count")).first()[0]
    assert by <= 100  # of 30000 in one bucket of 30


def test_numbers_are_gapless_and_in_order_though_one_group_holds_all(spark):
    rows = spark.range(5000).select((F.xxhash64("id") % 1000).alias("k"), F.lit(1).alias("g"), "id")
    got = fields.renumbered(rows.repartition(7), ["k", "id"], "g").orderBy("new_id").collect()
    assert [r.new_id for r in got] == list(range(5000)) and [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)
    assert fields.renumbered(rows.where("id < 0"), ["k"]).count() == 0


def test_intervals_across_buckets_equal_a_whole_series_window(spark):
    rng = np.random.default_rng(8)
    rows = [("a", int(t), float(t) * 2) for t in np.unique(rng.integers(0, 10_000, 400))] + [("b", 5, 1.0), ("b", 9_000, 2.0), ("c", 7, 3.0)]
    s = spark.createDataFrame(rows, "k string, t long, v double")
    want = []
    for k in "abc":
        own = sorted(r for r in rows if r[0] == k)
        want += [(k, a[1], a[2], b and b[1], b and b[2]) for a, b in zip(own, [*own[1:], None])]
    assert sorted(map(tuple, asof.intervals(s, ["k"], "t", "v", 100).collect())) == sorted(want)


def test_lattices_join_axes_by_number(spark):
    lats = spark.createDataFrame([(j, 10.0 * j) for j in (3, 5, 9)], "j long, lat double")
    lons = spark.createDataFrame([(i, 1.5 * i) for i in range(4)], "i long, lon double")
    g = grids.from_axes(lats, lons)
    assert sorted(map(tuple, g.collect())) == sorted((i, j, 10.0 * j, 1.5 * i) for j in (3, 5, 9) for i in range(4))
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    cut = grids.lon_range(spark.createDataFrame([(0, 0.0), (1, 180.0), (2, 359.0)], "i long, lon double")).first()
    assert (cut.least, cut.most, cut.cut) == (0.0, 359.0, 0.0)


def test_fluxes_keep_what_the_open_sides_don_t_let_out(spark):
    nodes, elems = mesh.lattice(spark, 6, 5, 1.0)
    k = F.col("node_id")
    nodes = nodes.withColumns({"x": F.col("x") + k * 7 % 5 * 0.05, "y": F.col("y") + k * 3 % 7 * 0.04, "u": k % 3 - 1.0, "v": k % 4 * 0.5 - 0.7, "closed": F.col("x") < 5.5})
    turned = elems.withColumn("nodes", F.when(F.col("elem_id") % 2 == 0, F.reverse("nodes")).otherwise(F.col("nodes")))  # of both turns
    faces = advection.oriented_faces(turned, nodes, "u", "v", "closed")
    rows = faces.collect()
    flux = {(r.elem_id, r.neighbour): r.flux for r in rows if r.neighbour is not None}
    assert flux and all(abs(f + flux[b, a]) < 1e-12 for (a, b), f in flux.items())
    area = mesh.geometry(mesh.corners(turned, nodes)).select("elem_id", "area")
    sizes = {r.elem_id: r.area for r in area.collect()}
    h = turned.select("elem_id", (F.col("elem_id") % 5 + 1.0).alias("h"))
    before = {r.elem_id: r.h for r in h.collect()}
    dt = 0.3
    after = {r.elem_id: r.h for r in advection.upwind_step(h, faces, area, "h", dt, incoming=2.0).collect()}
    out = sum(min(r.flux, sizes[r.elem_id] / dt / 3) * before[r.elem_id] for r in rows if r.neighbour is None and r.flux > 0)
    into = sum(-r.flux * 2.0 for r in rows if r.neighbour is None and r.flux < 0 and not r.closed)
    mass = lambda f: sum(f[e] * sizes[e] for e in sizes)
    assert mass(after) == pytest.approx(mass(before) + dt * (into - out)) and into > 0 and out > 0


def test_random_fields_have_the_asked_covariance(spark):
    """Sixty fields of a thousand places; the correlation along i after ``length`` cells is exp(-1), before the waves l = 0 lose half of their share."""
    n, length = 32, 4.0
    ph = spark.range(60 * 17 * n).select(F.floor(F.col("id") / (17 * n)).alias("member"), (F.floor(F.col("id") / n) % 17).alias("l"), (F.col("id") % n).alias("p"), F.rand(7).alias("phi"))
    got = noise.random_fields(ph, ["member"], (n, n), length)
    v = np.zeros((60, n, n))
    for r in got.collect():
        v[r.member, r.i, r.j] = r.value
    k = np.arange(-15, 17) * 2 * np.pi / n
    share = 1 / np.exp(-2 * (k / noise.wave_width(n, length)) ** 2).sum()
    assert abs(v.mean()) < 0.1 and (v**2).mean() == pytest.approx(1 - share / 2, abs=0.03)
    assert (v * np.roll(v, 4, axis=1)).mean() / (v**2).mean() == pytest.approx((math.exp(-1) - share / 2) / (1 - share / 2), abs=0.03)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(member") >= 2  # lines of one way, then of the other


def test_wave_roots_solve_their_relations(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 2.0)], "elem_id long, thickness double")
    for r in waves.wave_medium(df, [0.05, 0.1, 0.15]).collect():
        h = 0.5 if r.elem_id == 1 else 2.0
        d = 5.49e9 * h**3 / 12 / (1 - 0.09)
        unit = (d / 1025 / r.omega**2) ** 0.2
        under = (d * r.k_ice**4 / (1025 * 9.81) + 1 - 922.5 * h * r.omega**2 / (1025 * 9.81)) * 9.81 * r.k_ice * math.tanh(r.k_ice * 4 * unit)
        assert under == pytest.approx(r.omega**2, rel=1e-9)
        assert 9.81 * r.k_water * math.tanh(r.k_water * (4 * unit + 0.9 * h)) == pytest.approx(r.omega**2, rel=1e-9)
        assert r.damping > 0 and 0 < r.admittance


def test_moments_of_large_floes_are_their_size(spark):
    df = spark.createDataFrame([(300.0,)], "d double")
    assert [df.select(spectral.mean_floe_size(F.lit(True), F.col("d"), 200.0, 20.0, 0.9, 2.0, m)).first()[0] for m in (1, 2)] == [300.0, 300.0]


def test_points_of_one_place_cost_one_search(spark):
    """A third of all rows at one place: the crowd is looked up once."""
    n = spark.range(2000).select(F.col("id").alias("node_id"), (F.col("id") % 50).cast("double").alias("x"), F.floor(F.col("id") / 50).cast("double").alias("y"))
    p = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, 7.3).otherwise(F.col("id") % 40).alias("px"), F.when(F.col("id") % 3 == 0, 7.1).otherwise(F.col("id") % 39).cast("double").alias("py"))
    began = time.time()
    assert locate.nearest_vertex(p, n).where("id % 3 = 0").select("node_id").distinct().collect()[0][0] == 7 * 50 + 7
    assert time.time() - began < 60


def test_a_hot_series_is_folded_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [("hot", n, float(v)) for n, v in enumerate(rng.normal(size=900))] + [("b", 5, 1.5), ("b", 7, -2.0)]
    monkeypatch.setattr(noise, "BLOCK", 100)
    got = {(r.k, r.n): r.x for r in noise.ar1(spark.createDataFrame(rows, "k string, n long, v double").repartition(3), ["k"], "n", "v", 0.7).collect()}
    want, b = {}, math.sqrt(1 - 0.49)
    for k in ("hot", "b"):
        x = None
        for _, n, v in sorted(r for r in rows if r[0] == k):
            x = v if x is None else 0.7 * x + b * v
            want[k, n] = x
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
