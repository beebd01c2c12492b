"""No side that grows with the data is broadcast on Spark's guess of its size, however small its files are here."""

import pytest
from pyspark.sql import functions as F

from gyre.operators import grids, locate, mesh, remap
from gyre.plans import field_queries, file_queries, forcing_queries, mesh_queries  # noqa: F401  # they register their queries
from gyre.plans import queries as plans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["advected_directions", "node_hminmax", "upwind_advection", "reordered_mesh", "remap_mesh_to_mesh"])
def test_query_broadcasts_nothing(spark, sf, name):
    assert "Broadcast" not in plan_of(plans.QUERIES[name](spark, sf))


def test_cubic_values_broadcast_no_place(spark):
    """Each place asks for sixteen cells, which Spark's guess of its size leaves out."""
    cells = spark.range(400).select((F.col("id") % 20).alias("i"), F.floor(F.col("id") / 20).alias("j"), F.col("id").cast("double").alias("v"))
    places = spark.range(300).select("id", (F.col("id") % 17 + 1.25).alias("col"), (F.col("id") % 13 + 2.5).alias("row"))
    got = grids.cubic_values(places, cells, ["id"], "v")
    assert "Broadcast" not in plan_of(got)
    assert got.count() == 300 and got.where("v is null").count() == 0


def test_location_beyond_the_count_broadcasts_nothing(spark, sf, monkeypatch):
    """A step of drifters among more elements than are broadcast: Spark's guess doesn't bring them back."""
    monkeypatch.setattr(locate, "BROADCAST_ELEMENTS", 0)
    got = mesh_queries.drifter_step(spark, sf)
    assert "Broadcast" not in plan_of(got)
    assert got.count() > 0


def test_mesh_overlaps_broadcast_nothing(spark, sf):
    nodes, elems = mesh_queries.part_mesh(spark, sf)
    moved = mesh.corners(elems, nodes.withColumn("x", F.col("x") + 0.5 * (F.col("node_id") % 2)))
    assert "Broadcast" not in plan_of(remap.mesh_overlaps(mesh.corners(elems, nodes), moved, 5.0))


def test_mesh_to_grid_broadcasts_nothing(spark, sf):
    w, field, _ = mesh_queries.raster_weights(spark, sf)
    assert "Broadcast" not in plan_of(w) and "Broadcast" not in plan_of(remap.mesh_to_grid(w, field, 100.0, "v"))
