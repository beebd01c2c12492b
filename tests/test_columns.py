"""Checkpoints written by some tasks and read by others."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyre.sources import columns, files

KINDS = [("id", "int"), ("M_VT", "double"), ("M_conc", "float")]


def table(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.name, r.place)):
        out.setdefault(r.name, []).append(r.value)
        assert r.place == len(out[r.name]) - 1
    return out


@pytest.mark.parametrize("tasks, piece", [(1, 10_000), (5, 7), (3, 100)])
def test_columns_of_some_tasks_are_read_by_others(spark, tmp_path, tasks, piece):
    rows = spark.range(500).select((499 - F.col("id")).alias("id"), (F.col("id") / 7).alias("M_VT"), (F.col("id") % 11 / 4).alias("M_conc"))
    path = str(tmp_path / "field")
    columns.write_columns(rows.repartition(tasks), path, "id", KINDS)
    got = columns.read_columns(spark, path, KINDS, piece)
    want = {"id": list(map(float, range(500))), "M_VT": [(499 - k) / 7 for k in range(500)], "M_conc": [float(np.float32((499 - k) % 11 / 4)) for k in range(500)]}
    assert table(got) == want
    assert got.rdd.getNumPartitions() >= 3 * (500 // piece or 1)
    assert (tmp_path / "field" / columns.RECORDS).read_text().splitlines()[0] == "id int 500 0 499"
    records = {r.name: (r.type, r.size, r.least, r.most) for r in files.read_records(spark, f"{path}/{columns.RECORDS}").collect()}
    assert records["M_conc"] == ("float", 500, 0.0, 2.5)
    assert not list((tmp_path / "field").glob(".part*"))


def test_a_single_file_with_columns_of_unlike_lengths(spark, tmp_path):
    raw = b"".join(struct.pack("<i", len(v)) + np.array(v, columns.KINDS[k]).tobytes() for v, k in (([3, 1, 2, 9, 8], "int"), ([0.5, -2.25], "double"), ([], "float")))
    (tmp_path / "mesh.bin").write_bytes(raw)
    kinds = [("Elements", "int"), ("Nodes_x", "double"), ("none", "float")]
    got = columns.read_columns(spark, f"file://{tmp_path}/mesh.bin", kinds, 2)
    assert table(got) == {"Elements": [3.0, 1.0, 2.0, 9.0, 8.0], "Nodes_x": [0.5, -2.25]}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, files.read_columns(spark, str(tmp_path / "mesh.bin"), kinds).collect()))
    with pytest.raises(ValueError):
        columns.kinds_of("a:text")


def test_empty_checkpoints(spark, tmp_path):
    path = str(tmp_path / "none")
    columns.write_columns(spark.range(0).select("id", F.lit(1.0).alias("M_VT"), F.lit(1.0).alias("M_conc")), path, "id", KINDS)
    assert columns.read_columns(spark, path, KINDS).count() == 0
