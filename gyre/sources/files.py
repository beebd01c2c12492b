"""Readers and writers of mesh files, checkpoint columns, flat matrices, buoy and random-field texts, and map definitions."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.functions import geodesy, timeconv

#: Columns of buoy texts (fixed values).
BUOY_T = "Year int, Month int, Day int, Hour int, BuoyID long, Lat double, Lon double"


# -- meshes (MSH, version 2) ------------------------------------------------------------------
def _sections(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, words, line) of the lines of text meshes, by as many tasks as files have splits.

    A line's place is its split's offset and its number there; its section is that of the last mark before it.  Marks are a few a file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k")).alias("at"), F.regexp_replace("value", r"\r$", "").alias("line"))
    marks = lines.where(F.col("line").startswith("$")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", F.regexp_replace("line", r"[\$\s]", "").alias("mark")))).alias("marks"))
    own = lines.where(~F.col("line").startswith("$")).join(marks, "file")
    before = F.filter("marks", lambda m: m["at"] < F.col("at"))
    return own.select("file", F.try_element_at(before, F.lit(-1))["mark"].alias("section"), F.split(F.trim("line"), r"\s+").alias("words"), "line")


def read_msh(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables node(node_id, x, y, z), elem(elem_id, type, physical, elementary, parts, nodes) and name(dim, id, name) of text meshes.

    Elements other than triangles (type 2) stay in elem with their type; the first of
    the partition tags is the owner, the others are ghosts.
    """
    rows = _sections(spark, path).where(F.size("words") > 1)  # a section's first line is its count
    w = F.col("words")
    nodes = rows.where("section = 'Nodes'").select("file", w[0].cast("long").alias("node_id"), *[w[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")])
    tags = w[2].cast("int")
    elems = rows.where("section = 'Elements'").select(
        "file", w[0].cast("long").alias("elem_id"), w[1].cast("int").alias("type"), F.when(tags > 0, F.try_element_at(w, F.lit(4)).cast("int")).alias("physical"), F.when(tags > 1, F.try_element_at(w, F.lit(5)).cast("int")).alias("elementary"),
        F.when(tags > 3, F.transform(F.slice(w, F.lit(7), F.greatest(tags - 3, F.lit(0))), lambda x: F.abs(x.cast("int")))).alias("parts"), F.slice(w, tags + 4, F.size(w)).cast("array<bigint>").alias("nodes"),
    )
    names = rows.where("section = 'PhysicalNames'").select("file", w[0].cast("int").alias("dim"), w[1].cast("int").alias("id"), F.regexp_extract("line", '"(.*)"', 1).alias("name"))
    return {"node": nodes, "elem": elems, "name": names}


def msh_lines(nodes: DataFrame, elems: DataFrame) -> DataFrame:
    """(part, id, line) of a text mesh's node and element sections; sorted by part and id they are its body."""
    n = nodes.select(F.lit(0).alias("part"), F.col("node_id").alias("id"), F.format_string("%d %.12g %.12g %.12g", "node_id", "x", "y", F.lit(0.0)).alias("line"))
    e = elems.select(F.lit(1).alias("part"), F.col("elem_id").alias("id"), F.concat(F.format_string("%d 2 2 0 0 ", "elem_id"), F.array_join(F.col("nodes").cast("array<string>"), " ")).alias("line"))
    return n.union(e)


def msh_text(nodes: DataFrame, elems: DataFrame) -> DataFrame:
    """(part, id, line) of a whole text mesh, with its format, counts and section marks; in this order ``read_msh`` reads it back."""
    body = msh_lines(nodes, elems).withColumn("part", 2 * F.col("part") + 1)
    n, e = nodes.count(), elems.count()
    heads = [(0, -3, "$MeshFormat"), (0, -2, "2.2 0 8"), (0, -1, "$EndMeshFormat"), (0, 0, "$Nodes"), (0, 1, str(n)), (2, 0, "$EndNodes"), (2, 1, "$Elements"), (2, 2, str(e)), (4, 0, "$EndElements")]
    return body.union(nodes.sparkSession.createDataFrame(heads, "part int, id long, line string"))


NODES_PER_TYPE = {1: 2, 2: 3, 15: 1}  # line, triangle, point (fixed values)


def read_msh_binary(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, type, tags, nodes, x, y, z) of binary meshes; kind is node or elem."""
    schema = "kind string, id long, type int, tags array<int>, nodes array<long>, x double, y double, z double"

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                at = raw.index(b"$Nodes\n") + 7
                end = raw.index(b"\n", at)
                n, at = int(raw[at:end]), end + 1
                rec = np.frombuffer(raw, np.dtype([("id", "<i4"), ("xyz", "<f8", 3)]), n, at)
                none = [None] * n
                yield pa.RecordBatch.from_pydict({"kind": ["node"] * n, "id": rec["id"].astype(np.int64), "type": none, "tags": none, "nodes": none, "x": rec["xyz"][:, 0], "y": rec["xyz"][:, 1], "z": rec["xyz"][:, 2]}, ARROW_MSH)
                at = raw.index(b"$Elements\n", at + rec.nbytes) + 10
                end = raw.index(b"\n", at)
                total, at, rows = int(raw[at:end]), end + 1, []
                while len(rows) < total:
                    kind, many, tags = struct.unpack_from("<iii", raw, at)
                    width = 1 + tags + NODES_PER_TYPE[kind]
                    block = np.frombuffer(raw, "<i4", many * width, at + 12).reshape(many, width)
                    rows += [{"kind": "elem", "id": int(b[0]), "type": kind, "tags": b[1 : 1 + tags].tolist(), "nodes": b[1 + tags :].tolist()} for b in block]
                    at += 12 + block.nbytes
                yield pa.RecordBatch.from_pylist(rows, ARROW_MSH)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


ARROW_MSH = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("type", pa.int32()), ("tags", pa.list_(pa.int32())), ("nodes", pa.list_(pa.int64())), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])


# -- checkpoints: a text of records beside length-prefixed columns -----------------------------
def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, name, type, size, least, most)."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.trim("value"), r"\r?\n")).alias("place", "line"))
    w = F.split(F.trim("line"), r"\s+")
    return rows.where(F.trim("line") != "").select("file", "place", w[0].alias("name"), w[1].alias("type"), w[2].cast("long").alias("size"), w[3].cast("double").alias("least"), w[4].cast("double").alias("most"))


def read_columns(spark: SparkSession, path: str, records: list[tuple[str, str]]) -> DataFrame:
    """(name, place, value) of files of length-prefixed columns in the order of the records (name, type); int, float and double only."""
    kinds = {"int": "<i4", "float": "<f4", "double": "<f8"}
    for name, kind in records:
        if kind not in kinds:
            raise ValueError(f"{name} has the unknown type {kind}")

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                at = 0
                for name, kind in records:
                    n = struct.unpack_from("<i", raw, at)[0]
                    v = np.frombuffer(raw, kinds[kind], n, at + 4)
                    at += 4 + v.nbytes
                    for a in range(0, n, 100_000):
                        own = v[a : a + 100_000].astype(np.float64)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array(np.arange(a, a + len(own))), pa.array(own)], names=["name", "place", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "name string, place long, value double")


def write_fields(field: DataFrame, path: str, key: str, names: list[str], precision: str = "float") -> DataFrame:
    """Writes columns as Parquet (``Time`` always double, the others in the precision) and returns their records (name, type, size, least, most)."""
    kinds = {n: "double" if n == "Time" else precision for n in names}
    out = field.select(key, *[F.col(n).cast(kinds[n]).alias(n) for n in names])
    out.write.mode("overwrite").parquet(path)
    one = out.agg(F.count("*").alias("size"), *[f(n).cast("double").alias(f"{p}_{n}") for n in names for p, f in (("l", F.min), ("m", F.max))])
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(kinds[n]).alias("type"), F.col("size"), F.col(f"l_{n}").alias("least"), F.col(f"m_{n}").alias("most")) for n in names])
    return one.select(F.explode(items).alias("r")).select("r.*")


def read_matrix(spark: SparkSession, path: str, rows: int, cols: int, kind: str = "<f4") -> DataFrame:
    """(i, j, value) of flat binary matrices."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                m = np.frombuffer(raw, kind, rows * cols).reshape(rows, cols)
                for i in range(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(cols, i, np.int64)), pa.array(np.arange(cols)), pa.array(m[i].astype(np.float64))], names=["i", "j", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "i long, j long, value double")


# -- texts -------------------------------------------------------------------------------------
def read_buoys(spark: SparkSession, path: str) -> DataFrame:
    """Buoy rows (one header line, blanks between) with ts."""
    rows = spark.read.schema(BUOY_T).csv(path, sep=" ", header=True, ignoreLeadingWhiteSpace=True)
    return rows.withColumn("ts", F.make_timestamp("Year", "Month", "Day", "Hour", F.lit(0), F.lit(0.0)))


def drifter_line_columns() -> list[Column]:
    t = F.col("ts")
    return [F.format_string("%4d %02d %02d %02d %d %.5f %.5f %.5f", F.year(t), F.month(t), F.day(t), F.hour(t), "drifter_id", "lat", "lon", "conc").alias("value")]


def drifter_lines(rows: DataFrame) -> DataFrame:
    """Text lines of drifters (ts, drifter_id, lat, lon, conc), five decimals."""
    return rows.select(*drifter_line_columns())


def records_before(rows: DataFrame, restart: Column) -> DataFrame:
    """What stays of an output when a run begins again at a time: appending the new rows repeats nothing."""
    return rows.where(F.col("ts") < restart)


#: Columns of random-field texts (fixed values).
RANDOM_FIELD = ("slp", "taux", "tauy", "wndspd", "airtmp", "relhum", "clouds", "precip", "sss", "sst")


def exponent_form(c: Column, width: int = 14, digits: int = 3) -> Column:
    """A number as 0.ddd times a power of ten, right-aligned: the E edit of Fortran, which leaves no blank between full columns."""
    x = F.abs(c.cast("double"))
    e = F.when(x > 0, F.floor(F.log10(x)) + 1).otherwise(0)
    m = F.round(x / F.pow(F.lit(10.0), e), digits)
    e, m = F.when(m >= 1, e + 1).when((m < 0.1) & (x > 0), e - 1).otherwise(e), F.when(m >= 1, m / 10).when((m < 0.1) & (x > 0), m * 10).otherwise(m)
    text = F.concat(F.when(c < 0, "-").otherwise(""), F.format_string(f"%.{digits}f", m), F.lit("E"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("int").cast("string"), 2, "0"))
    return F.lpad(text, width, " ")


def fixed_width(spark: SparkSession, path: str, fields: list[tuple[str, int, str]]) -> DataFrame:
    """Lines of fields (name, width, type), read by position."""
    at, out = 1, []
    for name, width, kind in fields:
        out.append(F.trim(F.substring("value", at, width)).cast(kind).alias(name))
        at += width
    return spark.read.text(path).where(F.trim("value") != "").select(*out)


def read_random_field(spark: SparkSession, path: str) -> DataFrame:
    return fixed_width(spark, path, [(c, 14, "double") for c in RANDOM_FIELD])


def random_field_lines(rows: DataFrame) -> DataFrame:
    """Ten numbers of 14 places a line."""
    return rows.select(F.concat(*[exponent_form(F.col(c)) for c in RANDOM_FIELD]).alias("value"))


#: Columns of synoptic texts (fixed values).
SYNOPTIC = ("uwind", "vwind", "airtmp", "slp", "precip", "relhum")


def read_synoptic(spark: SparkSession, path: str) -> DataFrame:
    return fixed_width(spark, path, [("i", 5, "int"), ("j", 5, "int"), *[(c, 14, "double") for c in SYNOPTIC]])


def synoptic_lines(rows: DataFrame) -> DataFrame:
    """Two numbers of five places and six of 14 a line, with seven figures: as many as the places hold."""
    return rows.select(F.concat(*[F.lpad(F.col(c).cast("string"), 5, " ") for c in "ij"], *[exponent_form(F.col(c), digits=7) for c in SYNOPTIC]).alias("value"))


#: The header of drifter texts (fixed value).
DRIFTER_HEADER = "Year Month Day Hour BuoyID Lat Lon Concentration"


def drifter_text(rows: DataFrame, header: bool = True) -> DataFrame:
    """(at, value): the header and the lines of drifters; written sorted by ``at`` they are a drifter file."""
    lines = rows.select((F.unix_micros("ts") + 1).alias("at"), "drifter_id", *drifter_line_columns()).select("at", "value")
    return rows.sparkSession.createDataFrame([(-(1 << 62), DRIFTER_HEADER)], "at long, value string").union(lines) if header else lines


def append_drifters(rows: DataFrame, path: str) -> None:
    """Appends (time, drifter_id, lat, lon, sic) records of rows (ts, drifter_id, lat, lon, conc) as Parquet."""
    rows.select(timeconv.datenum(F.col("ts")).alias("time"), "drifter_id", "lat", "lon", F.col("conc").alias("sic")).write.mode("append").parquet(path)


def write_mesh(nodes: DataFrame, elems: DataFrame, path: str) -> None:
    """A mesh as two tables, ``nodes`` and ``elements``."""
    nodes.select("node_id", "x", "y").write.mode("overwrite").parquet(f"{path}/nodes")
    elems.select("elem_id", "nodes").write.mode("overwrite").parquet(f"{path}/elements")


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/elements")


def matrix_bytes(grid: DataFrame, cols: int, value: str, kind: str = "<f4") -> DataFrame:
    """(i, bytes): each row of a grid (i, j, value) as flat binary; one after another they are the matrix.  A missing cell is zero; a row is one task's at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = np.zeros(cols, kind)
        row[pdf.j.to_numpy()] = pdf[value].to_numpy()
        return pd.DataFrame({"i": [int(pdf.i.iloc[0])], "bytes": [row.tobytes()]})

    return grid.select("i", "j", value).groupBy("i").applyInPandas(run, "i long, bytes binary")


def window_of(matrix: DataFrame, kind: str, first: int, count: int) -> DataFrame:
    """(i, j, value) of a range of rows of ``matrix_bytes``: other rows are not read."""

    def run(batches):
        for p in batches:
            for i, raw in zip(p.i, p.bytes):
                v = np.frombuffer(raw, kind).astype(float)
                yield pd.DataFrame({"i": i, "j": np.arange(len(v)), "value": v})

    return matrix.where(F.col("i").between(first, first + count - 1)).mapInPandas(run, "i long, j long, value double")


def map_spec(held: dict[str, str]) -> tuple[str, geodesy.MapSpec]:
    """(projection, MapSpec) of a map definition; keys it lacks have the usual values."""
    number = lambda *keys, default: next((float(held[k].split()[0]) for k in keys if k in held), default)
    name = held.get("map projection", "polar_stereographic").strip().lower().replace(" ", "_").removesuffix("_ellipsoid") if "map projection" in held else "polar_stereographic"
    base = geodesy.MapSpec()
    spec = geodesy.MapSpec(
        lat0=number("map reference latitude", default=base.lat0), lon0=number("map reference longitude", default=base.lon0), lat1=number("map second reference latitude", default=base.lat1),
        rotation=number("map rotation", default=base.rotation), scale=number("map scale", default=base.scale), radius=number("map equatorial radius", default=base.radius), ecc=number("map eccentricity", default=base.ecc),
    )
    return name, spec


def projection_metadata(name: str, m: geodesy.MapSpec) -> dict[str, str | float]:
    """Attributes of a grid's projection, for a column's metadata, with its proj4 text."""
    minor = m.radius * math.sqrt(1 - m.ecc * m.ecc)
    proj4 = f"+proj=stere +a={m.radius * 1000:g} +b={minor * 1000:.3f} +lat_0={m.lat0:g} +lat_ts={m.lat1:g} +lon_0={m.lon0 - m.rotation:g}"
    return {"grid_mapping_name": name, "standard_parallel": m.lat1, "latitude_of_projection_origin": m.lat0, "straight_vertical_longitude_from_pole": m.lon0 - m.rotation, "semi_major_axis": m.radius * 1000, "semi_minor_axis": minor * 1000, "proj4": proj4}


def with_projection(grid: DataFrame, column: str, name: str, m: geodesy.MapSpec) -> DataFrame:
    """The grid with the projection's attributes in the metadata of one of its columns; Parquet keeps them."""
    return grid.withMetadata(column, projection_metadata(name, m))


#: A definition file with more keys than this is refused.
MOST_KEYS = 100_000


def definition(spark: SparkSession, path: str) -> dict[str, str]:
    """Keys and values of a map or grid definition file (lines ``key: value``, all of them)."""
    own = spark.read.text(path).select(F.substring_index("value", ";", 1).alias("value")).where(F.col("value").contains(":"))
    lines = [r.value for r in own.limit(MOST_KEYS + 1).collect()]
    if len(lines) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys in {path}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


# -- gridded output ------------------------------------------------------------------------------
def write_grid_means(means: DataFrame, path: str, ts: Column, period: str, days: float) -> None:
    """Appends records with their time bounds (the mean's half length about the time) to one folder for each period."""
    half = F.make_dt_interval(secs=F.lit(days * 43200.0))
    out = means.withColumns({"time": timeconv.datenum(ts), "bound0": timeconv.datenum(ts - half), "bound1": timeconv.datenum(ts + half), "period": timeconv.period_key(ts, period)})
    out.write.mode("append").partitionBy("period").parquet(path)
