"""Grids as tables: axes and lattices with geographic and map coordinates, cells of map grids, cyclic columns and pole rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyre.functions import geodesy, geometry
from gyre.joins import dealt

NEIGHBOURS = ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))


def lon_range(nodes: DataFrame, lon: str = "lon", column: str = "i") -> DataFrame:
    """One row: the least and greatest of the first and the last column's longitudes, and the branch cut: longitudes count from the least on."""
    ends = nodes.agg(F.min(column), F.max(column)).first()  # two numbers
    at = nodes.where(F.col(column).isin([e for e in ends if e is not None]))
    return at.agg(F.min(lon).alias("least"), F.max(lon).alias("most")).withColumn("cut", F.col("least"))


def lattice(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """(id, i, j) of nx by ny places, i running fastest."""
    k = F.col("id")
    return spark.range(nx * ny).select(k, (k % nx).alias("i"), F.floor(k / nx).alias("j"))


def regular(spark: SparkSession, nx: int, ny: int, start: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """A wave model's lattice: cell corners (qx, qy) and centres (px, py)."""
    at = lattice(spark, nx, ny)
    return at.withColumns({"qx": start[0] + F.col("i") * step[0], "qy": start[1] + F.col("j") * step[1], "px": start[0] + (F.col("i") + 0.5) * step[0], "py": start[1] + (F.col("j") + 0.5) * step[1]})


def from_axes(lats: DataFrame, lons: DataFrame) -> DataFrame:
    """The whole lattice of the axes lats(j, lat) and lons(i, lon).

    Axes have one row for each row or column of a grid: roots of its size.  The lattice is a range of as many numbers as it
    has places, spread over tasks, with two equi-joins to the axes numbered in order.
    """
    rank = lambda df, by, name: df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(by)).cast("long") - 1)
    n, m = lats.count(), lons.count()
    cell = lats.sparkSession.range(n * m).select(F.floor(F.col("id") / max(m, 1)).alias("_j"), (F.col("id") % max(m, 1)).alias("_i"))
    return cell.join(rank(lats, "j", "_j"), "_j").join(rank(lons, "i", "_i"), "_i").select("i", "j", "lat", "lon")


def axes(nodes: DataFrame, name: str, m: geodesy.MapSpec) -> tuple[DataFrame, DataFrame]:
    """x(i) and y(j) of a grid that is regular on a map: its first row and column, projected."""
    x, y = geodesy.forward(name, F.col("lat"), F.col("lon"), m)
    return nodes.where("j = 0").select("i", x.alias("x")), nodes.where("i = 0").select("j", y.alias("y"))


def projected(nodes: DataFrame, name: str, m: geodesy.MapSpec) -> DataFrame:
    """nodes with x and y of their lat and lon."""
    x, y = geodesy.forward(name, F.col("lat"), F.col("lon"), m)
    return nodes.withColumns({"x": x, "y": y})


def map_lattice(spark: SparkSession, nx: int, ny: int, step: float, start: tuple[float, float], name: str, m: geodesy.MapSpec) -> DataFrame:
    """A lattice on a map, with lat and lon of its places."""
    at = lattice(spark, nx, ny).withColumns({"x": start[0] + F.col("i") * step, "y": start[1] + F.col("j") * step})
    lat, lon = geodesy.inverse(name, F.col("x"), F.col("y"), m)
    return at.withColumns({"lat": lat, "lon": lon})


def with_corners(nodes: DataFrame, corners: list[tuple[str, str]], name: str, m: geodesy.MapSpec) -> DataFrame:
    """nodes with x, y and the arrays x_corners, y_corners of projected corner positions (pairs of latitude and longitude columns)."""
    out = projected(nodes, name, m)
    xy = [geodesy.forward(name, F.col(a), F.col(b), m) for a, b in corners]
    return out.withColumns({"x_corners": F.array(*[x for x, _ in xy]), "y_corners": F.array(*[y for _, y in xy])})


def cell_place(col: Column, row: Column, origin: tuple[float, float], cells_per_unit: float, name: str, m: geodesy.MapSpec) -> tuple[Column, Column]:
    """(lat, lon) of fractional cell coordinates of a map grid: the inverse of ``geodesy.grid_forward``."""
    return geodesy.inverse(name, (col - origin[0]) / cells_per_unit, (origin[1] - row) / cells_per_unit, m)


def cell_places(spark: SparkSession, rows: int, cols: int, origin: tuple[float, float], cells_per_unit: float, name: str, m: geodesy.MapSpec) -> DataFrame:
    """(row, col, lat, lon) of every cell of a map grid."""
    at = lattice(spark, cols, rows).select(F.col("j").alias("row"), F.col("i").alias("col"))
    lat, lon = cell_place(F.col("col"), F.col("row"), origin, cells_per_unit, name, m)
    return at.withColumns({"lat": lat, "lon": lon})


def cyclic(grid: DataFrame, nx: int, lon: str | None = None) -> DataFrame:
    """The grid with its first column once more after the last one, its longitude 360 on: cells across the seam have both sides."""
    more = {"i": F.col("i") + nx} | ({lon: F.col(lon) + 360} if lon else {})
    return grid.unionByName(grid.where("i = 0").withColumns({k: v.cast(grid.schema[k].dataType) for k, v in more.items()}))


def pole_filled(grid: DataFrame, pole: int, beside: int, value: str, by: list[str] = []) -> DataFrame:
    """The row j = pole has the mean of the row beside it: at a pole all longitudes are one place."""
    own = grid.where(F.col("j") == beside)
    if by:
        out = grid.join(own.groupBy(*by).agg(F.avg(value).alias("_pole")), by, "left")
    else:
        out = grid.withColumn("_pole", F.lit(own.agg(F.avg(value)).first()[0]))  # one number
    return out.withColumn(value, F.when(F.col("j") == pole, F.col("_pole")).otherwise(F.col(value))).select(*grid.columns)


def on_map(nodes: DataFrame, u: str, v: str, kind: str, name: str, m: geodesy.MapSpec, turn: float = 0.0, pole: tuple[int, int] | None = None, by: list[str] = []) -> DataFrame:
    """nodes (lat, lon, ...) with the vector (u, v) of a forcing in the axes of a map.

    kind: "east_north" (components to the east and north), "map" (in the axes of the data's own map, whose rotation is ``turn`` degrees
    less than this map's; missing values stay) or "waves_from" and "waves_to" (u is a direction in degrees from north; a unit vector comes out).
    pole: (row of the pole, row beside it) of a grid (i, j): all longitudes of a pole are one place, so it takes the mean of the row beside it.
    """
    lat, lon, a, b = (F.col(c) for c in ("lat", "lon", u, v))
    if kind == "map":
        x, y = geometry.rotate_vector(a, b, F.lit(math.radians(turn)))
    elif kind == "east_north":
        x, y = geodesy.east_north_to_xy(name, lat, lon, a, b, m)
    elif kind in ("waves_from", "waves_to"):
        x, y = geodesy.wave_direction_to_xy(name, lat, lon, a, m, kind == "waves_from")
    else:
        raise ValueError(f"no such kind of vector: {kind}")
    out = nodes.withColumns({u: x, v: y})
    for c in (u, v) if pole else ():
        out = pole_filled(out, *pole, c, by)
    return out


def target_cells(nodes: DataFrame, name: str, m: geodesy.MapSpec, origin: tuple[float, float], cells_per_unit: float, shape: tuple[int, int]) -> DataFrame:
    """nodes (lat, lon) with col and row, the fractional cell coordinates of a map grid of ``shape`` (rows, columns); null beyond it."""
    x, y = geodesy.forward(name, F.col("lat"), F.col("lon"), m)
    col, row = geodesy.grid_forward(x, y, origin, cells_per_unit, shape)
    return nodes.withColumns({"col": col, "row": row})


def bucket_means(placed: DataFrame, value: str) -> DataFrame:
    """(ci, cj, value, n): mean of all values whose place (col, row) falls into a cell of the target grid."""
    at = placed.where(F.col("col").isNotNull() & F.col("row").isNotNull() & F.col(value).isNotNull())
    return at.groupBy(F.floor(F.col("col") + 0.5).alias("ci"), F.floor(F.col("row") + 0.5).alias("cj")).agg(F.avg(value).alias(value), F.count("*").alias("n"))


def cubic_weight(d: Column) -> Column:
    """Weight of cubic convolution of a value a distance (in cells) away."""
    a = F.abs(d)
    return F.when(a < 1, 1 - 2 * a * a + a * a * a).when(a < 2, 4 - 8 * a + 5 * a * a - a * a * a).otherwise(0.0)


def cubic_values(placed: DataFrame, source: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value) at places (col, row) of a source grid (i, j, value) by cubic convolution over 4 x 4 cells.

    Each place asks for its sixteen cells in one join; cells that the source lacks or that have no value are left out and the other weights stand for
    them; a place without a cell is null.
    """
    i0, j0 = F.floor("col").cast("long"), F.floor("row").cast("long")
    near = [F.explode(F.sequence(c - 1, c + 2)) for c in (i0, j0)]
    asked = placed.select(*key, "col", "row", near[0].alias("i")).select("*", near[1].alias("j"))
    w = cubic_weight(F.col("col") - F.col("i")) * cubic_weight(F.col("row") - F.col("j"))
    met = asked.join(dealt(source.select("i", "j", value).where(F.col(value).isNotNull())), ["i", "j"]).groupBy(*key).agg(F.sum(w * F.col(value)).alias("_v"), F.sum(w).alias("_w"))
    return placed.select(*key).join(dealt(met.select(*key, F.when(F.abs("_w") > 1e-9, F.col("_v") / F.col("_w")).alias(value))), key, "left")


def hyperslab(rows: DataFrame, window: dict[str, tuple[int, int]], fixed: dict[str, int | str]) -> DataFrame:
    """Rows of a stored array within index windows (first, count), other dimensions at one index: a number, or "first" or "last" of those there are."""
    out = rows
    for d, (first, count) in window.items():
        out = out.where(F.col(d).between(first, first + count - 1))
    ends = [d for d, k in fixed.items() if isinstance(k, str)]
    if ends:
        edge = rows.agg(*[(F.min if fixed[d] == "first" else F.max)(d).alias(f"_{d}") for d in ends])
        out = out.join(F.broadcast(edge), [F.col(d) == F.col(f"_{d}") for d in ends]).drop(*[f"_{d}" for d in ends])
    for d, k in fixed.items():
        if not isinstance(k, str):
            out = out.where(F.col(d) == k)
    return out


def drifters_of(nodes: DataFrame, nx: int) -> DataFrame:
    """A drifter at each node of a 2-D file (i, j, lat, lon), numbered by its flat index."""
    return nodes.select((F.col("j") * nx + F.col("i")).alias("drifter_id"), "lat", "lon")
