"""Units, masks, crops, identities: row-wise and set operations on fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.shared import written

MISSING = -1e14


def unit_transform(raw: Column, scale: float = 1.0, offset: float = 0.0, a: float = 1.0, b: float = 0.0) -> Column:
    """Stored value to model unit: the file's scale and offset first, then the catalogue's factor and constant."""
    return (raw * scale + offset) * a + b


def nan_to_zero(c: Column) -> Column:
    return F.nanvl(c, F.lit(0.0))


def bounding_box(targets: DataFrame, x: str, y: str) -> DataFrame:
    """(x0, x1, y0, y1); without targets the box is infinite."""
    inf = float("inf")
    return targets.agg(*[F.coalesce(f(c).cast("double"), F.lit(v)).alias(n) for n, f, c, v in (("x0", F.min, x, -inf), ("x1", F.max, x, inf), ("y0", F.min, y, -inf), ("y1", F.max, y, inf))])


def crop(axis: DataFrame, index: str, value: str, low: Column | float, high: Column | float, halo: int = 0) -> DataFrame:
    """Axis rows with low <= value <= high, and ``halo`` more at either end while the axis has them."""
    a, b = axis.where(F.col(value).between(low, high)).agg(F.min(index), F.max(index)).first()  # two numbers
    return axis.where(F.lit(False)) if a is None else axis.where(F.col(index).between(a - halo, b + halo))


def is_wet(c: Column, *fills: float) -> Column:
    """Neither null nor NaN nor a fill, missing or land value."""
    return c.isNotNull() & ~F.isnan(c) & ~c.isin(*fills) if fills else c.isNotNull() & ~F.isnan(c)


def ice_mask(value: Column, mask: Column, missing: float = MISSING) -> Column:
    return F.when((mask <= 0) & (value != missing), 0.0).otherwise(value)


def land_mask(value: Column, wet: Column, missing: float = MISSING) -> Column:
    return F.when(wet, value).otherwise(missing)


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    out = value if low is None else F.greatest(value, F.lit(low))
    return out if high is None else F.least(out, F.lit(high))


def ice_threshold(conc: Column, value: Column, least: float) -> Column:
    return F.when(conc < least, 0.0).otherwise(value)


def add_missing(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``known`` and those rows of ``new`` whose key it lacks."""
    return known.unionByName(new.join(known.select(key).distinct(), key, "left_anti").select(*known.columns))


def keepers(moving: DataFrame, ids: DataFrame, key: str, conc: Column, limit: float) -> DataFrame:
    """Rows with a concentration strictly over the limit whose key is among ``ids``."""
    return moving.where(conc > limit).join(ids.select(key).distinct(), key, "left_semi")


def renumbered(rows: DataFrame, order: list[str], group: str | None = None, into: str = "new_id") -> DataFrame:
    """Gapless numbers from 0 in the given order (ties in any order).

    Rows are range-partitioned by the order and sorted within partitions, written once, and numbered where they lie; a
    partition's numbers are moved on by the rows of those before it (one count a partition reaches the driver), so no
    task sees all rows and a hot group is split like any other.  group: a key that rises with the order comes first in it.
    """
    keys = [*([group] if group else []), *order]
    local = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    local = written(local.select("*", F.shiftright("_at", 33).alias("_p"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_r")).drop("_at"), "numbered")
    before, start = 0, {}
    for p, n in sorted(tuple(r) for r in local.groupBy("_p").agg(F.count("*")).collect()):
        start[p], before = before, before + n
    moved = F.element_at(F.create_map(*[F.lit(v).cast("long") for kv in start.items() for v in kv]), F.col("_p")) if start else F.lit(0)
    return local.withColumn(into, (F.col("_r") + moved).cast("long")).drop("_p", "_r")


def inverse_permutation(p: DataFrame, index: str, value: str) -> DataFrame:
    return p.select(F.col(value).alias(index), F.col(index).alias(value))


def value_ranges(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(var, least, most) of each column, in one pass."""
    one = rows.agg(*[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("l", F.min), ("m", F.max))])
    items = F.array(*[F.struct(F.lit(c).alias("var"), F.col(f"l_{c}").cast("double").alias("least"), F.col(f"m_{c}").cast("double").alias("most")) for c in columns])
    return one.select(F.explode(items).alias("r")).select("r.*")
