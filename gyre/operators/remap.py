"""Conservative remapping: overlap areas as a weight table, applied as weighted sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyre.joins import dealt

from .locate import bucketed


def box_overlaps(cells: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """(cell_id, box_id, w): areas of overlap of boxes (x0, x1, y0, y1); each pair is found in the bucket of its overlap's lower corner only."""
    a = bucketed(cells.select("cell_id", *[F.col(c).alias(f"c{c}") for c in ("x0", "x1", "y0", "y1")]), F.col("cx0"), F.col("cx1"), F.col("cy0"), F.col("cy1"), size)
    b = bucketed(boxes.select("box_id", "x0", "x1", "y0", "y1"), F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), size)
    lx, ly = F.greatest("cx0", "x0"), F.greatest("cy0", "y0")
    w, h = F.least("cx1", "x1") - lx, F.least("cy1", "y1") - ly
    own = (F.floor(lx / size) == F.col("bx")) & (F.floor(ly / size) == F.col("by"))
    return a.join(b, ["bx", "by"]).where((w > 0) & (h > 0) & own).select("cell_id", "box_id", (w * h).alias("w"))


def clipped_areas(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Areas of convex polygons (pairs x vertices x 2) within convex polygons, both counter-clockwise: all pairs are cut by one half-plane after another."""
    out, pairs = subject, np.arange(len(subject))[:, None]
    n = np.full(len(subject), subject.shape[1])
    for e in range(clip.shape[1]):
        a, d = clip[:, None, e], clip[:, None, (e + 1) % clip.shape[1]] - clip[:, None, e]
        k = np.arange(out.shape[1])[None, :]
        nxt = np.where(k + 1 < n[:, None], k + 1, 0)
        side = d[..., 0] * (out[..., 1] - a[..., 1]) - d[..., 1] * (out[..., 0] - a[..., 0])
        then, to = side[pairs, nxt], out[pairs, nxt]
        live = k < n[:, None]
        cross = live & (side * then < 0)
        met = out + (to - out) * (side / np.where(cross, side - then, 1.0))[..., None]
        both = np.stack([out, met], axis=2).reshape(len(out), -1, 2)
        kept = np.stack([live & (side >= 0), cross], axis=2).reshape(len(out), -1)
        order = np.argsort(~kept, axis=1, kind="stable")[:, : out.shape[1] + 1]
        out, n = both[pairs, order], kept.sum(axis=1)
    k = np.arange(out.shape[1])[None, :]
    to = out[pairs, np.where(k + 1 < n[:, None], k + 1, 0)]
    twice = np.where(k < n[:, None], out[..., 0] * to[..., 1] - out[..., 1] * to[..., 0], 0.0).sum(axis=1)
    return np.where(n >= 3, np.abs(twice) / 2, 0.0)


def turned(t: np.ndarray) -> np.ndarray:
    """Triangles (pairs x 3 x 2), all counter-clockwise."""
    j = (t[:, 1, 0] - t[:, 0, 0]) * (t[:, 2, 1] - t[:, 0, 1]) - (t[:, 2, 0] - t[:, 0, 0]) * (t[:, 1, 1] - t[:, 0, 1])
    return np.where((j < 0)[:, None, None], t[:, ::-1], t)


CORNERS = [f"{c}{k}" for k in (1, 2, 3) for c in "xy"]


def boxed(at: DataFrame, prefix: str) -> DataFrame:
    """Elements with their corners and box, all names but elem_id with a prefix."""
    xs, ys = [F.col(f"x{k}") for k in (1, 2, 3)], [F.col(f"y{k}") for k in (1, 2, 3)]
    box = {"x0": F.least(*xs), "xe": F.greatest(*xs), "y0": F.least(*ys), "ye": F.greatest(*ys)}
    return at.select("elem_id", *[F.col(c).alias(prefix + c) for c in CORNERS], *[v.alias(prefix + k) for k, v in box.items()])


def near_pairs(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Pairs whose boxes (a..., b... x0, xe, y0, ye) overlap, each found in the bucket of the overlap's lower corner only."""
    a, b = (bucketed(t, F.col(f"{p}x0"), F.col(f"{p}xe"), F.col(f"{p}y0"), F.col(f"{p}ye"), size) for t, p in ((a, "a"), (b, "b")))
    lx, ly = F.greatest("ax0", "bx0"), F.greatest("ay0", "by0")
    own = (F.floor(lx / size) == F.col("bx")) & (F.floor(ly / size) == F.col("by"))
    return a.join(dealt(b), ["bx", "by"]).where((F.least("axe", "bxe") > lx) & (F.least("aye", "bye") > ly) & own)


def triangle_overlaps(cells: DataFrame, at: DataFrame, size: float) -> DataFrame:
    """(cell_id, elem_id, w): areas of overlap of cells (x0, x1, y0, y1) and triangles with corners.

    Pairs come from an equi-join on buckets and a box test; only their clipping is done in Python, a batch of pairs at once.
    """
    a = cells.select("cell_id", F.col("x0").alias("ax0"), F.col("x1").alias("axe"), F.col("y0").alias("ay0"), F.col("y1").alias("aye"))
    b = boxed(at, "b")

    def run(batches):
        for p in batches:
            if len(p):
                t = turned(p[["b" + c for c in CORNERS]].to_numpy().reshape(-1, 3, 2))
                box = p[["ax0", "ay0", "axe", "ay0", "axe", "aye", "ax0", "aye"]].to_numpy().reshape(-1, 4, 2)
                yield pd.DataFrame({"cell_id": p.cell_id, "elem_id": p.elem_id, "w": clipped_areas(t, box)})

    cols = ["cell_id", "elem_id", "ax0", "axe", "ay0", "aye", *["b" + c for c in CORNERS]]
    return near_pairs(a, b, size).select(*cols).mapInPandas(run, "cell_id long, elem_id long, w double").where("w > 0")


def mesh_overlaps(old: DataFrame, new: DataFrame, size: float) -> DataFrame:
    """(elem_id of the new mesh, source of the old one, w): areas of overlap of two meshes' triangles, given with corners.

    A triangle that is in both has its own area, by an equi-join on its corners; only the others are clipped.
    """
    corner = F.array_sort(F.array(*[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2, 3)]))
    area = F.abs((F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("x3") - F.col("x1")) * (F.col("y2") - F.col("y1"))) / 2
    same = new.select("elem_id", corner.alias("c"), area.alias("w")).join(dealt(old.select(F.col("elem_id").alias("source"), corner.alias("c"))), "c").select("elem_id", "source", "w")
    rest = boxed(new.join(dealt(same.select("elem_id")), "elem_id", "left_anti"), "a")
    pairs = near_pairs(rest, boxed(old, "b").withColumnRenamed("elem_id", "source"), size)

    def run(batches):
        for p in batches:
            if len(p):
                one, two = (turned(p[[s + c for c in CORNERS]].to_numpy().reshape(-1, 3, 2)) for s in "ab")
                yield pd.DataFrame({"elem_id": p.elem_id, "source": p.source, "w": clipped_areas(one, two)})

    cut = pairs.select("elem_id", "source", *[s + c for s in "ab" for c in CORNERS]).mapInPandas(run, "elem_id long, source long, w double").where("w > 0")
    return same.unionByName(cut)


def mesh_to_mesh(weights: DataFrame, field: DataFrame, value: str) -> DataFrame:
    """Overlap-weighted mean over what covers an element of the new mesh."""
    own = weights.join(dealt(field.select(F.col("elem_id").alias("source"), F.col(value))), "source")
    return own.groupBy("elem_id").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias(value))


def mesh_to_grid(weights: DataFrame, field: DataFrame, cell_area: float, value: str) -> DataFrame:
    """Weighted sum over the full cell area: the uncovered part of a cell counts as 0; covered is the share that isn't."""
    return weights.join(dealt(field), "elem_id").groupBy("cell_id").agg((F.sum(F.col(value) * F.col("w")) / cell_area).alias(value), (F.sum("w") / cell_area).alias("covered"))


def grid_to_mesh(weights: DataFrame, field: DataFrame, value: str) -> DataFrame:
    """Weighted mean over what covers an element."""
    return weights.join(field, "cell_id").groupBy("elem_id").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias(value))


def applied(weights: DataFrame, field: DataFrame, target: str, source: str, value: str) -> DataFrame:
    """Sum of w * value for stored weights (target, source, w)."""
    return weights.join(field, source).groupBy(target).agg(F.sum(F.col(value) * F.col("w")).alias(value))
