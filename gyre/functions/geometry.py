"""Plane geometry of triangles and polygons, and interpolation within a cell, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = -1e-11


def jacobian(x1, y1, x2, y2, x3, y3) -> Column:
    """Signed double area."""
    return (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)


def area(x1, y1, x2, y2, x3, y3) -> Column:
    return F.abs(jacobian(x1, y1, x2, y2, x3, y3)) / 2


def sides(x1, y1, x2, y2, x3, y3) -> tuple[Column, Column, Column]:
    return F.hypot(x2 - x1, y2 - y1), F.hypot(x3 - x2, y3 - y2), F.hypot(x1 - x3, y1 - y3)


def min_angle(a: Column, b: Column, c: Column) -> Column:
    """Smallest angle in degrees, by the law of cosines: it lies opposite the shortest side."""
    least = F.least(a, b, c)
    squares = a * a + b * b + c * c
    return F.degrees(F.acos((squares - 2 * least * least) / (2 * a * b * c / least)))


def shape_coefficients(x1, y1, x2, y2, x3, y3) -> list[Column]:
    """Gradients of the three linear shape functions: d/dx of each, then d/dy of each."""
    j = jacobian(x1, y1, x2, y2, x3, y3)
    return [(y2 - y3) / j, (y3 - y1) / j, (y1 - y2) / j, (x3 - x2) / j, (x1 - x3) / j, (x2 - x1) / j]


def barycentric(x, y, x1, y1, x2, y2, x3, y3) -> tuple[Column, Column, Column]:
    j = jacobian(x1, y1, x2, y2, x3, y3)
    a, b = jacobian(x, y, x2, y2, x3, y3) / j, jacobian(x1, y1, x, y, x3, y3) / j
    return a, b, 1 - a - b


def bilinear(dx: Column, dy: Column, v00: Column, v10: Column, v01: Column, v11: Column) -> Column:
    """dx, dy in [0, 1]."""
    return v00 * (1 - dx) * (1 - dy) + v10 * dx * (1 - dy) + v01 * (1 - dx) * dy + v11 * dx * dy


def triangle_split(dx, dy, v00, v10, v01, v11) -> Column:
    """Linear on the two triangles of a cell cut from (1, 0) to (0, 1)."""
    return F.when(dx + dy <= 1, v00 + (v10 - v00) * dx + (v01 - v00) * dy).otherwise(v11 + (v01 - v11) * (1 - dx) + (v10 - v11) * (1 - dy))


def triangle_split_up(dx, dy, v00, v10, v01, v11) -> Column:
    """Linear on the two triangles of a cell cut from (0, 0) to (1, 1)."""
    return F.when(dx < dy, v00 + (v11 - v01) * dx + (v01 - v00) * dy).otherwise(v00 + (v10 - v00) * dx + (v11 - v10) * dy)


def nearest(dx, dy, v00, v10, v01, v11) -> Column:
    """The nearest corner; at a middle, the lower one."""
    return F.when(dx <= 0.5, F.when(dy <= 0.5, v00).otherwise(v01)).otherwise(F.when(dy <= 0.5, v10).otherwise(v11))


def bracket_any(x: Column, axis: list[float]) -> Column:
    """Index i with x between axis[i] and axis[i + 1] of an irregular axis that rises or falls; the first node of an interval is in it, the axis' last node too; outside: null."""
    up = axis[-1] > axis[0]
    nodes = F.array(*[F.lit(float(a)) for a in axis])
    passed = F.size(F.filter(nodes, (lambda a: a <= x) if up else (lambda a: a >= x))) - 1
    inside = (x >= min(axis)) & (x <= max(axis))
    return F.when(inside, F.least(passed, F.lit(len(axis) - 2)))


def bracket(x: Column, start: float, step: float, n: int) -> Column:
    """Index i with x in [x_i, x_i+1) of a regular axis of n nodes; the last node is closed; outside: null."""
    i = F.floor((x - start) / step).cast("int")
    return F.when(x == start + step * (n - 1), F.lit(n - 2)).when((i >= 0) & (i < n - 1), i)


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of structs (x, y) in order; under three points: 0."""
    n = F.size(points)
    total = F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0.0),
        lambda s, i: s + F.get(points, i)["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * F.get(points, i)["y"],
    )
    return F.when(n < 3, 0.0).otherwise(F.abs(total) / 2)


def clockwise(points: Column) -> Column:
    """Vertices of a convex polygon ordered by their angle about the centroid."""
    n = F.size(points)
    cx = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["x"]) / n
    cy = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["y"]) / n
    keyed = F.transform(points, lambda p: F.struct((-F.atan2(p["y"] - cy, p["x"] - cx)).alias("k"), p["x"].alias("x"), p["y"].alias("y")))
    return F.transform(F.array_sort(keyed), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def in_convex(x: Column, y: Column, points: Column, eps: float = 1e-8, inclusive: bool = True, vertex: float = 1e-3) -> Column:
    """Whether a point lies in a convex polygon (either order), by the signs of cross products; one within ``vertex`` of a corner does if ``inclusive``, else not."""
    n = F.size(points)

    def cross(i: Column) -> Column:
        a, b = F.get(points, i), F.get(points, (i + 1) % n)
        return (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])

    edge = -eps if inclusive else eps
    at = F.sequence(F.lit(0), n - 1)
    inner = F.forall(at, lambda i: cross(i) >= edge) | F.forall(at, lambda i: -cross(i) >= edge)
    corner = F.exists(points, lambda p: F.hypot(x - p["x"], y - p["y"]) < vertex)
    return (corner | inner) if inclusive else (~corner & inner)


def crossings(x0: Column, y0: Column, x1: Column, y1: Column, points: Column) -> Column:
    """Points (x, y) where the open segment crosses the open edges of a polygon, in the order of edges; parallel ones don't cross."""
    n = F.size(points)

    def met(i: Column) -> Column:
        a, b = F.get(points, i), F.get(points, (i + 1) % n)
        ex, ey, sx, sy = b["x"] - a["x"], b["y"] - a["y"], x1 - x0, y1 - y0
        d = sx * ey - sy * ex
        t, u = ((a["x"] - x0) * ey - (a["y"] - y0) * ex) / d, ((a["x"] - x0) * sy - (a["y"] - y0) * sx) / d
        ok = (d != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        return F.when(ok, F.struct((x0 + t * sx).alias("x"), (y0 + t * sy).alias("y")))

    return F.filter(F.transform(F.sequence(F.lit(0), n - 1), met), lambda p: p.isNotNull())


def rotate_vector(u: Column, v: Column, theta: Column, missing: float = -1e14) -> tuple[Column, Column]:
    """Rotation by radians; missing components stay."""
    ok = (u != missing) & (v != missing)
    return F.when(ok, u * F.cos(theta) - v * F.sin(theta)).otherwise(u), F.when(ok, u * F.sin(theta) + v * F.cos(theta)).otherwise(v)


def lagrange(nodes: list[float], i: int, x: Column) -> Column:
    """The i-th Lagrange basis polynomial over the nodes."""
    out = F.lit(1.0)
    for k, n in enumerate(nodes):
        if k != i:
            out = out * (x - n) / (nodes[i] - n)
    return out


def lagrange2d(xs: list[float], ys: list[float], values: list[list[float]], x: Column, y: Column) -> Column:
    """The polynomial through values[i][j] at (xs[i], ys[j])."""
    return sum((lagrange(xs, i, x) * lagrange(ys, j, y) * values[i][j] for i in range(len(xs)) for j in range(len(ys))), F.lit(0.0))


def cubic_spline(xs: list[float], values: list[float], second: list[float], x: Column) -> Column:
    """A cubic spline with the given second derivatives at its knots; beyond the ends the end pieces go on."""
    k = F.greatest(F.lit(0), F.coalesce(bracket_any(F.greatest(F.least(x, F.lit(max(xs))), F.lit(min(xs))), xs), F.lit(0)))
    at = lambda v, i: F.get(F.array(*[F.lit(float(c)) for c in v]), i)
    h = at(xs, k + 1) - at(xs, k)
    a, b = (at(xs, k + 1) - x) / h, (x - at(xs, k)) / h
    return a * at(values, k) + b * at(values, k + 1) + ((a * a * a - a) * at(second, k) + (b * b * b - b) * at(second, k + 1)) * h * h / 6


def eigen2(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column, Column]:
    """(lambda1, lambda2, vx, vy) of the symmetric matrix (a, b; b, c): lambda1 >= lambda2, (vx, vy) the unit vector of lambda1, (1, 0) where all are alike."""
    mid, off = (a + c) / 2, F.hypot((a - c) / 2, b)
    theta = F.when(off == 0, 0.0).otherwise(F.atan2(b, (a - c) / 2) / 2)
    return mid + off, mid - off, F.cos(theta), F.sin(theta)


def polynomial2d(x: Column, y: Column, coefficients: dict[tuple[int, int], float]) -> Column:
    """Sum of c x**i y**j."""
    out = F.lit(0.0)
    for (i, j), c in sorted(coefficients.items()):
        out = out + c * F.pow(x, F.lit(i)) * F.pow(y, F.lit(j))
    return out
