"""Plane geometry as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def winding(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """How often a polygon winds around a point: upward edges to its right count one, downward ones minus one."""
    total = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if y1 == y2:
            continue
        right = x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x
        crosses = (y >= min(y1, y2)) & (y < max(y1, y2))
        total = total + F.when(crosses & right, 1 if y1 < y2 else -1).otherwise(0)
    return total


def squared_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """From a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    t = ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)
    u = F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    ex, ey = x1 + u * dx - px, y1 + u * dy - py
    return ex * ex + ey * ey


def crossing_x(y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where the line through two points crosses a height; null for a level line."""
    return F.when(F.abs(y2 - y1) >= 1e-6, x1 + (y - y1) / (y2 - y1) * (x2 - x1))


def line_scalars(p1: tuple, p2: tuple, q1: tuple, q2: tuple) -> tuple[Column, Column]:
    """Places, as shares of each line, where two lines meet; null for parallel ones."""
    ax, ay, bx, by = p2[0] - p1[0], p2[1] - p1[1], q2[0] - q1[0], q2[1] - q1[1]
    det = ax * by - ay * bx
    cx, cy = q1[0] - p1[0], q1[1] - p1[1]
    return F.when(det != 0, (cx * by - cy * bx) / det), F.when(det != 0, (cx * ay - cy * ax) / det)


def piecewise(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear interpolation between knots, and on beyond the first and the last."""
    out = None
    for (a, fa), (b, fb) in zip(knots, knots[1:], strict=False):
        value = fa + (x - a) / (b - a) * (fb - fa)
        out = value if out is None else F.when(x >= a, value).otherwise(out)
    return out


def area2(points: Column) -> Column:
    """Twice the signed area of a polygon given as array<struct<x, y>>; 0 where all points are in line."""
    n = F.size(points)
    nxt = lambda i: F.element_at(points, F.when(i + 1 == n, 1).otherwise(i + 2).cast("int"))
    terms = F.transform(points, lambda p, i: p["x"] * nxt(i)["y"] - nxt(i)["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


def valid_zone(points: Column) -> Column:
    """Three points at least, not all in line."""
    return (F.size(points) >= 3) & (F.abs(area2(points)) > 1e-9)


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def bounded_by(x: Column, y: Column, dx: Column, dy: Column, box: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """Where the line (x, y) + s * (dx, dy) enters and leaves a rectangle (left, top, right, bottom), as least and greatest s; null where it meets no edge.

    Corners belong to both their edges, with a tolerance for rounding.
    """
    left, top, right, bottom = box
    slack, hits = 1e-9, []
    for fixed, start, by, other, other_by, low, high in ((top, y, dy, x, dx, left, right), (bottom, y, dy, x, dx, left, right), (left, x, dx, y, dy, top, bottom), (right, x, dx, y, dy, top, bottom)):
        s = F.when(by != 0, (fixed - start) / by)
        hits.append(F.when(((other + s * other_by - low) / (high - low)).between(-slack, 1 + slack), s))
    return F.least(*hits), F.greatest(*hits)
