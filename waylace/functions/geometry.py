"""Geometry as column expressions.

A line is an array of (x, y) structs; a polygon ring is a closed line.  All of
these stay within generated code or array functions: no shuffle, no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Declared type of a line.
LINE = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def millimetres(value: Column) -> Column:
    """Node key of a coordinate: whole millimetres, ties to even."""
    return F.rint(value * 1000.0).cast("long")


def snapped(value: Column) -> Column:
    """A coordinate rounded to millimetres."""
    return F.rint(value * 1000.0) / 1000.0


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def clamp(value: Column, low: float | Column, high: float | Column) -> Column:
    to = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(to(low), F.least(to(high), value))


def unit(dx: Column, dy: Column) -> tuple[Column, Column]:
    """Unit vector; (0, 0) for a zero vector."""
    length = F.sqrt(dx * dx + dy * dy)
    return F.coalesce(F.try_divide(dx, length), F.lit(0.0)), F.coalesce(F.try_divide(dy, length), F.lit(0.0))


def left_normal(dx: Column, dy: Column) -> tuple[Column, Column]:
    """Unit vector to the left; (0, 0) for a zero vector."""
    return unit(-dy, dx)


def undirected_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two unit directions, 0 to 90; 90 if either is zero."""
    return F.degrees(F.acos(F.abs(clamp(ax * bx + ay * by, -1, 1))))


def folded_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two vectors of any length, folded to 0 to 90; null if either is zero."""
    cosine = F.try_divide(ax * bx + ay * by, F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by))
    angle = F.degrees(F.acos(clamp(cosine, -1, 1)))
    return F.least(angle, 180.0 - angle)


def axis_similarity(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Absolute cosine of two unit axes; 0.5 if either is unknown."""
    return F.coalesce(F.abs(ax * bx + ay * by), F.lit(0.5))


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    t = F.coalesce(clamp(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), 0, 1), F.lit(0.0))
    return F.hypot(px - ax - t * dx, py - ay - t * dy)  # names t twice where the sum of squares would four times


def crosses(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether segments ab and cd cross at a point inside both."""
    side = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    return (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)


def segment_distance(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Distance of two segments; 0 if they cross."""
    ends = F.least(
        point_segment_distance(ax, ay, cx, cy, dx, dy),
        point_segment_distance(bx, by, cx, cy, dx, dy),
        point_segment_distance(cx, cy, ax, ay, bx, by),
        point_segment_distance(dx, dy, ax, ay, bx, by),
    )
    return F.when(crosses(ax, ay, bx, by, cx, cy, dx, dy), 0.0).otherwise(ends)


# boxes (x0, y0, w, h)


def box_distance(a: str, b: str) -> Column:
    """Distance of two boxes given by column prefixes."""
    gap = lambda at, size: F.greatest(
        F.lit(0.0), F.col(f"{b}{at}") - F.col(f"{a}{at}") - F.col(f"{a}{size}"), F.col(f"{a}{at}") - F.col(f"{b}{at}") - F.col(f"{b}{size}")
    )
    gx, gy = gap("x0", "w"), gap("y0", "h")
    return F.sqrt(gx * gx + gy * gy)


def box_shared_boundary(a: str, b: str) -> Column:
    """Length of boundary that two boxes have in common: overlapping collinear sides."""
    overlap = lambda at, size: F.greatest(
        F.lit(0.0), F.least(F.col(f"{a}{at}") + F.col(f"{a}{size}"), F.col(f"{b}{at}") + F.col(f"{b}{size}")) - F.greatest(F.col(f"{a}{at}"), F.col(f"{b}{at}"))
    )

    def equal_sides(at: str, size: str) -> Column:
        ends = lambda p: (F.col(f"{p}{at}"), F.col(f"{p}{at}") + F.col(f"{p}{size}"))
        return sum(((s == t).cast("int") for s in ends(a) for t in ends(b)), F.lit(0))

    return equal_sides("x0", "w") * overlap("y0", "h") + equal_sides("y0", "h") * overlap("x0", "w")


def box_boundary_distance(px: Column, py: Column, x0: Column, y0: Column, w: Column, h: Column) -> Column:
    """Distance of a point to a box's boundary, from inside or outside."""
    inner = F.least(px - x0, x0 + w - px, py - y0, y0 + h - py)
    ox, oy = F.greatest(x0 - px, F.lit(0.0), px - x0 - w), F.greatest(y0 - py, F.lit(0.0), py - y0 - h)
    return F.when(inner >= 0, inner).otherwise(F.sqrt(ox * ox + oy * oy))


def box_covers(px: Column, py: Column, x0: Column, y0: Column, w: Column, h: Column) -> Column:
    """Whether the point is in the box or on its boundary."""
    return px.between(x0, x0 + w) & py.between(y0, y0 + h)


def box_clip_length(ax: Column, ay: Column, bx: Column, by: Column, x0: Column, y0: Column, w: Column, h: Column) -> Column:
    """Length of the part of a segment that lies in a box (Liang-Barsky)."""
    enter, leave = F.lit(0.0), F.lit(1.0)
    outside = F.lit(False)
    for p, low, high, d in ((ax, x0, x0 + w, bx - ax), (ay, y0, y0 + h, by - ay)):
        t1, t2 = F.try_divide(low - p, d), F.try_divide(high - p, d)
        enter = F.greatest(enter, F.coalesce(F.least(t1, t2), F.lit(0.0)))
        leave = F.least(leave, F.coalesce(F.greatest(t1, t2), F.lit(1.0)))
        outside = outside | ((d == 0) & ((p < low) | (p > high)))
    return F.when(outside | (enter >= leave), 0.0).otherwise((leave - enter) * distance(ax, ay, bx, by))


def box_ring(x0: Column, y0: Column, w: Column, h: Column) -> Column:
    """A box as a closed ring from its lower left corner, counter-clockwise."""
    return F.array(point(x0, y0), point(x0 + w, y0), point(x0 + w, y0 + h), point(x0, y0 + h), point(x0, y0))


# lines


def segments(line: Column) -> Column:
    """Array of (a, b) points; empty for fewer than two vertices."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def line_length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda total, s: total + distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))


def translate(line: Column, dx: Column, dy: Column) -> Column:
    return F.transform(line, lambda p: point(p["x"] + dx, p["y"] + dy))


def round_line(line: Column) -> Column:
    """Vertices in millimetres without consecutive repeats; the line itself if fewer than two remain."""
    whole = F.transform(line, lambda p: point(snapped(p["x"]), snapped(p["y"])))
    moves = F.filter(segments(whole), lambda s: s["a"] != s["b"])
    return F.when(F.size(moves) >= 1, F.concat(F.slice(whole, 1, 1), F.transform(moves, lambda s: s["b"]))).otherwise(line)


def moving_average(line: Column, half: int = 2) -> Column:
    """Mean of each vertex and up to ``half`` on either side."""
    none = F.lit(None).cast("struct<x:double,y:double>")
    shifted = [F.slice(F.concat(F.array_repeat(none, max(-k, 0)), F.slice(line, max(k, 0) + 1, F.greatest(F.size(line) - max(k, 0), F.lit(0)))), 1, F.size(line)).alias(f"p{k + half}") for k in range(-half, half + 1)]

    def mean(near: Column) -> Column:
        parts = [near[f"p{k}"] for k in range(2 * half + 1)]
        n = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
        part = lambda axis: sum((F.coalesce(p[axis], F.lit(0.0)) for p in parts), F.lit(0.0)) / n
        return point(part("x"), part("y"))

    return F.transform(F.arrays_zip(*shifted), mean)


def segmentize(line: Column, longest: float) -> Column:
    """The line with vertices added so that no segment is longer than ``longest``."""

    def cut(s: Column) -> Column:
        n = F.greatest(F.ceil(distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]) / longest), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: point(s["a"]["x"] + k / n * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + k / n * (s["b"]["y"] - s["a"]["y"])))

    return F.concat(F.flatten(F.transform(segments(line), cut)), F.slice(line, -1, 1))


def curvature_penalty(line: Column) -> Column:
    """Mean turn as a share of a half turn, over pairs of segments of some length."""
    s = segments(line)
    n = F.greatest(F.size(s) - 1, F.lit(0))

    def turn(p: Column, q: Column) -> Column:
        ax, ay, bx, by = p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"], q["b"]["x"] - q["a"]["x"], q["b"]["y"] - q["a"]["y"]
        cosine = F.try_divide(ax * bx + ay * by, F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by))
        return F.acos(clamp(cosine, -1, 1))

    turns = F.filter(F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), turn), lambda t: t.isNotNull())
    total = F.aggregate(turns, F.lit(0.0), lambda acc, t: acc + t)
    return F.coalesce(clamp(F.try_divide(total, math.pi * F.size(turns)), 0, 1), F.lit(0.0))


def merge_lines(a: Column, b: Column) -> Column:
    """One line out of two that share an end exactly, else null; ``a`` runs on where it can."""
    first, last = lambda g: F.get(g, F.lit(0)), lambda g: F.element_at(g, -1)
    tail = lambda g: F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0)))
    return (
        F.when(last(a) == first(b), F.concat(a, tail(b)))
        .when(last(a) == last(b), F.concat(a, tail(F.reverse(b))))
        .when(first(a) == last(b), F.concat(b, tail(a)))
        .when(first(a) == first(b), F.concat(F.reverse(b), tail(a)))
    )


def with_ends(line: Column, old_u: Column, old_v: Column, new_u: Column, new_v: Column) -> Column:
    """``line`` with its ends moved to new nodes, in whichever orientation fits the old ones better."""
    gap = lambda p, q: distance(snapped(p["x"]), snapped(p["y"]), q["x"], q["y"])
    first, last = F.get(line, F.lit(0)), F.element_at(line, -1)
    direct = gap(first, old_u) + gap(last, old_v) <= gap(first, old_v) + gap(last, old_u)
    inner = F.slice(line, 2, F.greatest(F.size(line) - 2, F.lit(0)))
    moved = F.when(direct, F.concat(F.array(new_u), inner, F.array(new_v))).otherwise(F.concat(F.array(new_v), inner, F.array(new_u)))
    return F.when(F.size(line) < 2, F.array(new_u, new_v)).otherwise(moved)


def ring_area2(ring: Column) -> Column:
    """Twice the signed area of a closed ring."""
    return F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])


def ring_centroid(ring: Column) -> Column:
    """Centroid of a closed ring's area; null if it has none."""
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    part = lambda axis: F.try_divide(F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + (s["a"][axis] + s["b"][axis]) * cross(s)), 3.0 * ring_area2(ring))
    return point(part("x"), part("y"))


def without_near_interior(line: Column, node: Column, radius: float) -> Column:
    """``line`` without interior vertices within ``radius`` of ``node``; unchanged for a null node."""
    inner = F.filter(F.slice(line, 2, F.greatest(F.size(line) - 2, F.lit(0))), lambda p: distance(p["x"], p["y"], node["x"], node["y"]) > radius)
    return F.when(node.isNull() | (F.size(line) <= 2), line).otherwise(F.concat(F.slice(line, 1, 1), inner, F.slice(line, -1, 1)))
