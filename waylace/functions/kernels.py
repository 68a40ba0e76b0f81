"""Geometry that columns cannot express, as numpy kernels over Arrow batches.

Each kernel works on one geometry at a time; nothing is gathered across rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waylace.functions.geometry import LINE

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW_LINE = pa.list_(_POINT)
_BLOCK = 256
#: Points of the shapes that are remembered, and of one batch of results.
_HELD, _POINTS = 1 << 20, 1 << 18


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise, by Andrew's monotone chain."""
    ordered = np.unique(points, axis=0)
    if len(ordered) < 3:
        return ordered

    def half(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(half(ordered)[:-1] + half(ordered[::-1])[:-1])


def smallest_rectangle(points: np.ndarray) -> tuple[float, float, float, float] | None:
    """``(width, length, ax, ay)`` of the enclosing rectangle of least area, axis along its long side; None without area."""
    hull = convex_hull(points)
    if len(hull) < 3:
        return None
    edges = np.roll(hull, -1, axis=0) - hull
    units = edges / np.hypot(edges[:, 0], edges[:, 1])[:, None]
    along = hull @ units.T
    across = hull @ np.stack([-units[:, 1], units[:, 0]])
    a, b = np.ptp(along, axis=0), np.ptp(across, axis=0)
    k = int(np.argmin(a * b))
    ux, uy = units[k]
    return (float(b[k]), float(a[k]), float(ux), float(uy)) if a[k] >= b[k] else (float(a[k]), float(b[k]), float(-uy), float(ux))


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker with a stack; both ends stay; of equally far vertices the first one is kept."""
    if len(points) < 3:
        return points
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        ax, ay = points[i].tolist()
        dx, dy = (points[j] - points[i]).tolist()
        x, y = points[i + 1 : j].T
        # one rounding a step, in the order of the SQL: a matrix product or hypot would settle equal gaps by its own last bit
        size = dx * dx + dy * dy
        t = np.clip(((x - ax) * dx + (y - ay) * dy) / size, 0, 1) if size else np.zeros(len(x))
        gx, gy = x - ax - t * dx, y - ay - t * dy
        gap = np.sqrt(gx * gx + gy * gy)
        k = int(np.argmax(gap))
        if gap[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return points[keep]


def inside_ring(ring: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Even-odd test of points against a closed ring."""
    a, b = ring[:-1], ring[1:]
    y = points[:, 1][:, None]
    spans = (a[:, 1] <= y) != (b[:, 1] <= y)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return ((points[:, 0][:, None] < x) & spans).sum(axis=1) % 2 == 1


def ring_distance(ring: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distance of points to a ring."""
    a, d = ring[:-1], np.diff(ring, axis=0)
    rel = points[:, None, :] - a
    size = np.maximum((d * d).sum(axis=1), 1e-300)
    t = np.clip((rel * d).sum(axis=2) / size, 0, 1)
    return np.hypot(*np.moveaxis(rel - t[:, :, None] * d, 2, 0)).min(axis=1)


def densified(ring: np.ndarray, step: float) -> np.ndarray:
    """Vertices of a ring (without the closing one) with points added so that no gap exceeds ``step``."""
    out = []
    for a, b in zip(ring[:-1], ring[1:], strict=True):
        n = max(1, math.ceil(float(np.hypot(*(b - a))) / step))
        out.append(a + np.arange(n)[:, None] / n * (b - a))
    return np.concatenate(out)


def delaunay(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triangles and their circumcentres, by Bowyer-Watson insertion.

    Points are moved by a fixed pattern of about 1e-7 of their extent first, so
    that points on a common circle have one triangulation.
    """
    low, span = points.min(axis=0), max(float(np.ptp(points, axis=0).max()), 1e-9)
    n = len(points)
    wobble = np.stack([np.sin(np.arange(n) * 12.9898), np.cos(np.arange(n) * 78.233)], axis=1) * 1e-7
    p = np.concatenate([(points - low) / span + wobble, [[-50.0, -50.0], [50.0, -50.0], [0.5, 80.0]]])
    tri = np.array([[n, n + 1, n + 2]])
    centre, radius = _circles(p, tri)
    for i in range(n):
        bad = ((centre - p[i]) ** 2).sum(axis=1) < radius
        hole = tri[bad]
        edges = np.concatenate([hole[:, [0, 1]], hole[:, [1, 2]], hole[:, [2, 0]]])
        code = np.sort(edges, axis=1) @ np.array([n + 3, 1])
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        rim = edges[first[counts == 1]]
        new = np.column_stack([rim, np.full(len(rim), i)])
        c, r = _circles(p, new)
        tri, centre, radius = np.concatenate([tri[~bad], new]), np.concatenate([centre[~bad], c]), np.concatenate([radius[~bad], r])
    real = (tri < n).all(axis=1)
    return tri[real], centre[real] * span + low


def _circles(p: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c = p[tri[:, 0]], p[tri[:, 1]], p[tri[:, 2]]
    b, c = b - a, c - a
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    d = np.where(np.abs(d) < 1e-300, 1e-300, d)
    b2, c2 = (b * b).sum(axis=1), (c * c).sum(axis=1)
    u = np.stack([(c[:, 1] * b2 - b[:, 1] * c2) / d, (b[:, 0] * c2 - c[:, 0] * b2) / d], axis=1)
    return a + u, (u * u).sum(axis=1)


def voronoi_skeleton(ring: np.ndarray, step: float, least_width: float) -> list[np.ndarray]:
    """Edges of the Voronoi diagram of a ring's points that lie inside it, where it is at least ``least_width`` wide."""
    points = densified(ring, step)
    if len(points) < 4:
        return []
    tri, centre = delaunay(points)
    if not len(tri):
        return []
    edges = np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]])
    owner = np.tile(np.arange(len(tri)), 3)
    code = np.sort(edges, axis=1) @ np.array([len(points), 1])
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    twice = np.flatnonzero(code[1:] == code[:-1])
    p, q = centre[owner[twice]], centre[owner[twice + 1]]
    long = np.hypot(*(p - q).T) > 1e-6
    p, q = p[long], q[long]
    if not len(p):
        return []
    fine = inside_ring(ring, p) & inside_ring(ring, q) & (2 * ring_distance(ring, (p + q) / 2) >= least_width)
    return [np.stack([a, b]) for a, b in zip(p[fine], q[fine], strict=True)]


def voronoi_near(ring: np.ndarray, pieces: np.ndarray, step: float, least_width: float) -> list[np.ndarray]:
    """The part of a surface's Voronoi skeleton whose middles lie in one of its rings.

    ``pieces`` (n, 4) are the surface's boundary around the ring.  Edges that meet
    the boundary, or are nearer to a boundary sample than the samples are to
    each other, would leave the surface between two of them and are dropped.
    """
    found = []
    for ax, ay, bx, by in pieces:
        n = max(1, math.ceil(math.hypot(bx - ax, by - ay) / step))
        t = np.arange(n + 1)[:, None] / n
        found.append(np.array([ax, ay]) + t * np.array([bx - ax, by - ay]))
    points = np.unique(np.round(np.concatenate(found), 6), axis=0) if found else np.zeros((0, 2))
    if len(points) < 4:
        return []
    points = points[np.random.default_rng(0).permutation(len(points))]  # insertion in random order keeps holes small
    tri, centre = delaunay(points)
    if not len(tri):
        return []
    radius = np.hypot(*(centre - points[tri[:, 0]]).T)
    edges = np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]])
    owner = np.tile(np.arange(len(tri)), 3)
    code = np.sort(edges, axis=1) @ np.array([len(points), 1])
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    twice = np.flatnonzero(code[1:] == code[:-1])
    i, j = owner[twice], owner[twice + 1]
    fine = (radius[i] > 0.51 * step) & (radius[j] > 0.51 * step)
    p, q = centre[i[fine]], centre[j[fine]]
    long = np.hypot(*(p - q).T) > 1e-3
    p, q = p[long], q[long]
    if not len(p):
        return []
    middle = (p + q) / 2
    ok = inside_ring(ring, middle)
    p, q, middle = p[ok], q[ok], middle[ok]
    near = np.array([np.hypot(*(points - m).T).min() for m in middle])
    ok = (2 * near >= least_width) & ~meets_any(p, q, pieces)
    return [np.stack([a, b]) for a, b in zip(p[ok], q[ok], strict=True)]


def meets_any(p: np.ndarray, q: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Whether each segment meets one of the ``pieces`` (n, 4)."""

    def side(ax, ay, bx, by, cx, cy):
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    out = np.zeros(len(p), dtype=bool)
    for at in range(0, len(p), _BLOCK):
        here = slice(at, at + _BLOCK)
        own, other = [c[:, None] for c in (*p[here].T, *q[here].T)], pieces.T
        out[here] = ((side(*own, other[0], other[1]) * side(*own, other[2], other[3]) <= 0) & (side(*other, own[0], own[1]) * side(*other, own[2], own[3]) <= 0)).any(axis=1)
    return out


def boundary_pair_lines(ring: np.ndarray, step: float, axis_bin: float, least_width: float, break_at: float) -> list[np.ndarray]:
    """Lines through the midpoints of the farthest left and right boundary samples along a ring's long axis."""
    rect = smallest_rectangle(ring[:-1])
    if rect is None:
        return []
    axis = np.array(rect[2:])
    sides = np.hypot(*np.diff(ring, axis=0).T)
    upto = np.concatenate([[0.0], np.cumsum(sides)])
    n = max(8, int(upto[-1] / step))
    t = np.arange(n) / n * upto[-1]
    points = np.stack([np.interp(t, upto, ring[:, k]) for k in (0, 1)], axis=1)
    area = ring[:-1, 0] * ring[1:, 1] - ring[1:, 0] * ring[:-1, 1]
    if abs(area.sum()) < 1e-12:
        return []
    rel = points - ((ring[:-1] + ring[1:]) * area[:, None]).sum(axis=0) / (3 * area.sum())
    across = rel @ np.array([-axis[1], axis[0]])
    bins = np.rint(rel @ axis / axis_bin).astype(int)
    lines, open_line = [], []
    for b in np.unique(bins):
        here = np.flatnonzero(bins == b)
        left, right = here[across[here] >= 0], here[across[here] < 0]
        if not len(left) or not len(right):
            continue
        p = points[left[np.argmax(np.round(across[left], 9))]]
        q = points[right[np.argmax(np.round(-across[right], 9))]]
        if np.hypot(*(p - q)) < least_width:
            continue
        m = (p + q) / 2
        if len(open_line) >= 2 and np.hypot(*(m - open_line[-1])) > break_at:
            lines.append(np.array(open_line))
            open_line = []
        open_line.append(m)
    return [*lines, np.array(open_line)] if len(open_line) >= 2 else lines


def to_arrays(column: pa.Array) -> list[np.ndarray | None]:
    """Lines of an Arrow column as arrays of shape (n, 2)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    xy = np.stack([flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)], axis=1) if len(flat) else np.zeros((0, 2))
    sizes = column.value_lengths().to_pylist()
    out, at = [], 0
    for n in sizes:
        out.append(None if n is None else xy[at : at + n])
        at += n or 0
    return out


def from_arrays(lines: list[np.ndarray | None]) -> pa.Array:
    """The other way round."""
    return pa.array([None if g is None else [{"x": float(x), "y": float(y)} for x, y in g] for g in lines], type=ARROW_LINE)


def map_geometry(df: DataFrame, geom: str, fn: Callable[..., object], added: str, kind: str, *inputs: str) -> DataFrame:
    """``df`` with a column ``added`` of Spark type ``kind``: ``fn(line, *inputs)`` of each row, null for a null line."""
    target = T._parse_datatype_string(kind)
    schema = T.StructType([*df.schema.fields, T.StructField(added, target)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(target)
        for batch in batches:
            args = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs]
            values = [None if g is None else fn(g, *rest) for g, *rest in zip(to_arrays(batch.column(batch.schema.get_field_index(geom))), *args, strict=True)]
            values = [_plain(v) for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, type=arrow)], schema=pa.schema([*batch.schema, pa.field(added, arrow)]))

    return df.mapInArrow(run, schema)


def _plain(value: object) -> object:
    if isinstance(value, np.ndarray):
        return [{"x": float(x), "y": float(y)} for x, y in value]
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


Parts = list[np.ndarray] | list[dict[str, np.ndarray]]


def _flat(parts: Parts, names: list[str] | None) -> tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]:
    """How many parts and points there are, and for each field the parts' sizes and all their points."""
    fields = [[part[name] for part in parts] for name in names] if names else [parts]
    flat = [(np.array([len(x) for x in lines], dtype=np.int64), np.concatenate(lines) if lines else np.zeros((0, 2))) for lines in fields]
    return len(parts), sum(len(xy) for _, xy in flat), flat


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _joined(shapes: list, first: np.ndarray, kind: pa.DataType, names: list[str] | None) -> pa.Array:
    """One column of the parts of ``shapes`` (:func:`_flat`), each moved to its row's ``first``; null where a shape is."""
    there = [s for s in shapes if s is not None]
    place = first[[s is not None for s in shapes]]
    fields = []
    for f, line in enumerate([kind.value_type.field(n).type for n in names] if names else [kind.value_type]):
        sizes = np.concatenate([s[2][f][0] for s in there]) if there else np.zeros(0, dtype=np.int64)
        xy = np.concatenate([s[2][f][1] for s in there]) + np.repeat(place, [len(s[2][f][1]) for s in there], axis=0) if there else np.zeros((0, 2))
        points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in xy.T], fields=list(line.value_type))
        fields.append(pa.ListArray.from_arrays(_offsets(sizes), points, type=line))
    parts = pa.StructArray.from_arrays(fields, fields=list(kind.value_type)) if names else fields[0]
    mask = pa.array([s is None for s in shapes]) if len(there) < len(shapes) else None
    return pa.ListArray.from_arrays(_offsets(np.array([0 if s is None else s[0] for s in shapes])), parts, type=kind, mask=mask)


def map_shapes(df: DataFrame, geom: str, fn: Callable[[np.ndarray], Parts], added: str, kind: str) -> DataFrame:
    """``df`` with a column ``added`` of Spark type ``kind``, a list of lines or of structs of lines: the parts that ``fn`` makes of each row's line, null for a null line.

    ``fn`` must not depend on where a line lies: it gets the line with its first
    vertex at the origin, and once only for equal shapes among the last ones.
    """
    target = T._parse_datatype_string(kind)
    schema = T.StructType([*df.schema.fields, T.StructField(added, target)])
    names = target.elementType.names if isinstance(target.elementType, T.StructType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(target)
        known: dict[bytes, tuple] = {}
        held = 0

        def out(batch: pa.RecordBatch, shapes: list, first: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, _joined(shapes, first, arrow, names)], schema=pa.schema([*batch.schema, pa.field(added, arrow)]))

        for batch in batches:
            shapes, first, points, start = [], np.zeros((batch.num_rows, 2)), 0, 0
            for k, line in enumerate(to_arrays(batch.column(batch.schema.get_field_index(geom)))):
                shape = None
                if line is not None:
                    first[k] = line[0] if len(line) else 0.0
                    own = line - first[k]
                    shape = known.get(key := own.tobytes())
                    if shape is None:
                        shape = _flat(fn(own), names)
                        if held > _HELD:
                            known.clear()
                            held = 0
                        known[key] = shape
                        held += len(own) + shape[1]
                    points += shape[1]
                shapes.append(shape)
                if points > _POINTS:
                    yield out(batch.slice(start, k + 1 - start), shapes, first[start : k + 1])
                    shapes, points, start = [], 0, k + 1
            yield out(batch.slice(start), shapes, first[start:])

    return df.mapInArrow(run, schema)


def with_simplified(df: DataFrame, geom: str = "geom", tolerance: str = "tolerance") -> DataFrame:
    """``df`` whose lines are simplified by the row's tolerance."""
    done = map_geometry(df, geom, simplify, "_simple", LINE, tolerance)
    return done.drop(geom).withColumnRenamed("_simple", geom)


def with_rectangle(df: DataFrame, geom: str = "ring") -> DataFrame:
    """``df`` with ``rect``: width, length and long axis of each ring's smallest rectangle; null without area."""

    def rect(ring: np.ndarray) -> dict | None:
        found = smallest_rectangle(ring)
        return None if found is None else dict(zip(("width", "length", "ax", "ay"), found, strict=True))

    return map_geometry(df, geom, rect, "rect", "struct<width:double,length:double,ax:double,ay:double>")


def skeleton_lines(df: DataFrame, step: float, least_width: float, geom: str = "ring") -> DataFrame:
    """``df`` with ``parts``: the Voronoi skeleton of each ring as two-point lines."""
    return map_shapes(df, geom, lambda ring: voronoi_skeleton(ring, step, least_width), "parts", f"array<{LINE}>")


def surface_skeleton(df: DataFrame, step: float, least_width: float, geom: str = "ring", pieces: str = "pieces") -> DataFrame:
    """``df`` with ``parts``: the skeleton of the surface that ``pieces`` (ax, ay, bx, by) bound, within each ring."""

    def parts(ring: np.ndarray, near: list[dict] | None) -> list[np.ndarray]:
        return voronoi_near(ring, np.array([[p["ax"], p["ay"], p["bx"], p["by"]] for p in near or []]).reshape(-1, 4), step, least_width)

    return map_geometry(df, geom, parts, "parts", f"array<{LINE}>", pieces)


def pair_lines(df: DataFrame, step: float, axis_bin: float, least_width: float, break_at: float, geom: str = "ring") -> DataFrame:
    """``df`` with ``parts``: each ring's lines through paired boundary samples."""
    return map_geometry(df, geom, lambda ring: boundary_pair_lines(ring, step, axis_bin, least_width, break_at), "parts", f"array<{LINE}>")
