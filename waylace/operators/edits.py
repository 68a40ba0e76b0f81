"""Edits of the network: parallels, reconnection, smoothing, planarizing, bridges, chains.

Straight edges have ``edge_id, u, v, ux, uy, vx, vy, weight``; edges with a
course have ``geom`` as well.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylace.functions import geometry as G
from waylace.functions import graphs
from waylace.operators.spatial import near_pairs
from waylace.plans.policy import Policy
from waylace.plans.scratch import materialize

XY = ("ux", "uy", "vx", "vy")


def edge_box(p: str = "") -> tuple[Column, Column, Column, Column]:
    c = lambda n: F.col(f"{p}{n}")
    return F.least(c("ux"), c("vx")), F.least(c("uy"), c("vy")), F.greatest(c("ux"), c("vx")), F.greatest(c("uy"), c("vy"))


def _side(edges: DataFrame, p: str) -> DataFrame:
    hx, hy = G.unit(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy"))
    return edges.select(*[F.col(c).alias(f"{p}{c}") for c in ("edge_id", "u", "v", *XY)], hx.alias(f"{p}hx"), hy.alias(f"{p}hy"))


def edge_pairs(edges: DataFrame, reach: float, cell: float = 8.0, also: Column | None = None) -> DataFrame:
    """Pairs of edges ``a_edge_id < b_edge_id`` whose boxes come within ``reach``, with unit directions ``hx, hy`` of both."""
    first = F.col("a_edge_id") < F.col("b_edge_id")
    return near_pairs(_side(edges, "a_"), _side(edges, "b_"), edge_box("a_"), edge_box("b_"), reach, cell, first if also is None else first & also, spread=True)


def _alike(max_angle: float) -> Column:
    """A cheap test that leaves all pairs of edges within an angle, and hardly any others."""
    return F.abs(F.col("a_hx") * F.col("b_hx") + F.col("a_hy") * F.col("b_hy")) >= math.cos(math.radians(max_angle)) - 1e-9


def _apart(p: str = "a_", q: str = "b_") -> Column:
    return G.segment_distance(*[F.col(f"{p}{c}") for c in XY], *[F.col(f"{q}{c}") for c in XY])


def _direction(p: str) -> tuple[Column, Column]:
    return F.col(f"{p}vx") - F.col(f"{p}ux"), F.col(f"{p}vy") - F.col(f"{p}uy")


def parallel_pairs(edges: DataFrame, max_distance: float, max_angle: float) -> DataFrame:
    """``(i, j, distance, angle)`` of near edges that run alike; edges with a common end have distance 0."""
    pairs = edge_pairs(edges, max_distance, also=_alike(max_angle))
    angle = G.undirected_angle(F.col("a_hx"), F.col("a_hy"), F.col("b_hx"), F.col("b_hy"))
    rows = pairs.select(F.col("a_edge_id").alias("i"), F.col("b_edge_id").alias("j"), _apart().alias("distance"), angle.alias("angle"))
    return rows.where((F.col("angle") <= max_angle) & (F.col("distance") <= max_distance))


def has_parallel_pair(edges: DataFrame, max_distance: float, max_angle: float) -> DataFrame:
    """One row ``found``: whether any pair is near and folded to within the angle; edges of no length never are."""
    pairs = edge_pairs(edges, max_distance, also=_alike(max_angle))
    near = (G.folded_angle(*_direction("a_"), *_direction("b_")) <= max_angle) & (_apart() <= max_distance)
    return pairs.where(near).limit(1).agg((F.count("*") > 0).alias("found"))


def endpoint_headings(edges: DataFrame) -> DataFrame:
    """``(n, x, y, hx, hy)`` for nodes of degree 1: place, and unit direction away from the neighbour."""
    there = edges.select(F.col("u").alias("n"), F.col("ux").alias("x"), F.col("uy").alias("y"), F.col("vx").alias("ox"), F.col("vy").alias("oy"))
    back = edges.select(F.col("v").alias("n"), F.col("vx").alias("x"), F.col("vy").alias("y"), F.col("ux").alias("ox"), F.col("uy").alias("oy"))
    leaves = graphs.node_degree(edges).where("degree = 1").select("n")
    hx, hy = G.unit(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    rows = there.unionByName(back).join(leaves, "n", "left_semi")
    return rows.where("x <> ox or y <> oy").select("n", "x", "y", hx.alias("hx"), hy.alias("hy"))


def reconnect_candidates(edges: DataFrame, policy: Policy) -> DataFrame:
    """``(a, b, distance, angle)``: leaves ``a < b`` in reach that head alike (in either sense) and are not joined."""
    ends = endpoint_headings(edges)
    side = lambda p: ends.select(*[F.col(c).alias(f"{p}{c}") for c in ends.columns])
    box = lambda p: (F.col(f"{p}x"), F.col(f"{p}y"), F.col(f"{p}x"), F.col(f"{p}y"))
    reach = policy.reconnect_radius
    pairs = near_pairs(side("a_"), side("b_"), box("a_"), box("b_"), reach, 2 * reach, F.col("a_n") < F.col("b_n"))
    rows = pairs.select(
        F.col("a_n").alias("a"),
        F.col("b_n").alias("b"),
        G.distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y")).alias("distance"),
        G.undirected_angle(F.col("a_hx"), F.col("a_hy"), F.col("b_hx"), F.col("b_hy")).alias("angle"),
        *[F.col(c) for c in ("a_x", "a_y", "b_x", "b_y")],
    ).where((F.col("distance") <= reach) & (F.col("angle") <= policy.reconnect_angle) & (F.col("distance") > 0))
    joined = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    return rows.join(joined, ["a", "b"], "left_anti")


def reconnect_inside(candidates: DataFrame, boxes: DataFrame, policy: Policy) -> DataFrame:
    """Candidates whose straight link lies inside the boxes by the required share.

    Boxes must not overlap (parts of a dissolved surface do not).
    """
    ends = ("a_x", "a_y", "b_x", "b_y")
    line = (F.least("a_x", "b_x"), F.least("a_y", "b_y"), F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y"))
    box = (F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))
    pairs = near_pairs(candidates, boxes.select("x0", "y0", "w", "h"), line, box, 0.0, 64.0)
    inside = G.box_clip_length(*[F.col(c) for c in ends], F.col("x0"), F.col("y0"), F.col("w"), F.col("h"))
    share = pairs.groupBy("a", "b").agg(F.sum(inside).alias("inside"))
    return candidates.join(share, ["a", "b"]).where(F.col("inside") >= policy.reconnect_inside_ratio * F.col("distance")).select("a", "b", "distance", "angle", "inside")


def _covered_stretches(links: DataFrame, pieces: DataFrame, reach: float) -> DataFrame:
    """``(a, b, lo, hi)``: the shares of each link within ``reach`` of a boundary piece.

    The points within a distance of a segment are convex, so a link has one such
    stretch for each piece: it spans those within the two end discs and the band.
    """
    line = (F.least("a_x", "b_x"), F.least("a_y", "b_y"), F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y"))
    box = (F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by"))
    pairs = near_pairs(links, pieces, line, box, reach, 64.0)
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    ex, ey = G.unit(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    # in steps, so that no expression is written out many times
    rows = pairs.withColumns({"dx": dx, "dy": dy, "size": dx * dx + dy * dy, "ex": ex, "ey": ey, "long": G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))})
    col = F.col
    steps: dict[str, Column] = {}
    for c in "ab":  # discs around both ends of the piece
        wx, wy = col("a_x") - col(f"{c}x"), col("a_y") - col(f"{c}y")
        steps |= {f"half{c}": wx * col("dx") + wy * col("dy"), f"over{c}": wx * wx + wy * wy - reach * reach}
    wx, wy = col("a_x") - col("ax"), col("a_y") - col("ay")  # the band: along the piece, and across it
    steps |= {"s0": wx * col("ex") + wy * col("ey"), "d0": col("dx") * col("ex") + col("dy") * col("ey"), "s1": wy * col("ex") - wx * col("ey"), "d1": col("dy") * col("ex") - col("dx") * col("ey")}
    rows = rows.withColumns(steps)
    steps = {f"root{c}": F.sqrt(F.when(col(f"half{c}") * col(f"half{c}") >= col("size") * col(f"over{c}"), col(f"half{c}") * col(f"half{c}") - col("size") * col(f"over{c}"))) for c in "ab"}
    for k, least, most in (("0", F.lit(0.0), col("long")), ("1", F.lit(-reach), F.lit(reach))):
        t1, t2 = F.try_divide(least - col(f"s{k}"), col(f"d{k}")), F.try_divide(most - col(f"s{k}"), col(f"d{k}"))
        off = (F.abs(f"d{k}") < 1e-12) & ((col(f"s{k}") < least) | (col(f"s{k}") > most))
        steps |= {f"in{k}": F.when(~off, F.coalesce(F.least(t1, t2), F.lit(0.0))), f"out{k}": F.when(~off, F.coalesce(F.greatest(t1, t2), F.lit(1.0)))}
    rows = rows.withColumns(steps)
    band = (col("in0") + col("in1")).isNotNull()
    rows = rows.withColumns({"low": F.when(band, F.greatest("in0", "in1", F.lit(0.0))), "high": F.when(band, F.least("out0", "out1", F.lit(1.0)))})
    rows = rows.withColumns({"low": F.when(col("low") <= col("high"), col("low")), "high": F.when(col("low") <= col("high"), col("high"))})
    ends = [[(sign * col(f"root{c}") - col(f"half{c}")) / col("size") for c in "ab"] for sign in (-1.0, 1.0)]
    rows = rows.select("a", "b", F.greatest(F.least(*ends[0], "low"), F.lit(0.0)).alias("lo"), F.least(F.greatest(*ends[1], "high"), F.lit(1.0)).alias("hi"))
    return materialize(rows, "stretches").where("lo <= hi")  # written first: the filter would carry all of this below the join


def inner_stretches(links: DataFrame, pieces: DataFrame, covered: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """``(a, b, lo, hi)``: the shares of each link inside the surface that ``pieces`` bound.

    Links are cut where they meet the boundary; ``covered(samples, keys)`` tells
    which middles (``px, py``) lie in the surface.
    """
    line = (F.least("a_x", "b_x"), F.least("a_y", "b_y"), F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y"))
    box = (F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by"))
    met = near_pairs(links, pieces, line, box, 0.0, 64.0)
    dx, dy, ex, ey = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y"), F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    wx, wy = F.col("ax") - F.col("a_x"), F.col("ay") - F.col("a_y")
    det, size = dx * ey - dy * ex, dx * dx + dy * dy
    t, s = F.try_divide(wx * ey - wy * ex, det), F.try_divide(wx * dy - wy * dx, det)
    level = (F.abs(det) < 1e-12) & (F.abs(wx * dy - wy * dx) < 1e-9)
    ends = [F.when(level, ((F.col(f"{c}x") - F.col("a_x")) * dx + (F.col(f"{c}y") - F.col("a_y")) * dy) / size) for c in "ab"]
    cuts = met.select("a", "b", F.explode(F.array(F.when(s.between(-1e-9, 1 + 1e-9), t), *ends)).alias("t")).where("t > 0 and t < 1")
    cuts = cuts.unionByName(links.select("a", "b", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))).distinct()
    parts = cuts.withColumn("hi", F.lead("t").over(Window.partitionBy("a", "b").orderBy("t"))).where("hi is not null").withColumnRenamed("t", "lo")
    parts = materialize(parts, "stretches")
    middle = (F.col("lo") + F.col("hi")) / 2
    samples = parts.join(links.select("a", "b", "a_x", "a_y", "b_x", "b_y"), ["a", "b"]).select("a", "b", "lo", (F.col("a_x") + middle * dx).alias("px"), (F.col("a_y") + middle * dy).alias("py"))
    return parts.join(covered(samples, ["a", "b", "lo"]), ["a", "b", "lo"])


def links_on_surface(links: DataFrame, pieces: DataFrame, covered: Callable[[DataFrame, list[str]], DataFrame], policy: Policy) -> DataFrame:
    """Links (:func:`reconnect_candidates`) that lie in a surface by the required share, or wholly within the buffer around it."""
    inner = materialize(inner_stretches(links, pieces, covered), "inner")
    share = inner.groupBy("a", "b").agg(F.sum(F.col("hi") - F.col("lo")).alias("share"))
    spans = inner.select("a", "b", "lo", "hi").unionByName(_covered_stretches(links, pieces, policy.reconnect_buffer))
    upto = F.max("hi").over(Window.partitionBy("a", "b").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    gaps = spans.withColumn("upto", F.coalesce(upto, F.lit(0.0)))
    whole = gaps.groupBy("a", "b").agg((F.max(F.col("lo") - F.col("upto")) <= 1e-9).alias("closed"), (F.max("hi") >= 1 - 1e-9).alias("reaches"))
    judged = links.join(share, ["a", "b"], "left").join(whole, ["a", "b"], "left")
    fits = (F.coalesce("share", F.lit(0.0)) >= policy.reconnect_inside_ratio) | F.coalesce(F.col("closed") & F.col("reaches"), F.lit(False))
    return judged.where(fits).select(*links.columns)


def reconnected(edges: DataFrame, pieces: DataFrame, covered: Callable[[DataFrame, list[str]], DataFrame], policy: Policy) -> DataFrame:
    """``edges`` (with ``geom``) and a straight edge for each break that is closed."""
    links = materialize(reconnect_candidates(edges, policy), "links")
    found = links_on_surface(links, pieces, covered, policy)
    geom = F.array(G.point(F.col("a_x"), F.col("a_y")), G.point(F.col("b_x"), F.col("b_y")))
    new = found.select(F.xxhash64(F.to_json(geom)).alias("edge_id"), F.col("a").alias("u"), F.col("b").alias("v"), F.col("a_x").alias("ux"), F.col("a_y").alias("uy"), F.col("b_x").alias("vx"), F.col("b_y").alias("vy"), geom.alias("geom"), F.col("distance").alias("weight"))
    return edges.unionByName(new.select(*edges.columns))


def mean_directions(edges: DataFrame) -> DataFrame:
    """``(n, neighbours, mx, my)`` for nodes with two or more neighbours: mean unit direction towards them."""
    there = edges.select(F.col("u").alias("n"), (F.col("vx") - F.col("ux")).alias("dx"), (F.col("vy") - F.col("uy")).alias("dy"))
    back = edges.select(F.col("v").alias("n"), (F.col("ux") - F.col("vx")).alias("dx"), (F.col("uy") - F.col("vy")).alias("dy"))
    x, y = G.unit(F.col("dx"), F.col("dy"))
    return there.unionByName(back).groupBy("n").agg(F.count("*").alias("neighbours"), F.avg(x).alias("mx"), F.avg(y).alias("my")).where("neighbours >= 2")


def direction_field(edges: DataFrame, policy: Policy) -> DataFrame:
    """``(n, dx, dy)``: how far smoothing moves each inner node along its mean direction."""
    move = policy.smooth_alpha * policy.smooth_target_shift
    ux, uy = G.unit(F.col("mx"), F.col("my"))
    return mean_directions(edges).select("n", (ux * move).alias("dx"), (uy * move).alias("dy"))


def with_moved_ends(edges: DataFrame, shifts: DataFrame) -> DataFrame:
    """``edges`` (with ``geom``) whose ends follow their nodes; other nodes stay."""
    u = shifts.select(F.col("n").alias("u"), F.col("dx").alias("_ux"), F.col("dy").alias("_uy"))
    v = shifts.select(F.col("n").alias("v"), F.col("dx").alias("_vx"), F.col("dy").alias("_vy"))
    zero = F.lit(0.0)
    moved = edges.join(u, "u", "left").join(v, "v", "left").fillna(0.0, ["_ux", "_uy", "_vx", "_vy"])
    old_u, old_v = G.point(F.col("ux"), F.col("uy")), G.point(F.col("vx"), F.col("vy"))
    new_u, new_v = G.point(F.col("ux") + F.col("_ux"), F.col("uy") + F.col("_uy")), G.point(F.col("vx") + F.col("_vx"), F.col("vy") + F.col("_vy"))
    geom = G.with_ends(F.col("geom"), old_u, old_v, new_u, new_v)
    out = moved.withColumn("geom", geom)
    for c in XY:
        out = out.withColumn(c, F.col(c) + F.coalesce(F.col(f"_{c}"), zero))
    return out.drop("_ux", "_uy", "_vx", "_vy")


def cut_places(edges: DataFrame) -> DataFrame:
    """``(edge_id, t)``: where other edges meet the inside of an edge, as a share of its length.

    Crossings, ends that touch from the side, and ends of collinear overlaps.
    """
    eps = 1e-9
    pairs = edge_pairs(edges, 0.0)
    p, q = _direction("a_"), _direction("b_")
    wx, wy = F.col("b_ux") - F.col("a_ux"), F.col("b_uy") - F.col("a_uy")
    det = p[0] * q[1] - p[1] * q[0]
    t, s = F.try_divide(wx * q[1] - wy * q[0], det), F.try_divide(wx * p[1] - wy * p[0], det)
    meets = (det != 0) & t.between(-eps, 1 + eps) & s.between(-eps, 1 + eps)
    inner = lambda c: (c > eps) & (c < 1 - eps)
    level = (det == 0) & (F.abs(wx * p[1] - wy * p[0]) <= eps)

    def share(point: tuple[Column, Column], on: str, along: tuple[Column, Column]) -> Column:
        return F.try_divide((point[0] - F.col(f"{on}ux")) * along[0] + (point[1] - F.col(f"{on}uy")) * along[1], along[0] * along[0] + along[1] * along[1])

    ends = lambda side: [(F.col(f"{side}{e}x"), F.col(f"{side}{e}y")) for e in "uv"]
    on_a = [F.when(meets, t), *[F.when(level, share(e, "a_", p)) for e in ends("b_")]]
    on_b = [F.when(meets, s), *[F.when(level, share(e, "b_", q)) for e in ends("a_")]]
    rows = pairs.select(
        F.explode(
            F.array(
                *[F.struct(F.col("a_edge_id").alias("edge_id"), c.alias("t")) for c in on_a],
                *[F.struct(F.col("b_edge_id").alias("edge_id"), c.alias("t")) for c in on_b],
            )
        ).alias("c")
    ).select("c.edge_id", "c.t")
    return rows.where(inner(F.col("t"))).select("edge_id", F.round("t", 9).alias("t")).distinct()


def planarize(edges: DataFrame) -> DataFrame:
    """``(ax, ay, bx, by)``: pieces between all meeting points, in millimetres, once each, lower end first."""
    cuts = cut_places(edges).unionByName(edges.select("edge_id", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t")))
    window = Window.partitionBy("edge_id").orderBy("t")
    spans = cuts.withColumn("t2", F.lead("t").over(window)).where("t2 is not null")
    rows = spans.join(edges.select("edge_id", *XY).hint("merge"), "edge_id")  # edges may be far more than their file's size tells
    at = lambda c: [G.snapped(F.col(f"u{axis}") + F.col(c) * (F.col(f"v{axis}") - F.col(f"u{axis}"))) for axis in "xy"]
    a, b = F.struct(*[v.alias(n) for v, n in zip(at("t"), "xy", strict=True)]), F.struct(*[v.alias(n) for v, n in zip(at("t2"), "xy", strict=True)])
    pieces = rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    return pieces.select(F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def bridge_candidates(edges: DataFrame, max_length: float = 1.5, min_degree: int = 3) -> DataFrame:
    """Short edges between two junctions."""
    return graphs.with_degrees(edges).where((F.col("deg_u") >= min_degree) & (F.col("deg_v") >= min_degree) & (F.col("u") != F.col("v")) & (F.col("weight") <= max_length))


def guarded_bridges(edges: DataFrame, max_length: float = 1.5, max_angle: float = 15.0) -> DataFrame:
    """``bridge_candidates`` with ``preserve``: whether lines run on in parallel at both of its ends.

    Directions are those in which edges leave a node: to the next vertex of
    ``geom``, which runs from u to v, or to the other end where there is none.
    """
    bridges = bridge_candidates(edges, max_length)
    if "geom" in edges.columns:  # towards the vertex next to the node
        next_u, next_v, last = F.element_at("geom", 2), F.element_at("geom", -2), F.element_at("geom", -1)
        first = F.element_at("geom", 1)
        du, dv = (next_u["x"] - first["x"], next_u["y"] - first["y"]), (next_v["x"] - last["x"], next_v["y"] - last["y"])
    else:
        du = (F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy"))
        dv = (-du[0], -du[1])
    outward = edges.select("edge_id", F.explode(F.array(*[F.struct(F.col(n).alias("n"), d[0].alias("dx"), d[1].alias("dy")) for n, d in (("u", du), ("v", dv))])).alias("o")).select("edge_id", "o.*")
    x, y = G.unit(F.col("dx"), F.col("dy"))
    unit = outward.where("dx <> 0 or dy <> 0").select("edge_id", "n", x.alias("x"), y.alias("y"))
    side = lambda end: bridges.select(F.col("edge_id").alias("bridge"), F.col(end).alias("n")).join(unit, "n").where("edge_id <> bridge").select("bridge", F.col("x").alias(f"{end}x"), F.col("y").alias(f"{end}y"))
    both = side("u").join(side("v"), "bridge")
    alike = both.where(G.undirected_angle(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")) <= max_angle).select(F.col("bridge").alias("edge_id")).distinct().withColumn("preserve", F.lit(True))
    return bridges.join(alike, "edge_id", "left").withColumn("preserve", F.coalesce("preserve", F.lit(False)))


def smooth_junctions(edges: DataFrame, radius: float = 2.0, min_degree: int = 3) -> DataFrame:
    """``edges`` (with ``geom``) without inner vertices close to a junction at either end."""
    rows = graphs.with_degrees(edges)
    node = lambda d, x, y: F.when(F.col(d) >= min_degree, G.point(F.col(x), F.col(y)))
    once = rows.withColumn("geom", G.without_near_interior(F.col("geom"), node("deg_u", "ux", "uy"), radius))
    return once.withColumn("geom", G.without_near_interior(F.col("geom"), node("deg_v", "vx", "vy"), radius)).drop("deg_u", "deg_v")


def simplify_tolerance(edges: DataFrame, main: float = 0.05, junction: float = 0.12, min_degree: int = 3) -> DataFrame:
    """``edges`` with ``tolerance``: the looser one for edges at a junction."""
    rows = graphs.with_degrees(edges)
    return rows.withColumn("tolerance", F.when((F.col("deg_u") >= min_degree) | (F.col("deg_v") >= min_degree), junction).otherwise(main)).drop("deg_u", "deg_v")


def edge_chains(edges: DataFrame) -> DataFrame:
    """Each edge's chain through degree-2 nodes: ``edge_id, chain, start, finish, position, forward``.

    ``chain`` is the smaller of the two edges at the chain's ends, ``start`` the
    node there; ``position`` counts from it and ``forward`` tells whether the
    edge points away from it.  Rings of degree-2 nodes are left out.
    """
    walks = graphs.chain_walks(edges).where("last is not null").select("edge_id", "forward", "last", "last_edge", "hops")
    there = walks.where("forward").select("edge_id", F.struct("last_edge", "last").alias("head"), F.col("hops").alias("to_head"))
    back = walks.where("not forward").select("edge_id", F.struct("last_edge", "last").alias("tail"), F.col("hops").alias("to_tail"))
    both = there.join(back, "edge_id")
    from_tail = F.col("tail") <= F.col("head")
    pick = lambda a, b: F.when(from_tail, a).otherwise(b)
    return both.select(
        "edge_id",
        pick(F.col("tail.last_edge"), F.col("head.last_edge")).alias("chain"),
        pick(F.col("tail.last"), F.col("head.last")).alias("start"),
        pick(F.col("head.last"), F.col("tail.last")).alias("finish"),
        pick(F.col("to_tail"), F.col("to_head")).alias("position"),
        from_tail.alias("forward"),
    )


def merge_chains(edges: DataFrame) -> DataFrame:
    """One edge for each chain: ``edge_id, u, v, weight, parts`` and, where given, the joined ``geom``.

    Lengths are kept also where chains are rings through one junction or run
    beside another; rings without a junction stay as their edges.
    """
    chains = edge_chains(edges)
    rows = edges.join(chains, "edge_id")
    columns = [F.sum("weight").alias("weight"), F.count("*").alias("parts")]
    if "geom" in edges.columns:
        oriented = F.when(F.col("forward"), F.col("geom")).otherwise(F.reverse("geom"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", oriented.alias("g")))), lambda s: s["g"])
        tails = F.flatten(F.transform(ordered, lambda g: F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0)))))
        columns.append(F.concat(F.slice(F.get(ordered, F.lit(0)), 1, 1), tails).alias("geom"))
    merged = rows.groupBy("chain", "start", "finish").agg(*columns).withColumnsRenamed({"chain": "edge_id", "start": "u", "finish": "v"})
    rings = edges.join(chains.select("edge_id"), "edge_id", "left_anti").withColumn("parts", F.lit(1).cast("long"))
    return merged.unionByName(rings.select(*merged.columns))


def split_parallels(edges: DataFrame, policy: Policy) -> DataFrame:
    """``edges`` (with ``geom``) where of each near and parallel pair the later edge is shifted to its left, once.

    Directions run from the smaller to the larger node, so the side does not
    depend on how an edge was entered.
    """
    pairs = parallel_pairs(edges, policy.lane_width * policy.parallel_distance_factor, policy.parallel_angle)
    later = pairs.select(F.col("j").alias("edge_id")).distinct().withColumn("_moved", F.lit(True))
    sign = F.when(F.col("u") <= F.col("v"), 1.0).otherwise(-1.0)
    nx, ny = G.left_normal((F.col("vx") - F.col("ux")) * sign, (F.col("vy") - F.col("uy")) * sign)
    by = policy.parallel_offset_factor * policy.lane_width
    rows = edges.join(later, "edge_id", "left")
    return rows.withColumn("geom", F.when(F.col("_moved"), G.translate(F.col("geom"), nx * by, ny * by)).otherwise(F.col("geom"))).drop("_moved")


def contract_bridges(edges: DataFrame, max_length: float = 1.5, max_angle: float = 15.0) -> DataFrame:
    """``edges`` with short bridges between junctions contracted to their midpoint.

    In each round the bridges that come first at both of their ends (by length,
    then ``edge_id``) and are not guarded are contracted together; the merged
    node takes the smaller name and the rounded midpoint.  Edges between merged
    nodes go.
    """
    current = edges
    while True:  # each round contracts at least the first of all bridges
        ready = materialize(guarded_bridges(current, max_length, max_angle).where("not preserve").select("edge_id", "u", "v", *XY, "weight"), "bridges")
        if ready.isEmpty():
            break
        order = F.struct("weight", "edge_id")
        first = ready.select(F.explode(F.array("u", "v")).alias("n"), order.alias("o")).groupBy("n").agg(F.min("o").alias("o"))
        at_u, at_v = first.select(F.col("n").alias("u"), F.col("o").alias("ou")), first.select(F.col("n").alias("v"), F.col("o").alias("ov"))
        chosen = ready.join(at_u, "u").join(at_v, "v").where((F.col("ou") == order) & (F.col("ov") == order))
        mid = lambda c: G.snapped((F.col(f"u{c}") + F.col(f"v{c}")) / 2)
        moves = materialize(
            chosen.select("edge_id", F.explode(F.array("u", "v")).alias("n"), F.least("u", "v").alias("to"), mid("x").alias("x"), mid("y").alias("y")), "moves"
        )
        kept = current.join(moves.select("edge_id").distinct(), "edge_id", "left_anti")
        for end in "uv":
            m = moves.select(F.col("n").alias(end), "to", "x", "y")
            kept = kept.join(m, end, "left").withColumns({end: F.coalesce("to", end), f"{end}x": F.coalesce("x", f"{end}x"), f"{end}y": F.coalesce("y", f"{end}y")}).drop("to", "x", "y")
        kept = kept.where("u <> v")
        length = G.distance(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy"))
        if "geom" in edges.columns:
            ends = G.with_ends(F.col("geom"), G.point(F.element_at("geom", 1)["x"], F.element_at("geom", 1)["y"]), F.element_at("geom", -1), G.point(F.col("ux"), F.col("uy")), G.point(F.col("vx"), F.col("vy")))
            kept = kept.withColumn("geom", ends)
            length = G.line_length(F.col("geom"))
        current = materialize(kept.withColumn("weight", length).select(*edges.columns), "contracted")
    return current
