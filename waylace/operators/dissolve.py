"""Union of polygons as the set of its boundary pieces, and clusters of polygons.

Rings are cut where they meet; a piece belongs to the union's boundary if just
one of its two sides is covered.  Consumers need the pieces only, so rings are
never stitched and no group of polygons is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylace.functions import geometry as G
from waylace.operators import edits, pairing
from waylace.operators.spatial import near_pairs
from waylace.plans.components import connected_components
from waylace.plans.policy import Policy

#: Distance of the two test points from a piece, in metres; more than rounding to millimetres moves a piece off its ring.
SIDE = 2e-3


def with_holes(ring: Column, holes: Column) -> Column:
    """All rings of a polygon as one line: the outer one, then each hole after a vertex without a place.

    No side that meets such a vertex is ever crossed or has a length, so the
    even-odd rule holds for the whole line.
    """
    nowhere = F.array(G.point(F.lit(float("nan")), F.lit(float("nan"))))
    return F.concat(ring, F.flatten(F.transform(F.coalesce(holes, F.array().cast(f"array<{G.LINE}>")), lambda h: F.concat(nowhere, h))))


def ring_edges(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """The sides of closed rings as an edge table; ``edge_id`` is (poly_id, side)."""
    rows = polygons.select("poly_id", F.posexplode(G.segments(F.col(ring))).alias("k", "s")).where("not isnan(s.a.x) and not isnan(s.b.x)")
    ends = rows.select(F.struct("poly_id", "k").alias("edge_id"), *[F.col(f"s.{p}.{c}").alias(f"{e}{c}") for p, e in (("a", "u"), ("b", "v")) for c in "xy"])
    return ends.select("edge_id", F.struct("ux", "uy").alias("u"), F.struct("vx", "vy").alias("v"), *edits.XY, G.distance(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")).alias("weight"))


def ring_contains(ring: Column, px: Column, py: Column) -> Column:
    """Even-odd test of a point against a closed ring."""

    def crossing(s: Column) -> Column:
        spans = ((s["a"]["y"] <= py) != (s["b"]["y"] <= py)) & ~F.isnan(s["a"]["y"] + s["b"]["y"])
        x = s["a"]["x"] + F.try_divide((py - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"]), s["b"]["y"] - s["a"]["y"])
        return spans & F.coalesce(px < x, F.lit(False))

    return F.aggregate(G.segments(ring), F.lit(False), lambda inside, s: inside != crossing(s))


def ring_box(ring: Column) -> tuple[Column, Column, Column, Column]:
    """Bounding box of a ring."""
    placed = F.filter(ring, lambda p: ~F.isnan(p["x"]))
    x, y = F.transform(placed, lambda p: p["x"]), F.transform(placed, lambda p: p["y"])
    return F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)


def union_boundary(polygons: DataFrame, ring: str = "ring", cell: float = 64.0) -> DataFrame:
    """``(ax, ay, bx, by)``: the boundary pieces of the union of all rings."""
    pieces = edits.planarize(ring_edges(polygons, ring))
    nx, ny = G.left_normal(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    mx, my = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    sides = pieces.select("*", F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("side")).select("ax", "ay", "bx", "by", "side", (mx + nx * SIDE * F.col("side")).alias("px"), (my + ny * SIDE * F.col("side")).alias("py"))
    at = (F.col("px"), F.col("py"), F.col("px"), F.col("py"))
    # part of the join: a filter after it would be tried before the comparison of boxes
    covered = near_pairs(sides, polygons.select(F.col(ring).alias("_ring")), at, ring_box(F.col("_ring")), 0.0, cell, ring_contains(F.col("_ring"), F.col("px"), F.col("py")), merged=True)
    once = covered.groupBy("ax", "ay", "bx", "by").agg(F.min("side").alias("low"), F.max("side").alias("high"))
    return once.where("low = high").drop("low", "high")


def polygon_clusters(boxes: DataFrame, policy: Policy) -> DataFrame:
    """``(poly_id, cluster)``: polygons joined by pairs that attach.

    Clusters are the closure of the pair rule, so they do not depend on the order
    in which polygons come.  They inform reports; the union is the same with or
    without them.
    """
    pairs = pairing.pair_features(boxes, policy).where(pairing.attaches(policy))
    members = connected_components(pairs, "i", "j").select(F.col("node").alias("poly_id"), F.col("root").alias("cluster"))
    return boxes.select("poly_id").join(members, "poly_id", "left").select("poly_id", F.coalesce("cluster", "poly_id").alias("cluster"))
