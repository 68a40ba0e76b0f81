"""Nearest boundary of points, by rounds of growing reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylace.functions import geometry as G
from waylace.operators.spatial import near_pairs
from waylace.plans.scratch import discard, materialize

FIRST_REACH = 8.0
GROWTH = 4.0


def _box() -> tuple[Column, Column, Column, Column]:
    return F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")


def boundary_within(points: DataFrame, boxes: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """``keys, dist``: each point's least distance to a box's boundary, where that is at most ``reach``."""
    at = (F.col("px"), F.col("py"), F.col("px"), F.col("py"))
    pairs = near_pairs(points.select(*keys, "px", "py"), boxes.select("x0", "y0", "w", "h"), at, _box(), reach, max(64.0, 2 * reach))
    d = G.box_boundary_distance(F.col("px"), F.col("py"), F.col("x0"), F.col("y0"), F.col("w"), F.col("h"))
    return pairs.groupBy(*keys).agg(F.min(d).alias("dist")).where(F.col("dist") <= reach)


def nearest_boundary(points: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, dist`` for every point; no rows if there are no boxes.

    A distance found within the reach of a round is exact; only points without
    one go on to the next round, whose reach is several times larger.
    """
    if boxes.isEmpty():
        return boundary_within(points, boxes, keys, FIRST_REACH)
    left = materialize(points.select(*keys, "px", "py"), "points")
    reach, found = FIRST_REACH, None
    while True:
        here = materialize(boundary_within(left, boxes, keys, reach), "nearest")
        found = here if found is None else found.unionByName(here)
        rest = materialize(left.join(here, keys, "left_anti"), "points")
        discard(left)
        left = rest
        if left.isEmpty():
            return found
        reach *= GROWTH
