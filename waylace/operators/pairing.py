"""Polygon pairs: features, score, the rule of attachment, and boundary pairing.

Boxes ``(poly_id, x0, y0, w, h)`` stand for polygons that are given by their
axis-aligned rectangle; general polygons go through ``functions.kernels``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylace.functions import geometry as G
from waylace.operators.spatial import near_pairs
from waylace.plans.policy import Policy


def _axis_x(p: str) -> Column:
    """Long axis of a box: x if its width is at least its height (the first longest side wins), else y."""
    return (F.col(f"{p}w") >= F.col(f"{p}h")).cast("double")


def pair_features(boxes: DataFrame, policy: Policy) -> DataFrame:
    """``(i, j, distance, shared_ratio, axis_similarity, score)`` for boxes ``i < j`` within the merge distance."""
    reach = max(policy.merge_distance, 1e-6)
    side = lambda p: boxes.select(F.col("poly_id").alias(f"{p}id"), *[F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "w", "h")])
    box = lambda p: (F.col(f"{p}x0"), F.col(f"{p}y0"), F.col(f"{p}x0") + F.col(f"{p}w"), F.col(f"{p}y0") + F.col(f"{p}h"))
    pairs = near_pairs(side("a_"), side("b_"), box("a_"), box("b_"), reach, 64.0, F.col("a_id") < F.col("b_id"))
    perimeter = F.greatest(F.lit(1.0), F.least(2 * (F.col("a_w") + F.col("a_h")), 2 * (F.col("b_w") + F.col("b_h"))))
    rows = pairs.select(
        F.col("a_id").alias("i"),
        F.col("b_id").alias("j"),
        G.box_distance("a_", "b_").alias("distance"),
        (G.box_shared_boundary("a_", "b_") / perimeter).alias("shared_ratio"),
        F.abs(_axis_x("a_") * _axis_x("b_") + (1 - _axis_x("a_")) * (1 - _axis_x("b_"))).alias("axis_similarity"),
    ).where(F.col("distance") <= reach)
    hi = policy.shared_ratio
    near = F.greatest(F.lit(0.0), 1 - F.col("distance") / reach)
    unrelated = (F.col("distance") <= reach) & (F.col("shared_ratio") < hi / 2) & (F.col("axis_similarity") < 0.55)
    score = 1.2 * F.col("shared_ratio") / hi + 0.9 * F.col("axis_similarity") + 0.3 * near - F.when(unrelated, 2.0).otherwise(0.0)
    return rows.withColumn("score", score)


def attaches(policy: Policy) -> Column:
    """The rule of attachment on a row of pair features."""
    reach, hi = max(policy.merge_distance, 1e-6), policy.shared_ratio
    d, ratio, axis = F.col("distance"), F.col("shared_ratio"), F.col("axis_similarity")
    return (
        F.when((d <= reach) & (ratio < hi / 2) & (axis < 0.55), False)
        .when((ratio >= hi) & (axis >= 0.55), True)
        .when((ratio >= hi / 2) & (axis >= 0.75) & (d <= reach), True)
        .otherwise(F.col("score") >= 1.8)
    )


def best_feature(features: DataFrame, members: DataFrame) -> DataFrame:
    """The best pair feature between each cluster and each polygon outside it.

    ``members`` is ``(cluster, poly_id)``.  Ties go to the smaller member.
    """
    columns = ["distance", "shared_ratio", "axis_similarity", "score"]
    both = features.select(F.col("i").alias("member"), F.col("j").alias("candidate"), *columns).unionByName(features.select(F.col("j").alias("member"), F.col("i").alias("candidate"), *columns))
    own = members.select(F.col("cluster").alias("own"), F.col("poly_id").alias("candidate"))
    joined = both.join(members.withColumnRenamed("poly_id", "member"), "member").join(own, "candidate").where("own <> cluster")
    best = F.max_by(F.struct("member", *columns), F.struct(F.col("score"), -F.col("member")))
    return joined.groupBy("cluster", "candidate").agg(best.alias("best")).select("cluster", "candidate", "best.*")


def boundary_samples(boxes: DataFrame, policy: Policy) -> DataFrame:
    """``(poly_id, i, x, y)``: points at equal steps along each box's outer ring."""
    step = max(policy.pair_step, policy.boundary_step_floor)
    ring = boxes.withColumn("length", 2 * (F.col("w") + F.col("h"))).where("length > 0")
    n = F.greatest(F.lit(8), F.floor(F.col("length") / step).cast("int"))
    rows = ring.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    t = F.col("i") / F.col("n") * F.col("length")
    w, h = F.col("w"), F.col("h")
    along_x = F.when(t <= w, t).when(t <= w + h, w).when(t <= 2 * w + h, 2 * w + h - t).otherwise(0.0)
    along_y = F.when(t <= w, 0.0).when(t <= w + h, t - w).when(t <= 2 * w + h, h).otherwise(2 * w + 2 * h - t)
    return rows.select("poly_id", "i", (F.col("x0") + along_x).alias("x"), (F.col("y0") + along_y).alias("y"))


_MIDS = pa.schema([("poly_id", pa.int64()), ("bin", pa.int64()), *((c, pa.float64()) for c in ("x", "y", "width"))])
#: Samples that are worked on at once; a single box may have more.
_SAMPLES = 1 << 18


def _box_mids(box: np.ndarray, owner: np.ndarray, step: float, axis_bin: float, least_width: float) -> tuple[np.ndarray, ...]:
    """``(owner, bin, x, y, width)`` of boxes (n, 4) sorted by their ``owner``, the place of their polygon."""
    x0, y0, w, h = box.T
    length = 2 * (w + h)
    n = np.maximum(8, np.floor(length / step)).astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    x0, y0, w, h, n, length = (c[of] for c in (x0, y0, w, h, n, length))
    t = i / n * length
    x = x0 + np.select([t <= w, t <= w + h, t <= 2 * w + h], [t, w, 2 * w + h - t], 0.0)
    y = y0 + np.select([t <= w, t <= w + h, t <= 2 * w + h], [np.zeros(len(t)), t - w, h], 2 * w + 2 * h - t)
    rx, ry = x - (x0 + w / 2), y - (y0 + h / 2)
    along, across = np.where(w >= h, rx, ry), np.where(w >= h, ry, -rx)
    bins, left, owner = np.rint(along / axis_bin).astype(np.int64), across >= 0, owner[of]
    # rounding keeps ties between opposite samples from resting on the last bit
    order = np.lexsort((i, -np.round(np.abs(across), 9), ~left, bins, owner))
    owner, bins, left, x, y = (c[order] for c in (owner, bins, left, x, y))
    first = np.ones(len(order), dtype=bool)  # of each side of each bin
    first[1:] = (owner[1:] != owner[:-1]) | (bins[1:] != bins[:-1]) | (left[1:] != left[:-1])
    owner, bins, left, x, y = (c[first] for c in (owner, bins, left, x, y))
    k = np.flatnonzero((owner[1:] == owner[:-1]) & (bins[1:] == bins[:-1]))  # left, then right
    width = np.sqrt((x[k] - x[k + 1]) * (x[k] - x[k + 1]) + (y[k] - y[k + 1]) * (y[k] - y[k + 1]))
    wide = width >= least_width
    k = k[wide]
    return owner[k], bins[k], (x[k] + x[k + 1]) / 2, (y[k] + y[k + 1]) / 2, width[wide]


def _mids_of(batches: Iterator[pa.RecordBatch], step: float, axis_bin: float, least_width: float) -> Iterator[pa.RecordBatch]:
    """Midpoints of rows ``(poly_id, boxes)``, some ``_SAMPLES`` samples at a time."""
    for batch in batches:
        ids, boxes = batch.column(0), batch.column(1)
        flat = boxes.flatten()
        box = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "w", "h")], axis=1) if len(flat) else np.zeros((0, 4))
        owner = np.repeat(np.arange(len(ids)), boxes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        upto = np.cumsum(np.maximum(8, 2 * (box[:, 2] + box[:, 3]) / step))
        part = np.zeros(len(ids), dtype=np.int64)
        part[owner] = (upto // _SAMPLES).astype(np.int64)  # all boxes of a polygon go to the part of its last
        part = np.maximum.accumulate(part)[owner] if len(owner) else owner
        for p in np.unique(part):
            here = part == p
            at, *rest = _box_mids(box[here], owner[here], step, axis_bin, least_width)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *map(pa.array, rest)], schema=_MIDS)


def boundary_mids(boxes: DataFrame, policy: Policy) -> DataFrame:
    """``(poly_id, bin, x, y, width)``: midpoints of the farthest left and right samples in each bin along the axis.

    A polygon's samples (:func:`boundary_samples`) are made and compared in one
    kernel, so that they are never rows: only boxes are shuffled.
    """
    step = max(policy.pair_step, policy.boundary_step_floor)
    parts = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "w", "h")])
    own = boxes.where("2 * (w + h) > 0").groupBy(F.col("poly_id").cast("long").alias("poly_id")).agg(F.collect_list(parts).alias("boxes"))
    return own.mapInArrow(partial(_mids_of, step=step, axis_bin=policy.axis_bin, least_width=policy.lane_width), "poly_id long, bin long, x double, y double, width double")


def break_segments(mids: DataFrame, policy: Policy) -> DataFrame:
    """``mids`` with ``segment``: a new one begins where the gap to the midpoint before exceeds the limit."""
    window = Window.partitionBy("poly_id").orderBy("bin")
    gap = G.distance(F.col("x"), F.col("y"), F.lag("x").over(window), F.lag("y").over(window))
    starts = mids.withColumn("starts", F.coalesce((gap > policy.axis_bin * policy.pair_break_bins).cast("int"), F.lit(0)))
    return starts.withColumn("segment", F.sum("starts").over(window)).drop("starts")


def boundary_pair_lines(mids: DataFrame, policy: Policy) -> DataFrame:
    """``(poly_id, segment, geom)``: lines through the midpoints.

    A lone midpoint is carried over a gap into the next segment, as a segment is
    only closed once it has two points.  Of gaps in a row every other one thus
    closes a segment, from the first; before the first midpoint is one.
    """
    window = Window.partitionBy("poly_id").orderBy("bin")
    gap = G.distance(F.col("x"), F.col("y"), F.lag("x").over(window), F.lag("y").over(window))
    rows = mids.select("poly_id", "bin", "x", "y", F.row_number().over(window).alias("k"), F.coalesce(gap > policy.axis_bin * policy.pair_break_bins, F.lit(True)).alias("apart"))
    near = F.coalesce(F.max(F.when(~F.col("apart"), F.col("k"))).over(window), F.lit(0))  # the last that is no gap
    closes = (F.col("apart") & ((F.col("k") - near) % 2 == 1)).cast("int")
    placed = rows.withColumn("closes", closes).withColumn("segment", (F.sum("closes").over(window) - 1).cast("int"))
    points = F.transform(F.array_sort(F.collect_list(F.struct("bin", "x", "y"))), lambda p: G.point(p["x"], p["y"]))
    return placed.groupBy("poly_id", "segment").agg(points.alias("geom")).where(F.size("geom") >= 2)
