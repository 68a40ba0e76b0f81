"""Scores of candidate lines and the choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylace.functions import along
from waylace.functions import geometry as G
from waylace.operators.spatial import near_pairs
from waylace.plans.policy import Policy


def sample_count(length: Column, step: float, least: int) -> Column:
    return F.greatest(F.lit(least), F.ceil(length / step).cast("int") + 1)


def line_samples(lines: DataFrame, step: float, least: int) -> DataFrame:
    """``(line_id, n, i, px, py)``: points at equal lengths along each line, both ends included."""
    return along.evenly_spaced(lines, ["line_id"], sample_count(F.col("total"), step, least))


def covered_points(points: DataFrame, boxes: DataFrame, keys: list[str], cell: float = 64.0) -> DataFrame:
    """``keys`` of the points that some box covers, once each."""
    at = (F.col("px"), F.col("py"), F.col("px"), F.col("py"))
    box = (F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))
    return near_pairs(points, boxes.select("x0", "y0", "w", "h"), at, box, 0.0, cell).select(*keys).distinct()


def inside_ratio(lines: DataFrame, boxes: DataFrame, policy: Policy) -> DataFrame:
    """``(line_id, inside_ratio)``: the share of a line's samples that the boxes cover."""
    samples = line_samples(lines, max(policy.selector_step, 0.1), 3)
    hits = covered_points(samples, boxes, ["line_id", "i", "n"]).groupBy("line_id", "n").agg(F.count("*").alias("hits"))
    found = hits.select("line_id", (F.col("hits") / F.col("n")).alias("inside_ratio"))
    return lines.select("line_id").join(found, "line_id", "left").select("line_id", F.coalesce("inside_ratio", F.lit(0.0)).alias("inside_ratio"))


def length_score(length: Column, policy: Policy) -> Column:
    target = max(policy.lane_width * policy.length_factor, policy.min_length)
    return F.lit(1.0) if target <= 0 else G.clamp(length / target, 0, 1)


def quality(lines: DataFrame, boxes: DataFrame, policy: Policy) -> DataFrame:
    """``(line_id, inside_ratio, curvature, length_score, score)``."""
    parts = lines.select("line_id", G.curvature_penalty(F.col("geom")).alias("curvature"), length_score(G.line_length(F.col("geom")), policy).alias("length_score"))
    score = 0.55 * F.col("inside_ratio") + 0.25 * (1 - F.col("curvature")) + 0.20 * F.col("length_score")
    return parts.join(inside_ratio(lines, boxes, policy), "line_id").withColumn("score", G.clamp(score, 0, 1))


_ROOM = 1e-3
_ACCURACY = 10_000


def select_candidates(scored: DataFrame, policy: Policy, group: str | None = None) -> DataFrame:
    """The rows that reach the quality bar; where none does, the best share of ``keep_ratio``.

    The fallback ranks only rows of groups without any passing row, by score and
    then ``line_id``.
    """
    keyed = scored.withColumn("_g", F.col(group) if group else F.lit(1))
    summary = keyed.groupBy("_g").agg(F.count_if(F.col("score") >= policy.min_quality).alias("_passing"), F.count("*").alias("_n"))
    joined = keyed.join(summary, "_g")
    passing = joined.where(F.col("score") >= policy.min_quality).select(*scored.columns)
    keep = F.greatest(F.lit(1), F.ceil(F.col("_n") * policy.keep_ratio))
    left = joined.where("_passing = 0")
    # the last row to keep lies between two approximate percentiles; only rows between them are ordered
    shares = F.array(*[F.lit(min(1.0, max(0.0, 1 - policy.keep_ratio + room))) for room in (-_ROOM, _ROOM)])
    brackets = left.groupBy("_g").agg(F.percentile_approx("score", shares, _ACCURACY).alias("_b"))
    placed = left.join(brackets, "_g")
    above = placed.where(F.col("score") > F.col("_b")[1])
    more = above.groupBy("_g").agg(F.count("*").alias("_above"))
    window = Window.partitionBy("_g").orderBy(F.desc("score"), "line_id")
    between = placed.where((F.col("score") <= F.col("_b")[1]) & (F.col("score") >= F.col("_b")[0])).withColumn("_r", F.row_number().over(window))
    last = between.join(more, "_g", "left").where(F.col("_r") + F.coalesce("_above", F.lit(0)) <= keep)
    best = above.select(*scored.columns).unionByName(last.select(*scored.columns))
    return passing.unionByName(best)


def wide_enough(lines: DataFrame, boxes: DataFrame, policy: Policy) -> DataFrame:
    """Lines whose middle lies in no box, or in none that is narrower there than a lane; lines of no length go."""
    rows = lines.withColumn("length", G.line_length(F.col("geom"))).where("length > 0")
    mid = along.point_at_share(rows, ["line_id"], 0.5)
    at = (F.col("px"), F.col("py"), F.col("px"), F.col("py"))
    box = (F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))
    pairs = near_pairs(mid, boxes.select("x0", "y0", "w", "h"), at, box, 0.0, 64.0)
    depth = G.box_boundary_distance(F.col("px"), F.col("py"), F.col("x0"), F.col("y0"), F.col("w"), F.col("h"))
    inside = (F.col("px") > F.col("x0")) & (F.col("px") < F.col("x0") + F.col("w")) & (F.col("py") > F.col("y0")) & (F.col("py") < F.col("y0") + F.col("h"))
    widths = pairs.where(inside).groupBy("line_id").agg(F.min(2 * depth).alias("width"))
    return rows.join(widths, "line_id", "left").where(F.col("width").isNull() | (F.col("width") >= policy.lane_width)).drop("length")
