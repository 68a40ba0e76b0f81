"""Queries on polygons: width profile, policy, pairs, boundary samples and pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylace.functions import along
from waylace.functions import geometry as G
from waylace.operators import pairing
from waylace.plans.policy import policy_frame, policy_from_widths, upper_median
from waylace.sources import derived
from waylace.sources.derived import with_tables


def box_widths(spark, sf_dir):
    """Short side of each box's smallest enclosing rectangle."""
    return derived.polys(spark, sf_dir).select("poly_id", F.least("w", "h").alias("width"))


def box_policy(spark, sf_dir):
    return policy_from_widths(box_widths(spark, sf_dir))


def width_samples(spark, sf_dir):
    return box_widths(spark, sf_dir)


def upper_median_width(spark, sf_dir):
    return spark.createDataFrame([(upper_median(box_widths(spark, sf_dir), "width"),)], "median_width double")


def policy_profile(spark, sf_dir):
    row = policy_frame(spark, box_policy(spark, sf_dir))
    return row.select("profile", *[F.round(c, 4).alias(c) for c in _POLICY_COLUMNS])


_POLICY_COLUMNS = ("median_width", "lane_width", "pair_step", "axis_bin", "protrusion", "sharp_simplify", "reconnect_radius", "min_length", "resample_step", "voronoi_step", "selector_step", "reconnect_buffer", "shared_ratio", "min_quality", "prune_ratio", "component_min_length", "spur_max_length")

_MEDIAN = "med AS (SELECT m, m >= 12 AS rural FROM (SELECT least(w, h) AS m, row_number() OVER (ORDER BY least(w, h)) AS r, count(*) OVER () AS n FROM polys WHERE least(w, h) > 0) WHERE r = n // 2 + 1)"
_POLICY = (
    _MEDIAN
    + """, pol AS (SELECT m AS median_width, CASE WHEN rural THEN 'rural' ELSE 'urban' END AS profile,
    greatest(1.4, least(3.5, m * 0.12)) AS lane_width, greatest(1.0, least(3.0, m * 0.16)) AS pair_step, greatest(0.8, least(2.0, m * 0.10)) AS axis_bin,
    greatest(0.15, least(0.5, m * 0.02)) AS protrusion, greatest(0.1, least(0.45, m * 0.018)) AS sharp_simplify, greatest(4.0, least(14.0, m * 0.9)) AS reconnect_radius,
    greatest(1.0, least(4.0, m * 0.15)) AS min_length, greatest(0.8, least(2.5, m * 0.12)) AS resample_step, greatest(0.35, least(1.2, m * 0.08)) AS voronoi_step,
    greatest(0.4, least(2.0, m * 0.10)) AS selector_step, greatest(0.1, least(1.0, m * 0.05)) AS reconnect_buffer,
    CASE WHEN rural THEN 0.06 ELSE 0.08 END::DOUBLE AS shared_ratio, CASE WHEN rural THEN 0.48 ELSE 0.52 END::DOUBLE AS min_quality, CASE WHEN rural THEN 0.72 ELSE 0.65 END::DOUBLE AS keep_ratio,
    CASE WHEN rural THEN 1.8 ELSE 1.4 END::DOUBLE AS length_factor, CASE WHEN rural THEN 1.8 ELSE 1.3 END::DOUBLE AS prune_ratio,
    CASE WHEN rural THEN 18.0 ELSE 10.0 END::DOUBLE AS component_min_length, CASE WHEN rural THEN 3.5 ELSE 2.0 END::DOUBLE AS spur_max_length, CASE WHEN rural THEN 0.25 ELSE 0.15 END::DOUBLE AS spur_ratio,
    CASE WHEN rural THEN 0.22 ELSE 0.12 END::DOUBLE AS radius_hit, CASE WHEN rural THEN 0.30 ELSE 0.45 END::DOUBLE AS hit_ratio, CASE WHEN rural THEN 3 ELSE 4 END AS hit_count,
    CASE WHEN rural THEN 25.0 ELSE 20.0 END::DOUBLE AS reconnect_angle, CASE WHEN rural THEN 0.30 ELSE 0.35 END::DOUBLE AS smooth_alpha FROM med)"""
)
#: Policy and boxes, for other modules' oracles.
POLICY_TABLES = with_tables("polys") + ",\n" + _POLICY


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


def poly_pair_features(spark, sf_dir):
    return _rounded(pairing.pair_features(derived.polys(spark, sf_dir), box_policy(spark, sf_dir)), "i", "j")


def poly_attach_rule(spark, sf_dir):
    policy = box_policy(spark, sf_dir)
    return pairing.pair_features(derived.polys(spark, sf_dir), policy).select("i", "j", pairing.attaches(policy).alias("attach"))


_PAIRS = (
    POLICY_TABLES
    + """, p AS (SELECT *, greatest(1e-6, greatest(0.5, 0.7 * lane_width)) AS th FROM pol),
    raw AS (SELECT a.poly_id AS i, b.poly_id AS j, th, shared_ratio AS hi,
        sqrt(power(greatest(0, b.x0 - a.x0 - a.w, a.x0 - b.x0 - b.w), 2) + power(greatest(0, b.y0 - a.y0 - a.h, a.y0 - b.y0 - b.h), 2)) AS distance,
        (((a.x0 = b.x0)::INT + (a.x0 = b.x0 + b.w)::INT + (a.x0 + a.w = b.x0)::INT + (a.x0 + a.w = b.x0 + b.w)::INT) * greatest(0, least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0))
         + ((a.y0 = b.y0)::INT + (a.y0 = b.y0 + b.h)::INT + (a.y0 + a.h = b.y0)::INT + (a.y0 + a.h = b.y0 + b.h)::INT) * greatest(0, least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0)))
         / greatest(1.0, least(2 * (a.w + a.h), 2 * (b.w + b.h))) AS shared_ratio,
        CASE WHEN (a.w >= a.h) = (b.w >= b.h) THEN 1.0 ELSE 0.0 END::DOUBLE AS axis_similarity
        FROM polys a JOIN polys b ON a.poly_id < b.poly_id AND abs(a.y0 - b.y0) <= 180 AND abs(a.x0 - b.x0) <= 60, p),
    feat AS (SELECT i, j, th, hi, distance, shared_ratio, axis_similarity,
        1.2 * shared_ratio / hi + 0.9 * axis_similarity + 0.3 * greatest(0, 1 - distance / th) - CASE WHEN shared_ratio < hi / 2 AND axis_similarity < 0.55 THEN 2.0 ELSE 0.0 END AS score
        FROM raw WHERE distance <= th)"""
)


def cluster_best_feature(spark, sf_dir):
    """Clusters here are boxes 2k and 2k + 1; candidates are the boxes of other clusters."""
    boxes = derived.polys(spark, sf_dir)
    members = boxes.select(F.floor(F.col("poly_id") / 2.0).cast("long").alias("cluster"), "poly_id")
    return _rounded(pairing.best_feature(pairing.pair_features(boxes, box_policy(spark, sf_dir)), members), "cluster", "candidate", "member")


def boundary_samples(spark, sf_dir):
    return _rounded(pairing.boundary_samples(derived.polys(spark, sf_dir), box_policy(spark, sf_dir)), "poly_id", "i")


_SAMPLES = """, ring AS (SELECT poly_id, x0, y0, w, h, 2 * (w + h) AS len, greatest(8, floor(2 * (w + h) / greatest(pair_step, 0.5)))::INT AS n, axis_bin, lane_width FROM polys, pol),
    smp AS (SELECT *, i / n::DOUBLE * len AS t FROM (SELECT ring.*, unnest(range(n)) AS i FROM ring)),
    pts AS (SELECT *, x0 + CASE WHEN t <= w THEN t WHEN t <= w + h THEN w WHEN t <= 2 * w + h THEN 2 * w + h - t ELSE 0 END AS x,
        y0 + CASE WHEN t <= w THEN 0 WHEN t <= w + h THEN t - w WHEN t <= 2 * w + h THEN h ELSE 2 * w + 2 * h - t END AS y FROM smp)"""


def boundary_pair_mids(spark, sf_dir):
    return _rounded(pairing.boundary_mids(derived.polys(spark, sf_dir), box_policy(spark, sf_dir)), "poly_id", "bin")


_MIDS = (
    POLICY_TABLES
    + _SAMPLES
    + """, rel AS (SELECT *, CASE WHEN w >= h THEN x - x0 - w / 2 ELSE y - y0 - h / 2 END AS along, CASE WHEN w >= h THEN y - y0 - h / 2 ELSE -(x - x0 - w / 2) END AS across FROM pts),
    binned AS (SELECT *, round_even(along / axis_bin, 0)::BIGINT AS bin, across >= 0 AS lft FROM rel),
    far AS (SELECT poly_id, bin, any_value(axis_bin) AS axis_bin, any_value(lane_width) AS lane_width,
        arg_max({'x': x, 'y': y}, {'d': round(abs(across), 9), 'i': -i}) FILTER (lft) AS l, arg_max({'x': x, 'y': y}, {'d': round(abs(across), 9), 'i': -i}) FILTER (NOT lft) AS r FROM binned GROUP BY poly_id, bin),
    mids AS MATERIALIZED (SELECT poly_id, bin, (l.x + r.x) / 2 AS x, (l.y + r.y) / 2 AS y, sqrt(power(l.x - r.x, 2) + power(l.y - r.y, 2)) AS width, axis_bin
        FROM far WHERE l IS NOT NULL AND r IS NOT NULL AND sqrt(power(l.x - r.x, 2) + power(l.y - r.y, 2)) >= lane_width)"""
)


def mid_segments(spark, sf_dir):
    policy = box_policy(spark, sf_dir)
    rows = pairing.break_segments(pairing.boundary_mids(derived.polys(spark, sf_dir), policy), policy)
    return rows.groupBy("poly_id", "segment").agg(F.count("*").alias("points"), F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"))


def boundary_pair_lines(spark, sf_dir):
    policy = box_policy(spark, sf_dir)
    found = pairing.boundary_pair_lines(pairing.boundary_mids(derived.polys(spark, sf_dir), policy), policy)
    return found.select("poly_id", "segment", F.size("geom").alias("points"), F.round(G.line_length(F.col("geom")), 4).alias("length"))


def segmentize_rings(spark, sf_dir):
    policy = box_policy(spark, sf_dir)
    rows = derived.polys(spark, sf_dir).select("poly_id", G.box_ring(F.col("x0"), F.col("y0"), F.col("w"), F.col("h")).alias("geom"))
    points = along.densified(rows, ["poly_id"], policy.voronoi_step)
    return points.select("poly_id", "i", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_SEGMENTIZE = (
    POLICY_TABLES
    + """, side AS (SELECT poly_id, k, len, greatest(1, ceil(len / voronoi_step))::INT AS n, ax, ay, ex, ey FROM (
        SELECT poly_id, 0 AS k, w AS len, x0 AS ax, y0 AS ay, x0 + w AS ex, y0 AS ey FROM polys UNION ALL SELECT poly_id, 1, h, x0 + w, y0, x0 + w, y0 + h FROM polys
        UNION ALL SELECT poly_id, 2, w, x0 + w, y0 + h, x0, y0 + h FROM polys UNION ALL SELECT poly_id, 3, h, x0, y0 + h, x0, y0 FROM polys), pol),
    cut AS (SELECT *, unnest(range(n)) AS q FROM side),
    pts AS (SELECT poly_id, k, q, ax + q / n::DOUBLE * (ex - ax) AS x, ay + q / n::DOUBLE * (ey - ay) AS y FROM cut UNION ALL SELECT poly_id, 4, 0, x0, y0 FROM polys)
    SELECT poly_id, (row_number() OVER (PARTITION BY poly_id ORDER BY k, q) - 1)::INT AS i, round(x, 4) AS x, round(y, 4) AS y FROM pts"""
)


def ring_measures(spark, sf_dir):
    ring = G.box_ring(F.col("x0"), F.col("y0"), F.col("w"), F.col("h"))
    c = G.ring_centroid(ring)
    return derived.polys(spark, sf_dir).select("poly_id", F.round(G.line_length(ring), 4).alias("perimeter"), F.round(G.ring_area2(ring) / 2, 4).alias("area"), F.round(c["x"], 4).alias("cx"), F.round(c["y"], 4).alias("cy"))


def poly_min_width(spark, sf_dir):
    """Boxes at least a lane wide."""
    policy = box_policy(spark, sf_dir)
    return derived.polys(spark, sf_dir).select("poly_id", (F.least("w", "h") >= policy.lane_width).alias("wide_enough"))


QUERIES = {
    "width_samples": (width_samples, with_tables("polys") + " SELECT poly_id, least(w, h) AS width FROM polys"),
    "upper_median_width": (upper_median_width, with_tables("polys") + "," + _MEDIAN + " SELECT m AS median_width FROM med"),
    "policy_profile": (policy_profile, POLICY_TABLES + " SELECT profile, " + ", ".join(f"round({c}, 4) AS {c}" for c in _POLICY_COLUMNS) + " FROM pol"),
    "poly_pair_features": (poly_pair_features, _PAIRS + " SELECT i, j, round(distance, 4) AS distance, round(shared_ratio, 4) AS shared_ratio, round(axis_similarity, 4) AS axis_similarity, round(score, 4) AS score FROM feat"),
    "poly_attach_rule": (
        poly_attach_rule,
        _PAIRS
        + """ SELECT i, j, CASE WHEN shared_ratio < hi / 2 AND axis_similarity < 0.55 THEN false WHEN shared_ratio >= hi AND axis_similarity >= 0.55 THEN true
            WHEN shared_ratio >= hi / 2 AND axis_similarity >= 0.75 THEN true ELSE score >= 1.8 END AS attach FROM feat""",
    ),
    "cluster_best_feature": (
        cluster_best_feature,
        _PAIRS
        + """, both_ways AS (SELECT i AS member, j AS candidate, * FROM feat UNION ALL SELECT j, i, * FROM feat)
            SELECT cluster, candidate, member, round(distance, 4) AS distance, round(shared_ratio, 4) AS shared_ratio, round(axis_similarity, 4) AS axis_similarity, round(score, 4) AS score FROM (
            SELECT *, member // 2 AS cluster, row_number() OVER (PARTITION BY member // 2, candidate ORDER BY score DESC, member) AS r FROM both_ways WHERE member // 2 <> candidate // 2) WHERE r = 1""",
    ),
    "boundary_samples": (boundary_samples, POLICY_TABLES + _SAMPLES + " SELECT poly_id, i::INT AS i, round(x, 4) AS x, round(y, 4) AS y FROM pts"),
    "boundary_pair_mids": (boundary_pair_mids, _MIDS + " SELECT poly_id, bin, round(x, 4) AS x, round(y, 4) AS y, round(width, 4) AS width FROM mids"),
    "mid_segments": (
        mid_segments,
        _MIDS
        + """, g AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) > axis_bin * 3.0, false)::INT AS s FROM mids WINDOW w AS (PARTITION BY poly_id ORDER BY bin)),
            c AS (SELECT *, sum(s) OVER (PARTITION BY poly_id ORDER BY bin)::BIGINT AS segment FROM g)
            SELECT poly_id, segment, count(*) AS points, min(bin) AS first_bin, max(bin) AS last_bin FROM c GROUP BY ALL""",
    ),
    "boundary_pair_lines": (
        boundary_pair_lines,
        _MIDS.replace("WITH", "WITH RECURSIVE", 1)
        + """, ord AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY poly_id ORDER BY bin) AS k, count(*) OVER (PARTITION BY poly_id) AS most FROM mids),
            walk(poly_id, k, segment, points, x, y, step) AS (SELECT poly_id, k, 0::BIGINT, 1::BIGINT, x, y, 0.0::DOUBLE FROM ord WHERE k = 1
                UNION ALL SELECT poly_id, k, CASE WHEN closes THEN segment + 1 ELSE segment END, CASE WHEN closes THEN 1 ELSE points + 1 END, x, y, CASE WHEN closes THEN 0 ELSE gap END FROM (
                    SELECT ord.poly_id, ord.k, segment, points, ord.x, ord.y, sqrt(power(ord.x - walk.x, 2) + power(ord.y - walk.y, 2)) AS gap,
                        points >= 2 AND sqrt(power(ord.x - walk.x, 2) + power(ord.y - walk.y, 2)) > axis_bin * 3.0 AS closes FROM walk JOIN ord ON ord.poly_id = walk.poly_id AND ord.k = walk.k + 1))
            SELECT poly_id, segment::INT AS segment, count(*)::INT AS points, round(sum(step), 4) AS length FROM walk GROUP BY poly_id, segment HAVING count(*) >= 2""",
    ),
    "segmentize_rings": (segmentize_rings, _SEGMENTIZE),
    "ring_measures": (ring_measures, with_tables("polys") + " SELECT poly_id, round(2 * (w + h), 4) AS perimeter, round(w * h, 4) AS area, round(x0 + w / 2, 4) AS cx, round(y0 + h / 2, 4) AS cy FROM polys"),
    "poly_min_width": (poly_min_width, POLICY_TABLES + " SELECT poly_id, least(w, h) >= lane_width AS wide_enough FROM polys, pol"),
}
