"""Queries on kernels: rectangles, unions, clusters, skeletons, opening, simplification, contraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylace.catalog.network import _ANGLE, _BOX_NEAR, _CONTRACT_ROUNDS, _POLICY_NET, _SEG_DIST, CONTRACTED, _distance_sql, _with_course
from waylace.catalog.polygons import _PAIRS, POLICY_TABLES, box_policy
from waylace.catalog.reports import _SHARED
from waylace.functions import geometry as G
from waylace.functions import graphs, kernels, offsets
from waylace.operators import dissolve, edits
from waylace.sources import derived
from waylace.sources.derived import with_tables


def rings(spark, sf_dir):
    """The boxes as closed rings."""
    return derived.polys(spark, sf_dir).select("poly_id", G.box_ring(F.col("x0"), F.col("y0"), F.col("w"), F.col("h")).alias("ring"))


def mrr_width(spark, sf_dir):
    rows = kernels.with_rectangle(rings(spark, sf_dir))
    return rows.select("poly_id", F.round("rect.width", 4).alias("width"), F.round("rect.length", 4).alias("length"))


def long_axis(spark, sf_dir):
    """Whether a box's long axis runs along x."""
    rows = kernels.with_rectangle(rings(spark, sf_dir))
    return rows.select("poly_id", F.round(F.abs("rect.ax"), 4).alias("along_x"))


def polygon_union(spark, sf_dir):
    """Length of the dissolved boundary."""
    pieces = dissolve.union_boundary(rings(spark, sf_dir))
    return pieces.agg(F.round(F.sum(G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))), 4).alias("perimeter"))


def polygon_clusters(spark, sf_dir):
    return dissolve.polygon_clusters(derived.polys(spark, sf_dir), box_policy(spark, sf_dir))


def voronoi_skeleton(spark, sf_dir):
    """Skeleton edges of each box and their length."""
    policy = box_policy(spark, sf_dir)
    rows = kernels.skeleton_lines(rings(spark, sf_dir), policy.voronoi_step, policy.lane_width)
    a, b = F.col("geom")[0], F.col("geom")[1]  # parts are two-point lines
    lengths = rows.select("poly_id", F.explode("parts").alias("geom")).select("poly_id", G.distance(a["x"], a["y"], b["x"], b["y"]).alias("length"))
    return lengths.groupBy("poly_id").agg(F.count("*").alias("parts"), F.round(F.sum("length"), 3).alias("length"))


def opening(spark, sf_dir):
    """Boxes left by opening with four metres, and their area."""
    rows = offsets.with_opened(rings(spark, sf_dir), 4.0, "ring").select("poly_id", F.explode("parts").alias("ring"))
    return rows.select("poly_id", F.round(G.ring_area2(F.col("ring")) / 2, 3).alias("area"))


def stable_boxes(spark, sf_dir):
    """Boxes that are wide enough once they are opened and simplified as the policy asks, and their area before."""
    policy = box_policy(spark, sf_dir)
    rows = offsets.with_stable(rings(spark, sf_dir), 2 * policy.lane_width, policy.sharp_simplify, 4 * policy.lane_width, "ring").where("size(parts) > 0")
    return rows.select("poly_id", F.round(G.ring_area2(F.col("ring")) / 2, 3).alias("area"))


def simplify_lines(spark, sf_dir):
    rows = derived.lines(spark, sf_dir).withColumn("tolerance", F.lit(2.0))
    done = kernels.with_simplified(rows)
    return done.select("line_id", F.size("geom").alias("points"), F.round(G.line_length(F.col("geom")), 4).alias("length"))


def parallel_split(spark, sf_dir):
    """Which edges the split moves."""
    e = _with_course(derived.edges(spark, sf_dir))
    moved = edits.split_parallels(e, box_policy(spark, sf_dir)).select("edge_id", F.element_at("geom", 1).alias("p"), "ux", "uy")
    return moved.select("edge_id", ((F.col("p.x") != F.col("ux")) | (F.col("p.y") != F.col("uy"))).alias("moved"))


def bridge_contract(spark, sf_dir):
    rows = edits.contract_bridges(derived.edges(spark, sf_dir, 0.5))
    return rows.select("edge_id", "u", "v", F.round("weight", 4).alias("weight"))


def contracted_degrees(spark, sf_dir):
    rows = graphs.node_degree(edits.contract_bridges(derived.edges(spark, sf_dir, 0.5)))
    return rows.groupBy("degree").agg(F.count("*").alias("nodes"))


QUERIES = {
    "mrr_width": (mrr_width, with_tables("polys") + " SELECT poly_id, round(least(w, h), 4) AS width, round(greatest(w, h), 4) AS length FROM polys"),
    "long_axis": (long_axis, with_tables("polys") + " SELECT poly_id, CASE WHEN w >= h THEN 1.0 ELSE 0.0 END::DOUBLE AS along_x FROM polys"),
    "polygon_union": (polygon_union, with_tables("polys") + _SHARED + " SELECT round(perimeter, 4) AS perimeter FROM per"),
    "polygon_clusters": (
        polygon_clusters,
        _PAIRS.replace("WITH", "WITH RECURSIVE", 1)
        + """, att AS (SELECT i, j FROM feat WHERE CASE WHEN shared_ratio < hi / 2 AND axis_similarity < 0.55 THEN false WHEN shared_ratio >= hi AND axis_similarity >= 0.55 THEN true WHEN shared_ratio >= hi / 2 AND axis_similarity >= 0.75 THEN true ELSE score >= 1.8 END),
            both_ways AS (SELECT i AS a, j AS b FROM att UNION ALL SELECT j, i FROM att),
            reach(n, c) AS (SELECT poly_id, poly_id FROM polys UNION SELECT b, least(c, b) FROM reach JOIN both_ways ON a = n WHERE c < b)
            SELECT n AS poly_id, min(c) AS "cluster" FROM reach GROUP BY n""",
    ),
    "voronoi_skeleton": (voronoi_skeleton, None),
    "opening": (
        opening,
        with_tables("polys") + " SELECT poly_id, round((w - 8) * (h - 8) + 8 * (w - 8 + h - 8) + 32 * 16 * sin(pi() / 32), 3) AS area FROM polys WHERE least(w, h) > 8",
    ),
    "stable_boxes": (stable_boxes, POLICY_TABLES + " SELECT poly_id, round(w * h, 3) AS area FROM polys, pol WHERE least(w, h) > 4 * lane_width"),
    "simplify_lines": (
        simplify_lines,
        with_tables("vertices").replace("WITH", "WITH RECURSIVE", 1)
        + f""", ends AS (SELECT line_id, max(seq) AS n FROM vertices GROUP BY line_id),
            part(line_id, i, j) AS (SELECT line_id, 1, n FROM ends UNION ALL SELECT line_id, unnest([i, k]), unnest([k, j]) FROM (
                SELECT part.line_id, i, j, arg_max(p.seq, {{'gap': {_distance_sql("p.x", "p.y", "a.x", "a.y", "b.x", "b.y")}, 'first': -p.seq}}) AS k, max({_distance_sql("p.x", "p.y", "a.x", "a.y", "b.x", "b.y")}) AS gap
                FROM part JOIN vertices a ON a.line_id = part.line_id AND a.seq = i JOIN vertices b ON b.line_id = part.line_id AND b.seq = j JOIN vertices p ON p.line_id = part.line_id AND p.seq > i AND p.seq < j
                GROUP BY part.line_id, i, j) WHERE gap > 2.0),
            kept AS (SELECT DISTINCT line_id, seq FROM (SELECT line_id, i AS seq FROM part UNION ALL SELECT line_id, j FROM part)),
            course AS (SELECT line_id, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step FROM kept JOIN vertices USING (line_id, seq) WINDOW w AS (PARTITION BY line_id ORDER BY seq))
            SELECT line_id, count(*)::INT AS points, round(coalesce(sum(step), 0), 4) AS length FROM course GROUP BY line_id""",
    ),
    "parallel_split": (
        parallel_split,
        _POLICY_NET
        + f""", pr AS (SELECT b.edge_id AS j, {_SEG_DIST} AS distance, {_ANGLE} AS angle FROM edges a JOIN edges b ON a.edge_id < b.edge_id AND {_BOX_NEAR.format(3)}),
            gone AS (SELECT DISTINCT j FROM pr, pol WHERE distance <= lane_width * 0.8 AND angle <= 12) SELECT edge_id, edge_id IN (SELECT j FROM gone) AS moved FROM edges""",
    ),
    "bridge_contract": (bridge_contract, CONTRACTED + f" SELECT edge_id, u, v, round(weight, 4) AS weight FROM edges_{_CONTRACT_ROUNDS}, settled WHERE yes = 'true'"),
    "contracted_degrees": (
        contracted_degrees,
        CONTRACTED + f" SELECT d AS degree, count(*) AS nodes FROM (SELECT n, count(*) AS d FROM (SELECT u AS n FROM edges_{_CONTRACT_ROUNDS} UNION ALL SELECT v FROM edges_{_CONTRACT_ROUNDS}) GROUP BY n), settled WHERE yes = 'true' GROUP BY d",
    ),
}
