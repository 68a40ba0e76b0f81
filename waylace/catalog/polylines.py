"""Queries on polylines: measures, scores, selection, smoothing, snapping and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylace.catalog.polygons import POLICY_TABLES, box_policy
from waylace.functions import along
from waylace.functions import geometry as G
from waylace.operators import selection
from waylace.sources import derived
from waylace.sources.derived import ORACLE, with_tables

_LINE = with_tables("vertices")
_POLICY_LINE = POLICY_TABLES + ",\n" + ORACLE["vertices"]
_SEGS = """, seg AS (SELECT *, sqrt(power(bx - x, 2) + power(by_ - y, 2)) AS len FROM (SELECT line_id, seq, x, y, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM vertices WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE bx IS NOT NULL)"""
_MEASURED = _SEGS + """, run AS (SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY seq) AS after, count(*) OVER (PARTITION BY line_id) + 1 AS points FROM seg),
    mea AS (SELECT *, coalesce(lag(after) OVER w, 0) AS before, max(after) OVER (PARTITION BY line_id) AS total FROM run WINDOW w AS (PARTITION BY line_id ORDER BY seq))"""


def _points(df, *keys):
    return df.select(*keys, F.posexplode("geom").alias("i", "p")).select(*keys, (F.col("i") + 1).alias("seq"), F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


def line_length(spark, sf_dir):
    return derived.lines(spark, sf_dir).select("line_id", F.round(G.line_length(F.col("geom")), 4).alias("length"))


def line_curvature(spark, sf_dir):
    return derived.lines(spark, sf_dir).select("line_id", F.round(G.curvature_penalty(F.col("geom")), 4).alias("curvature"))


_TURNS = """, t AS (SELECT line_id, acos(greatest(-1, least(1, ((x - px) * (nx - x) + (y - py) * (ny - y)) / (sqrt(power(x - px, 2) + power(y - py, 2)) * sqrt(power(nx - x, 2) + power(ny - y, 2)))))) AS turn FROM (
    SELECT line_id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM vertices WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE px IS NOT NULL AND nx IS NOT NULL),
    cur AS (SELECT line_id, greatest(0, least(1, coalesce(sum(turn) / (pi() * count(turn)), 0))) AS curvature FROM (SELECT DISTINCT line_id FROM vertices) LEFT JOIN t USING (line_id) GROUP BY line_id)"""


def line_length_score(spark, sf_dir):
    policy = box_policy(spark, sf_dir)
    return derived.lines(spark, sf_dir).select("line_id", F.round(selection.length_score(G.line_length(F.col("geom")), policy), 4).alias("length_score"))


def line_inside_ratio(spark, sf_dir):
    rows = selection.inside_ratio(_spread(spark, sf_dir), derived.polys(spark, sf_dir), box_policy(spark, sf_dir))
    return rows.select("line_id", F.round("inside_ratio", 4).alias("inside_ratio"))


def _spread(spark, sf_dir):
    """Lines moved over the boxes: five metres a step, and one row of boxes for each line."""
    rows = derived.lines(spark, sf_dir)
    up = (F.col("line_id") % 50) * 90.0
    return rows.withColumn("geom", F.transform("geom", lambda p: G.point(p["x"] * 5.0, p["y"] + up)))


_SPREAD = """, spread AS (SELECT line_id, seq, x * 5.0 AS x, y + (line_id % 50) * 90.0 AS y FROM vertices)"""
_SAMPLED = (
    _SPREAD
    + _MEASURED.replace("FROM vertices", "FROM spread")
    + """, cnt AS (SELECT DISTINCT line_id, total, greatest(3, ceil(total / greatest(selector_step, 0.1))::INT + 1) AS n FROM mea, pol),
    want AS (SELECT *, i / (n - 1)::DOUBLE * total AS t FROM (SELECT cnt.*, unnest(range(n)) AS i FROM cnt)),
    smp AS (SELECT line_id, n, i, x + greatest(0, least(1, coalesce((t - before) / nullif(len, 0), 0))) * (bx - x) AS px, y + greatest(0, least(1, coalesce((t - before) / nullif(len, 0), 0))) * (by_ - y) AS py FROM (
        SELECT * FROM want JOIN mea USING (line_id, total) WHERE before < t AND t <= after OR t = 0 AND seq = 1 OR i = n - 1 AND seq = points - 1 AND t > after)),
    ins AS (SELECT line_id, count(DISTINCT CASE WHEN poly_id IS NOT NULL THEN i END) / max(n)::DOUBLE AS inside_ratio FROM smp LEFT JOIN polys ON px BETWEEN x0 AND x0 + w AND py BETWEEN y0 AND y0 + h GROUP BY line_id)"""
)


def line_quality(spark, sf_dir):
    rows = selection.quality(_spread(spark, sf_dir), derived.polys(spark, sf_dir), box_policy(spark, sf_dir))
    return rows.select("line_id", *[F.round(c, 4).alias(c) for c in ("inside_ratio", "curvature", "length_score", "score")])


_QUALITY = (
    _POLICY_LINE
    + _SAMPLED
    + _TURNS.replace("FROM vertices", "FROM spread")
    + """, qual AS (SELECT line_id, inside_ratio, curvature, ls AS length_score, greatest(0, least(1, 0.55 * inside_ratio + 0.25 * (1 - curvature) + 0.20 * ls)) AS score FROM (
        SELECT ins.line_id, inside_ratio, curvature, greatest(0, least(1, total / greatest(lane_width * length_factor, min_length))) AS ls FROM ins JOIN cur USING (line_id) JOIN cnt USING (line_id), pol))"""
)


def candidate_select(spark, sf_dir):
    """Passing lines, or the best share where none passes, in ten groups of lines."""
    policy = box_policy(spark, sf_dir)
    scored = selection.quality(_spread(spark, sf_dir), derived.polys(spark, sf_dir), policy).withColumn("grp", F.col("line_id") % 10)
    return selection.select_candidates(scored, policy, "grp").select("grp", "line_id", F.round("score", 4).alias("score"))


def candidate_top_ratio(spark, sf_dir):
    """The fallback alone: a score that nothing passes."""
    policy = box_policy(spark, sf_dir)
    scored = derived.lines(spark, sf_dir).select("line_id", (F.col("line_id") % 10).alias("grp"), F.round(0.4 * G.curvature_penalty(F.col("geom")), 6).alias("score"))
    return selection.select_candidates(scored, policy, "grp").select("grp", "line_id", F.round("score", 4).alias("score"))


def candidate_concat(spark, sf_dir):
    """Both candidate sources in one table, with where they came from."""
    lines = derived.lines(spark, sf_dir).select("line_id", G.line_length(F.col("geom")).alias("length"))
    boxes = derived.polys(spark, sf_dir).select(F.col("poly_id").alias("line_id"), F.greatest("w", "h").alias("length"))
    both = lines.withColumn("origin", F.lit("voronoi")).unionByName(boxes.withColumn("origin", F.lit("boundary_pair")))
    return both.groupBy("origin").agg(F.count("*").alias("n"), F.round(F.sum("length"), 2).alias("length"))


def snap_dedupe(spark, sf_dir):
    """Coordinates rounded to whole units, then rounded to millimetres without consecutive repeats."""
    coarse = F.transform("geom", lambda p: G.point(F.floor(p["x"] / 4.0) * 4.0, F.floor(p["y"] / 16.0) * 16.0))
    rows = derived.lines(spark, sf_dir).select("line_id", G.round_line(coarse).alias("geom"))
    return _points(rows, "line_id")


def moving_average(spark, sf_dir):
    rows = derived.lines(spark, sf_dir).select("line_id", F.posexplode(G.moving_average(F.col("geom"))).alias("i", "p"))
    return rows.select("line_id", (F.col("i") + 1).alias("seq"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def resample_line(spark, sf_dir):
    policy = box_policy(spark, sf_dir)
    step = max(policy.resample_floor, policy.resample_step)
    n = F.greatest(F.lit(2), F.floor(F.col("total") / step).cast("int") + 1)
    rows = along.evenly_spaced(derived.lines(spark, sf_dir), ["line_id"], n)
    return rows.select("line_id", (F.col("i") + 1).alias("seq"), F.round("px", 4).alias("x"), F.round("py", 4).alias("y"))


def interpolate_mid(spark, sf_dir):
    rows = along.point_at_share(derived.lines(spark, sf_dir), ["line_id"], 0.5)
    return rows.select("line_id", F.round("px", 4).alias("x"), F.round("py", 4).alias("y"))


_LERP = "round(x + coalesce((t - before) / nullif(len, 0), 0) * (bx - x), 4) AS x, round(y + coalesce((t - before) / nullif(len, 0), 0) * (by_ - y), 4) AS y"


def translate_line(spark, sf_dir):
    policy = box_policy(spark, sf_dir)
    first, last = F.get("geom", F.lit(0)), F.element_at("geom", -1)
    nx, ny = G.left_normal(last["x"] - first["x"], last["y"] - first["y"])
    by = policy.parallel_offset_factor * policy.lane_width
    return _points(derived.lines(spark, sf_dir).select("line_id", G.translate(F.col("geom"), nx * by, ny * by).alias("geom")), "line_id")


def merge_lines(spark, sf_dir):
    """Each line cut after its tenth vertex, and both parts joined again after the second is reversed."""
    head, tail = F.slice("geom", 1, 10), F.reverse(F.slice("geom", 10, F.greatest(F.size("geom") - 9, F.lit(1))))
    rows = derived.lines(spark, sf_dir).where(F.size("geom") > 10).select("line_id", G.merge_lines(head, tail).alias("geom"))
    return rows.select("line_id", F.size("geom").alias("points"), F.round(G.line_length(F.col("geom")), 4).alias("length"))


def wide_enough_lines(spark, sf_dir):
    """Lines whose middle is in no box that is narrower than a lane there."""
    rows = selection.wide_enough(_spread(spark, sf_dir), derived.polys(spark, sf_dir), box_policy(spark, sf_dir))
    return rows.select("line_id")


def min_length_filter(spark, sf_dir):
    policy = box_policy(spark, sf_dir)
    cut = derived.lines(spark, sf_dir).select("line_id", F.slice("geom", 1, F.greatest(F.lit(1), (F.col("line_id") % 5).cast("int"))).alias("geom"))
    return cut.withColumn("length", G.line_length(F.col("geom"))).where(F.col("length") >= policy.min_length).select("line_id", F.round("length", 4).alias("length"))


def smooth_short_lines(spark, sf_dir):
    """What the moving average leaves of each line's first vertices: lines of up to three collapse to a point."""
    cut = derived.lines(spark, sf_dir).select("line_id", F.slice("geom", 1, (F.col("line_id") % 6).cast("int") + 2).alias("geom"))
    return cut.select("line_id", F.size("geom").alias("points"), F.round(G.line_length(G.moving_average(F.col("geom"))), 4).alias("length"))


def _typed(spark, sf_dir):
    """Lines, multi-part lines and others; some without geometry."""
    line = F.when(F.col("line_id") % 11 == 0, None).when(F.col("line_id") % 13 == 0, F.array().cast(G.LINE)).otherwise(F.col("geom"))
    kind = F.element_at(F.array(F.lit("LineString"), F.lit("MultiLineString"), F.lit("Polygon")), (F.col("line_id") % 3 + 1).cast("int"))
    return derived.lines(spark, sf_dir).select("line_id", kind.alias("kind"), line.alias("geom"))


_TYPED = """, typed AS (SELECT line_id, CASE line_id % 3 WHEN 0 THEN 'LineString' WHEN 1 THEN 'MultiLineString' ELSE 'Polygon' END AS kind, line_id % 11 = 0 OR line_id % 13 = 0 AS missing, max(seq) AS points FROM vertices GROUP BY line_id)"""


def scan_filter_nonempty(spark, sf_dir):
    return _typed(spark, sf_dir).where("geom is not null and size(geom) > 0").groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.size("geom").cast("long")).alias("points"))


def line_flatten(spark, sf_dir):
    """Multi-part lines in parts (here two halves), single lines as they are, others dropped."""
    rows = _typed(spark, sf_dir).where("geom is not null and size(geom) > 0")
    half = F.greatest(F.lit(1), F.floor(F.size("geom") / 2).cast("int"))
    parts = F.when(F.col("kind") == "LineString", F.array("geom")).when(F.col("kind") == "MultiLineString", F.array(F.slice("geom", 1, half), F.slice("geom", half + 1, F.size("geom"))))
    return rows.select("line_id", F.posexplode(parts).alias("part", "geom")).where(F.size("geom") > 0).select("line_id", "part", F.size("geom").alias("points"))


def type_diff(spark, sf_dir):
    """Geometry types that a line table may not hold."""
    present = _typed(spark, sf_dir).where("geom is not null").select("kind").distinct()
    allowed = spark.createDataFrame([("LineString",), ("MultiLineString",)], "kind string")
    return present.join(allowed, "kind", "left_anti")


def drop_debug_columns(spark, sf_dir):
    """Columns that begin with is_ or terminal_ go."""
    df = derived.polys(spark, sf_dir).withColumns({"is_wide": F.col("w") > 20, "terminal_x": F.col("x0")})
    return df.drop(*[c for c in df.columns if c.startswith(("is_", "terminal_"))])


def geometry_only(spark, sf_dir):
    return derived.lines(spark, sf_dir).select("geom").select(F.size("geom").alias("points"))


def meter_unit(spark, sf_dir):
    """Whether a coordinate system's text names the metre as its unit."""
    unit = F.element_at(F.array(F.lit('UNIT["metre",1]'), F.lit('UNIT["Meter",1.0]'), F.lit('UNIT["foot",0.3048]'), F.lit("UNIT[metre,1]"), F.lit('UNIT["degree",0.0174]')), (F.col("n_nationkey") % 5 + 1).cast("int"))
    wkt = F.lower(F.concat(F.lit('PROJCS["'), F.col("n_name"), F.lit('",'), unit, F.lit("]")))
    return derived.table(spark, sf_dir, "nation").select("n_nationkey", is_metre(wkt).alias("is_metre"))


def is_metre(wkt):
    """The test on lower-cased text; an ellipsoid's LENGTHUNIT passes too."""
    return wkt.contains('unit["metre"') | wkt.contains('unit["meter"') | wkt.contains("unit[metre") | wkt.contains("unit[meter")


QUERIES = {
    "line_length": (line_length, _LINE + _SEGS + " SELECT line_id, round(sum(len), 4) AS length FROM (SELECT line_id, len FROM seg UNION ALL SELECT DISTINCT line_id, 0 FROM vertices) GROUP BY line_id"),
    "line_curvature": (line_curvature, _LINE + _TURNS + " SELECT line_id, round(curvature, 4) AS curvature FROM cur"),
    "line_length_score": (line_length_score, _POLICY_LINE + _SEGS + " SELECT line_id, round(greatest(0, least(1, sum(len) / max(greatest(lane_width * length_factor, min_length)))), 4) AS length_score FROM seg, pol GROUP BY line_id"),
    "line_inside_ratio": (line_inside_ratio, _POLICY_LINE + _SAMPLED + " SELECT line_id, round(inside_ratio, 4) AS inside_ratio FROM ins"),
    "line_quality": (line_quality, _QUALITY + " SELECT line_id, round(inside_ratio, 4) AS inside_ratio, round(curvature, 4) AS curvature, round(length_score, 4) AS length_score, round(score, 4) AS score FROM qual"),
    "candidate_select": (
        candidate_select,
        _QUALITY
        + """, g AS (SELECT line_id % 10 AS grp, line_id, score, sum((score >= min_quality)::INT) OVER (PARTITION BY line_id % 10) AS passing, count(*) OVER (PARTITION BY line_id % 10) AS n,
            row_number() OVER (PARTITION BY line_id % 10 ORDER BY score DESC, line_id) AS r, min_quality, keep_ratio FROM qual, pol)
            SELECT grp, line_id, round(score, 4) AS score FROM g WHERE score >= min_quality OR passing = 0 AND r <= greatest(1, ceil(n * keep_ratio))""",
    ),
    "candidate_top_ratio": (
        candidate_top_ratio,
        _POLICY_LINE
        + _TURNS
        + """, s AS (SELECT line_id % 10 AS grp, line_id, round(0.4 * curvature, 6) AS score FROM cur), g AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY score DESC, line_id) AS r FROM s)
            SELECT grp, line_id, round(score, 4) AS score FROM g, pol WHERE r <= greatest(1, ceil(n * keep_ratio))""",
    ),
    "candidate_concat": (
        candidate_concat,
        with_tables("polys", "vertices")
        + _SEGS
        + " SELECT 'voronoi' AS origin, count(DISTINCT line_id) AS n, round(sum(len), 2) AS length FROM seg UNION ALL SELECT 'boundary_pair', count(*), round(sum(greatest(w, h)), 2) FROM polys",
    ),
    "snap_dedupe": (
        snap_dedupe,
        _LINE
        + """, c AS (SELECT line_id, seq, floor(x / 4.0) * 4.0 AS x, floor(y / 16.0) * 16.0 AS y FROM vertices),
            k AS (SELECT * FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM c WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE px IS NULL OR px <> x OR py <> y)
            SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY seq)::INT AS seq, round(x, 4) AS x, round(y, 4) AS y FROM k""",
    ),
    "moving_average": (moving_average, _LINE + " SELECT line_id, seq::INT AS seq, round(avg(x) OVER w, 6) AS x, round(avg(y) OVER w, 6) AS y FROM vertices WINDOW w AS (PARTITION BY line_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "resample_line": (
        resample_line,
        _POLICY_LINE
        + _MEASURED
        + f""", cnt AS (SELECT DISTINCT line_id, total, greatest(2, floor(total / greatest(0.4, resample_step))::INT + 1) AS n FROM mea, pol),
            want AS (SELECT *, i / (n - 1)::DOUBLE * total AS t FROM (SELECT cnt.*, unnest(range(n)) AS i FROM cnt)),
            hit AS (SELECT * FROM want JOIN mea USING (line_id, total) WHERE before < t AND t <= after OR t = 0 AND seq = 1 OR i = n - 1 AND seq = points - 1 AND t > after)
            SELECT line_id, (i + 1)::INT AS seq, {_LERP} FROM hit""",
    ),
    "interpolate_mid": (interpolate_mid, _LINE + _MEASURED + f", hit AS (SELECT *, total / 2 AS t, row_number() OVER (PARTITION BY line_id ORDER BY seq) AS r FROM mea WHERE after >= total / 2) SELECT line_id, {_LERP} FROM hit WHERE r = 1"),
    "translate_line": (
        translate_line,
        _POLICY_LINE
        + """, e AS (SELECT line_id, max_by(x, seq) - min_by(x, seq) AS dx, max_by(y, seq) - min_by(y, seq) AS dy FROM vertices GROUP BY line_id)
            SELECT line_id, seq::INT AS seq, round(x - coalesce(dy / nullif(sqrt(dx * dx + dy * dy), 0), 0) * 0.2 * lane_width, 4) AS x, round(y + coalesce(dx / nullif(sqrt(dx * dx + dy * dy), 0), 0) * 0.2 * lane_width, 4) AS y FROM vertices JOIN e USING (line_id), pol""",
    ),
    "merge_lines": (merge_lines, _LINE + _SEGS + ", n AS (SELECT line_id, max(seq)::INT AS points FROM vertices GROUP BY line_id) SELECT line_id, points, round(sum(len), 4) AS length FROM seg JOIN n USING (line_id) WHERE points > 10 GROUP BY line_id, points"),
    "wide_enough_lines": (
        wide_enough_lines,
        _POLICY_LINE
        + _SPREAD
        + _MEASURED.replace("FROM vertices", "FROM spread")
        + """, hit AS (SELECT *, total / 2 AS t, row_number() OVER (PARTITION BY line_id ORDER BY seq) AS r FROM mea WHERE after >= total / 2),
            mid AS (SELECT line_id, x + (t - before) / len * (bx - x) AS px, y + (t - before) / len * (by_ - y) AS py FROM hit WHERE r = 1),
            wid AS (SELECT line_id, min(2 * least(px - x0, x0 + w - px, py - y0, y0 + h - py)) AS width FROM mid LEFT JOIN polys ON px > x0 AND px < x0 + w AND py > y0 AND py < y0 + h GROUP BY line_id)
            SELECT line_id FROM wid, pol WHERE width IS NULL OR width >= lane_width""",
    ),
    "min_length_filter": (min_length_filter, _POLICY_LINE + _SEGS + " SELECT line_id, round(sum(len), 4) AS length FROM seg, pol WHERE seq < greatest(1, line_id % 5) GROUP BY line_id HAVING sum(len) >= max(min_length)"),
    "smooth_short_lines": (
        smooth_short_lines,
        _LINE
        + """, c AS (SELECT * FROM vertices WHERE seq <= line_id % 6 + 2), a AS (SELECT line_id, seq, avg(x) OVER w AS x, avg(y) OVER w AS y FROM c WINDOW w AS (PARTITION BY line_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
            s AS (SELECT line_id, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS len FROM a WINDOW w AS (PARTITION BY line_id ORDER BY seq))
            SELECT line_id, count(*)::INT AS points, round(coalesce(sum(len), 0), 4) AS length FROM s GROUP BY line_id""",
    ),
    "scan_filter_nonempty": (scan_filter_nonempty, _LINE + _TYPED + " SELECT kind, count(*) AS n, sum(points)::BIGINT AS points FROM typed WHERE NOT missing GROUP BY kind"),
    "line_flatten": (
        line_flatten,
        _LINE
        + _TYPED
        + """, ok AS (SELECT * FROM typed WHERE NOT missing) SELECT * FROM (SELECT line_id, 0 AS part, points::INT AS points FROM ok WHERE kind = 'LineString'
            UNION ALL SELECT line_id, 0, greatest(1, points // 2)::INT FROM ok WHERE kind = 'MultiLineString' UNION ALL SELECT line_id, 1, (points - greatest(1, points // 2))::INT FROM ok WHERE kind = 'MultiLineString') WHERE points > 0""",
    ),
    "type_diff": (type_diff, _LINE + _TYPED + " SELECT DISTINCT kind FROM typed WHERE line_id % 11 <> 0 AND kind NOT IN ('LineString', 'MultiLineString')"),
    "drop_debug_columns": (drop_debug_columns, with_tables("polys") + " SELECT poly_id, x0, y0, w, h FROM polys"),
    "geometry_only": (geometry_only, _LINE + " SELECT max(seq)::INT AS points FROM vertices GROUP BY line_id"),
    "meter_unit": (meter_unit, "SELECT n_nationkey, n_nationkey % 5 IN (0, 1, 3) AS is_metre FROM nation"),
}
