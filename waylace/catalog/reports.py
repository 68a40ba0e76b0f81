"""Queries of quality: summaries, diagnostics, validation and evaluation gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylace.catalog.network import _ADJ, _BOX_NEAR, _COMPONENT, _NET, _REC, _SEG_DIST, _ANGLE
from waylace.operators import quality_gates as Q
from waylace.sources import derived
from waylace.sources.derived import with_tables

_ALL = with_tables("polys", "net", "edges", "degree")
_ALL_REC = _ALL.replace("WITH", "WITH RECURSIVE", 1)
_DIAG = """, smp AS (SELECT edge_id, ux + i / 4.0::DOUBLE * (vx - ux) AS x, uy + i / 4.0::DOUBLE * (vy - uy) AS y FROM (SELECT *, unnest(range(5)) AS i FROM edges)),
    bd AS (SELECT edge_id, min(CASE WHEN least(x - x0, x0 + w - x, y - y0, y0 + h - y) >= 0 THEN least(x - x0, x0 + w - x, y - y0, y0 + h - y)
        ELSE sqrt(power(greatest(x0 - x, 0, x - x0 - w), 2) + power(greatest(y0 - y, 0, y - y0 - h), 2)) END) AS min_bd_m FROM smp, polys GROUP BY edge_id),
    diag AS (SELECT edge_id, weight AS length_m, min_bd_m, a.d AS deg_u, b.d AS deg_v, least(a.d, b.d) = 1 AS is_leaf_edge, greatest(a.d, b.d) <= 2 AS is_chain_edge FROM edges JOIN bd USING (edge_id) JOIN degree a ON a.n = u JOIN degree b ON b.n = v)"""


def _edges(spark, sf_dir):
    return derived.edges(spark, sf_dir)


def _diagnostics(spark, sf_dir):
    return Q.edge_diagnostics(_edges(spark, sf_dir), derived.polys(spark, sf_dir))


def graph_summary(spark, sf_dir):
    return Q.graph_summary(_edges(spark, sf_dir))


def edge_length_describe(spark, sf_dir):
    row = Q.describe(_edges(spark, sf_dir), "weight")
    return row.select("n", *[F.round(c, 4).alias(c) for c in row.columns if c != "n"])


def edge_boundary_diag(spark, sf_dir):
    rows = _diagnostics(spark, sf_dir)
    return rows.withColumns({"length_m": F.round("length_m", 4), "min_bd_m": F.round("min_bd_m", 4)})


def boundary_counts(spark, sf_dir):
    return Q.near_counts(_diagnostics(spark, sf_dir))


def boundary_describe(spark, sf_dir):
    row = Q.describe(_diagnostics(spark, sf_dir), "min_bd_m")
    return row.select("n", *[F.round(c, 4).alias(c) for c in row.columns if c != "n"])


def risk_top20(spark, sf_dir):
    rows = Q.risk_report(_diagnostics(spark, sf_dir))
    return rows.select("edge_id", F.round("length_m", 4).alias("length_m"), F.round("min_bd_m", 4).alias("min_bd_m"), "is_leaf_edge", "is_chain_edge")


def component_sizes(spark, sf_dir):
    return Q.component_sizes(_edges(spark, sf_dir))


def connectivity_check(spark, sf_dir):
    return Q.connectivity(_edges(spark, sf_dir))


def terminal_touch(spark, sf_dir):
    rows = Q.open_terminals(_edges(spark, sf_dir), derived.polys(spark, sf_dir))
    return rows.select("n", F.round("dist", 4).alias("dist"))


def terminal_errors(spark, sf_dir):
    """The first three terminal errors by node."""
    rows = Q.first_errors(Q.open_terminals(_edges(spark, sf_dir), derived.polys(spark, sf_dir)), ["n"], 3)
    return rows.select("n", F.round("dist", 4).alias("dist"), "rank")


def outside_ratio(spark, sf_dir):
    row = Q.outside_ratio(_edges(spark, sf_dir), derived.polys(spark, sf_dir))
    return row.select("samples", F.round("outside_ratio", 6).alias("outside_ratio"))


def dissolved_perimeter(spark, sf_dir):
    return Q.box_dissolve_perimeter(derived.polys(spark, sf_dir)).select(F.round("perimeter", 4).alias("perimeter"))


def _metrics(spark, sf_dir):
    boxes = derived.polys(spark, sf_dir)
    return Q.evaluation_metrics(_edges(spark, sf_dir), boxes, Q.box_dissolve_perimeter(boxes))


def eval_metrics(spark, sf_dir):
    row = _metrics(spark, sf_dir)
    return row.withColumns({c: F.round(c, 4) for c in ("total_length", "outside_ratio", "length_change_rate")})


def eval_gates(spark, sf_dir):
    t = Q.Thresholds(max_components=20, min_leaf_count=10, max_branch_count=100, max_outside_ratio=0.9, require_parallel_pair=True)
    row = Q.evaluation_checks(_metrics(spark, sf_dir), t)
    return row.select("max_components", "min_leaf_count", "max_branch_count", "max_length_change_rate", "max_outside_ratio", "parallel_pair_required", "passed")


def validation_errors(spark, sf_dir):
    return Q.validate(_edges(spark, sf_dir), derived.polys(spark, sf_dir))


def scan_guard(spark, sf_dir):
    """Which parts of the report there are with a cap of twenty thousand edges."""
    parts = Q.report(_edges(spark, sf_dir), derived.polys(spark, sf_dir), 20_000)
    return spark.createDataFrame([(name,) for name in sorted(parts)], "part string")


def stage_counts(spark, sf_dir):
    """Rows before and after the filter of each early stage, as the stage sink writes them."""
    net, edges = derived.net(spark, sf_dir), _edges(spark, sf_dir)
    a = net.agg(F.lit("00_input").alias("stage"), F.count("*").alias("n"))
    b = edges.agg(F.lit("01_graph_build").alias("stage"), F.count("*").alias("n"))
    return a.unionByName(b).withColumn("meta", F.to_json(F.struct("stage", "n")))


def log_retention(spark, sf_dir):
    """Log files named by order dates; those more than three days older than the last."""
    days = derived.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    names = days.select(F.concat(F.lit("Log_"), F.date_format("day", "yyyyMMdd"), F.lit(".txt")).alias("name"))
    last = days.agg(F.max("day").alias("today"))
    return Q.expired_logs(names.crossJoin(last), F.col("today")).select("name")


_OUT = """, os AS (SELECT edge_id, i, ux + i / (n - 1)::DOUBLE * (vx - ux) AS x, uy + i / (n - 1)::DOUBLE * (vy - uy) AS y FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, greatest(2, ceil(weight)::INT + 1) AS n FROM edges WHERE weight > 0))),
    cov AS (SELECT count(*) AS inside FROM (SELECT DISTINCT edge_id, i FROM os JOIN polys ON x BETWEEN x0 AND x0 + w AND y BETWEEN y0 AND y0 + h)), tot AS (SELECT count(*) AS samples FROM os)"""
_SHARED = """, sh AS (SELECT coalesce(sum(((a.x0 = b.x0)::INT + (a.x0 = b.x0 + b.w)::INT + (a.x0 + a.w = b.x0)::INT + (a.x0 + a.w = b.x0 + b.w)::INT) * greatest(0, least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0))
    + ((a.y0 = b.y0)::INT + (a.y0 = b.y0 + b.h)::INT + (a.y0 + a.h = b.y0)::INT + (a.y0 + a.h = b.y0 + b.h)::INT) * greatest(0, least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0))), 0) AS shared
    FROM polys a JOIN polys b ON a.poly_id < b.poly_id AND a.x0 <= b.x0 + b.w AND b.x0 <= a.x0 + a.w AND a.y0 <= b.y0 + b.h AND b.y0 <= a.y0 + a.h),
    per AS (SELECT sum(2 * (w + h)) - 2 * max(shared) AS perimeter FROM polys, sh)"""
_METRICS = (
    _ALL_REC
    + _ADJ
    + _COMPONENT
    + _OUT
    + _SHARED
    + f""", par AS (SELECT count(*) > 0 AS parallel_pair_found FROM edges a JOIN edges b ON a.edge_id < b.edge_id AND {_BOX_NEAR.format(2)} WHERE {_SEG_DIST} <= 2.0 AND {_ANGLE} <= 10),
    met AS (SELECT (SELECT count(DISTINCT root) FROM comp) AS component_count, (SELECT count(*) FROM degree WHERE d = 1) AS leaf_count, (SELECT count(*) FROM degree WHERE d >= 3) AS branch_count,
    (SELECT sum(weight) FROM edges) AS total_length, (samples - inside) / samples::DOUBLE AS outside_ratio, parallel_pair_found, abs((SELECT sum(weight) FROM edges) - perimeter) / perimeter AS length_change_rate FROM tot, cov, per, par)"""
)
_TERM = """, leaf AS (SELECT n, CASE WHEN u = n THEN ux ELSE vx END AS x, CASE WHEN u = n THEN uy ELSE vy END AS y FROM degree JOIN edges ON d = 1 AND (u = n OR v = n)),
    lbd AS (SELECT n, min(CASE WHEN least(x - x0, x0 + w - x, y - y0, y0 + h - y) >= 0 THEN least(x - x0, x0 + w - x, y - y0, y0 + h - y)
        ELSE sqrt(power(greatest(x0 - x, 0, x - x0 - w), 2) + power(greatest(y0 - y, 0, y - y0 - h), 2)) END) AS dist FROM leaf, polys GROUP BY n)"""
_DESCRIBE = "count({0}) AS n, round(avg({0}), 4) AS mean, round(stddev_samp({0}), 4) AS std, round(min({0}), 4) AS min, round(max({0}), 4) AS max, " + ", ".join(f"round(quantile_cont({{0}}, {p}), 4) AS {k}" for k, p in {"p1": 0.01, "p5": 0.05, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}.items())

QUERIES = {
    "graph_summary": (
        graph_summary,
        _REC + _ADJ + _COMPONENT + " SELECT count(*) AS nodes, count(*) FILTER (d = 1) AS d1, count(*) FILTER (d = 2) AS d2, count(*) FILTER (d >= 3) AS d3_plus, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT root) FROM comp) AS components FROM degree",
    ),
    "edge_length_describe": (edge_length_describe, _NET + " SELECT " + _DESCRIBE.format("weight") + " FROM edges"),
    "edge_boundary_diag": (edge_boundary_diag, _ALL + _DIAG + " SELECT edge_id, round(length_m, 4) AS length_m, round(min_bd_m, 4) AS min_bd_m, deg_u, deg_v, is_leaf_edge, is_chain_edge FROM diag"),
    "boundary_counts": (boundary_counts, _ALL + _DIAG + " SELECT count(*) FILTER (min_bd_m < 0.25) AS near, count(*) FILTER (min_bd_m < 0.25 AND is_leaf_edge) AS leaf_near, count(*) FILTER (min_bd_m < 0.25 AND is_chain_edge) AS chain_near FROM diag"),
    "boundary_describe": (boundary_describe, _ALL + _DIAG + " SELECT " + _DESCRIBE.format("min_bd_m") + " FROM diag"),
    "risk_top20": (risk_top20, _ALL + _DIAG + " SELECT edge_id, round(length_m, 4) AS length_m, round(min_bd_m, 4) AS min_bd_m, is_leaf_edge, is_chain_edge FROM diag WHERE min_bd_m < 0.25 AND length_m < 3.0 ORDER BY diag.min_bd_m, diag.length_m, edge_id LIMIT 20"),
    "component_sizes": (component_sizes, _REC + _ADJ + _COMPONENT + " SELECT root, count(*) AS nodes FROM comp GROUP BY root"),
    "connectivity_check": (connectivity_check, _REC + _ADJ + _COMPONENT + " SELECT count(*) AS components, count(*) <= 1 AS connected, max(nodes) AS largest FROM (SELECT root, count(*) AS nodes FROM comp GROUP BY root)"),
    "terminal_touch": (terminal_touch, _ALL + _TERM + " SELECT n, round(dist, 4) AS dist FROM lbd WHERE dist > 0.5"),
    "terminal_errors": (terminal_errors, _ALL + _TERM + " SELECT * FROM (SELECT n, round(dist, 4) AS dist, row_number() OVER (ORDER BY n)::INT AS rank FROM lbd WHERE dist > 0.5) WHERE rank <= 3"),
    "outside_ratio": (outside_ratio, _ALL + _OUT + " SELECT samples, round((samples - inside) / samples::DOUBLE, 6) AS outside_ratio FROM tot, cov"),
    "dissolved_perimeter": (dissolved_perimeter, with_tables("polys") + _SHARED + " SELECT round(perimeter, 4) AS perimeter FROM per"),
    "eval_metrics": (eval_metrics, _METRICS + " SELECT component_count, leaf_count, branch_count, round(total_length, 4) AS total_length, round(outside_ratio, 4) AS outside_ratio, parallel_pair_found, round(length_change_rate, 4) AS length_change_rate FROM met"),
    "eval_gates": (
        eval_gates,
        _METRICS
        + """, g AS (SELECT component_count <= 20 AS max_components, leaf_count >= 10 AS min_leaf_count, branch_count <= 100 AS max_branch_count, length_change_rate <= 1.0 AS max_length_change_rate, outside_ratio <= 0.9 AS max_outside_ratio, parallel_pair_found AS parallel_pair_required FROM met)
            SELECT *, max_components AND min_leaf_count AND max_branch_count AND max_length_change_rate AND max_outside_ratio AND parallel_pair_required AS passed FROM g""",
    ),
    "validation_errors": (
        validation_errors,
        with_tables("polys", "net", "edges", "degree").replace("WITH", "WITH RECURSIVE", 1)
        + _ADJ
        + _COMPONENT
        + _TERM
        + """, whole AS (SELECT 'connectivity' AS "check", count(*) || ' components, largest ' || max(nodes) AS detail FROM (SELECT root, count(*) AS nodes FROM comp GROUP BY root) HAVING count(*) > 1),
            off AS (SELECT 'terminal' AS "check", 'node ' || n || ' is ' || round(dist, 3) || ' m off' AS detail FROM lbd WHERE dist > 0.5 ORDER BY n LIMIT 3)
            SELECT "check", detail FROM (SELECT * FROM whole UNION ALL SELECT * FROM off) ORDER BY "check", detail LIMIT 5""",
    ),
    "scan_guard": (
        scan_guard,
        with_tables("net", "edges") + """ SELECT part FROM (VALUES ('graph', false), ('lengths', false), ('boundary', true), ('near', true), ('risks', true)) AS p(part, capped), (SELECT count(*) AS n FROM edges) WHERE n > 0 AND (NOT capped OR n <= 20000)""",
    ),
    "stage_counts": (
        stage_counts,
        with_tables("net", "edges") + """ SELECT stage, n, '{"stage":"' || stage || '","n":' || n || '}' AS meta FROM (SELECT '00_input' AS stage, count(*) AS n FROM net UNION ALL SELECT '01_graph_build', count(*) FROM edges)""",
    ),
    "log_retention": (log_retention, "WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) SELECT 'Log_' || strftime(day, '%Y%m%d') || '.txt' AS name FROM d WHERE date_diff('day', day, (SELECT max(day) FROM d)) > 3"),
}
