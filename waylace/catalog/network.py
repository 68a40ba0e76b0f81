"""Queries on the road network: degrees, walks, pruning, components, parallels, bridges, planarizing."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from waylace.catalog.polygons import POLICY_TABLES, box_policy
from waylace.functions import geometry as G
from waylace.functions import graphs
from waylace.operators import edits, nearest, pruning
from waylace.plans.components import connected_components
from waylace.sources import derived
from waylace.sources.derived import ORACLE, with_tables

_NET = with_tables("net", "edges", "degree")
_REC = _NET.replace("WITH", "WITH RECURSIVE", 1)
_POLICY_NET = POLICY_TABLES + ",\n" + ",\n".join(ORACLE[t] for t in ("net", "edges", "degree"))
_ADJ = """, adj AS (SELECT edge_id, u AS a, v AS b, weight FROM edges UNION ALL SELECT edge_id, v, u, weight FROM edges)"""
_TRACE = (
    _ADJ
    + """, trace(a0, first_edge, prev, cur, edge_id, len, hops) AS (
    SELECT a, edge_id, a, b, edge_id, weight, 1::BIGINT FROM adj
    UNION ALL SELECT a0, first_edge, cur, adj.b, adj.edge_id, len + adj.weight, hops + 1 FROM trace JOIN degree ON cur = n AND d = 2 JOIN adj ON adj.a = cur AND adj.edge_id <> trace.edge_id),
    steps AS (SELECT trace.*, dl.d AS deg_a FROM trace JOIN degree dl ON dl.n = a0),
    walks AS (SELECT steps.*, de.d AS deg_last FROM steps JOIN degree de ON de.n = cur WHERE de.d <> 2),
    paths AS (SELECT a0 AS leaf, cur AS junction, len AS total_len, hops AS n_edges FROM walks WHERE deg_a = 1)"""
)
_RADIUS = "(0.1 + (n * 13 % 40) * 0.05::DOUBLE)"


def _edges(spark, sf_dir, scale=1.0):
    return derived.edges(spark, sf_dir, scale)


def _radius(edges):
    nodes = graphs.node_degree(edges).select("n")
    return nodes.withColumn("radius", derived.node_radius(F.col("n")))


def _nodes(edges):
    """``n, px, py`` of all nodes."""
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("ux").alias("px"), F.col("uy").alias("py")), F.struct(F.col("v").alias("n"), F.col("vx").alias("px"), F.col("vy").alias("py")))).alias("p")).select("p.*").distinct()


def node_degree(spark, sf_dir):
    return graphs.node_degree(_edges(spark, sf_dir)).select("n", F.col("degree").alias("d"))


def self_loop_degree(spark, sf_dir):
    """Degrees with self-loops, each of which counts twice."""
    return graphs.node_degree(derived.net(spark, sf_dir)).select("n", F.col("degree").alias("d"))


def degree_classes(spark, sf_dir):
    d = F.col("degree")
    rows = graphs.node_degree(_edges(spark, sf_dir))
    return rows.agg(F.count("*").alias("nodes"), F.count_if(d == 1).alias("d1"), F.count_if(d == 2).alias("d2"), F.count_if(d >= 3).alias("d3_plus"), F.max(d).alias("most"))


def edge_degree_join(spark, sf_dir):
    rows = graphs.with_degrees(_edges(spark, sf_dir))
    return rows.select("edge_id", "deg_u", "deg_v", (F.least("deg_u", "deg_v") == 1).alias("is_leaf_edge"), (F.greatest("deg_u", "deg_v") <= 2).alias("is_chain_edge"))


def graph_build_last_wins(spark, sf_dir):
    """A simple graph from repeated edges: orders join customers; the last order of a pair stays."""
    o = derived.table(spark, sf_dir, "orders")
    raw = o.select(F.col("o_orderkey").alias("edge_id"), (F.col("o_custkey") % 50).alias("u"), (F.col("o_orderkey") % 50).alias("v"), F.col("o_totalprice").alias("weight"))
    return graphs.simple_edges(raw).select("u", "v", "edge_id", F.round("weight", 2).alias("weight"))


def adjacency(spark, sf_dir):
    return graphs.ends(_edges(spark, sf_dir)).groupBy(F.col("a").alias("n")).agg(F.count("*").alias("neighbours"), F.min("b").alias("least"), F.max("b").alias("most"))


def leaf_trace(spark, sf_dir):
    return graphs.leaf_paths(graphs.chain_walks(_edges(spark, sf_dir))).select("leaf", "junction", F.round("total_len", 4).alias("total_len"), "n_edges")


def branch_trace(spark, sf_dir):
    rows = graphs.chain_walks(_edges(spark, sf_dir)).where("deg_a >= 3")
    return rows.select(F.col("a").alias("junction"), "edge_id", F.round("length", 4).alias("length"), (F.col("deg_last") == 1).alias("is_spur"))


def path_positions(spark, sf_dir):
    """Every edge of every leaf's path with its place and the length up to it."""
    rows = graphs.path_edges(graphs.chain_walks(_edges(spark, sf_dir)))
    return rows.select("leaf", "edge_id", "position", F.round("upto", 4).alias("upto"))


def ratio_prune_round(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return pruning.ratio_prune(e, _radius(e), box_policy(spark, sf_dir), rounds=1).select("edge_id")


def ratio_prune(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return pruning.ratio_prune(e, _radius(e), box_policy(spark, sf_dir)).select("edge_id")


def boundary_near_round(spark, sf_dir):
    e = _edges(spark, sf_dir)
    r = _radius(e).withColumn("radius", F.col("radius") * 0.25)
    nobody = r.select("n").where("false")
    return pruning.near_boundary(e, r, nobody, box_policy(spark, sf_dir)).select("edge_id").distinct()


def boundary_near_prune(spark, sf_dir):
    e = _edges(spark, sf_dir, 0.02)
    return pruning.boundary_near_prune(e, _radius(e).withColumn("radius", F.col("radius") * 0.25), box_policy(spark, sf_dir)).select("edge_id")


def components(spark, sf_dir):
    found = connected_components(_edges(spark, sf_dir), "u", "v")
    return found.select(F.col("node").alias("n"), F.col("root").alias("component"))


def component_totals(spark, sf_dir):
    e = _edges(spark, sf_dir)
    rows = pruning.component_totals(e, _radius(e))
    return rows.select("root", F.round("total_len", 2).alias("total_len"), F.round("max_radius", 4).alias("max_radius"), "junctions", "nodes")


def component_prune(spark, sf_dir):
    """On chains of a few nodes: edges between neighbours whose number is not a multiple of five."""
    return pruning.component_prune(*_fragments(spark, sf_dir), box_policy(spark, sf_dir)).select("edge_id")


def _fragments(spark, sf_dir):
    key = F.col("c_custkey")
    ends = F.when(key % 5 == 0, key).otherwise(key + 1)
    e = derived.table(spark, sf_dir, "customer").select(key.alias("edge_id"), key.alias("u"), ends.alias("v"), (F.col("c_nationkey") % 8 * 0.5).alias("weight")).where("u <> v")
    return e, graphs.node_degree(e).select("n", derived.node_radius(F.col("n")).alias("radius"))


def spur_prune(spark, sf_dir):
    return pruning.spur_prune(_edges(spark, sf_dir, 0.25), box_policy(spark, sf_dir)).select("edge_id")


def spur_clean_round(spark, sf_dir):
    return pruning.spur_clean(_edges(spark, sf_dir), 2.5, rounds=1).select("edge_id")


def spur_clean(spark, sf_dir):
    return pruning.spur_clean(_edges(spark, sf_dir), 2.5).select("edge_id")


def _near_nodes(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return nearest.boundary_within(_nodes(e), derived.polys(spark, sf_dir), ["n"], 0.8).select("n")


def fork_clean_round(spark, sf_dir):
    return pruning.fork_clean(_edges(spark, sf_dir), _near_nodes(spark, sf_dir), rounds=1).select("edge_id")


def fork_clean(spark, sf_dir):
    return pruning.fork_clean(_edges(spark, sf_dir), _near_nodes(spark, sf_dir)).select("edge_id")


def hook_prefix(spark, sf_dir):
    """What a single hook loses: the part of each leaf's path within four metres."""
    rows = graphs.path_edges(graphs.chain_walks(_edges(spark, sf_dir)))
    return rows.where("upto <= 4.0").select("leaf", "edge_id", F.round("upto", 4).alias("upto"))


def node_radius(spark, sf_dir):
    rows = nearest.nearest_boundary(_nodes(_edges(spark, sf_dir)), derived.polys(spark, sf_dir), ["n"])
    return rows.select("n", F.round(F.greatest(F.col("dist"), F.lit(pruning.MIN_RADIUS)), 4).alias("radius"))


def parallel_pairs(spark, sf_dir):
    policy = box_policy(spark, sf_dir)
    rows = edits.parallel_pairs(_edges(spark, sf_dir), policy.lane_width * policy.parallel_distance_factor, policy.parallel_angle)
    return rows.select("i", "j", F.round("distance", 4).alias("distance"), F.round("angle", 3).alias("angle"))


def has_parallel_pair(spark, sf_dir):
    return edits.has_parallel_pair(_edges(spark, sf_dir), 2.0, 10.0)


def reconnect_candidates(spark, sf_dir):
    rows = edits.reconnect_candidates(_edges(spark, sf_dir), box_policy(spark, sf_dir))
    return rows.select("a", "b", F.round("distance", 4).alias("distance"), F.round("angle", 3).alias("angle"))


def reconnect_inside(spark, sf_dir):
    policy = box_policy(spark, sf_dir)
    rows = edits.reconnect_inside(edits.reconnect_candidates(_edges(spark, sf_dir), policy), derived.polys(spark, sf_dir), policy)
    return rows.select("a", "b", F.round("distance", 4).alias("distance"))


def endpoint_heading(spark, sf_dir):
    return edits.endpoint_headings(_edges(spark, sf_dir)).select("n", F.round("hx", 4).alias("hx"), F.round("hy", 4).alias("hy"))


def direction_field_shift(spark, sf_dir):
    rows = edits.mean_directions(_edges(spark, sf_dir))
    return rows.select("n", "neighbours", F.round("mx", 4).alias("mx"), F.round("my", 4).alias("my"))


def _with_course(edges, points=8):
    """``edges`` with a straight ``geom`` of ``points + 1`` vertices."""
    at = lambda k, e: F.col(f"u{e}") + k / points * (F.col(f"v{e}") - F.col(f"u{e}"))
    return edges.withColumn("geom", F.transform(F.sequence(F.lit(0), F.lit(points)), lambda k: G.point(at(k, "x"), at(k, "y"))))


def morph_orientation(spark, sf_dir):
    """Edges given backwards keep their orientation when their ends move."""
    e = _with_course(_edges(spark, sf_dir))
    turned = e.withColumn("geom", F.when(F.col("edge_id") % 2 == 0, F.reverse("geom")).otherwise(F.col("geom")))
    shifts = graphs.node_degree(e).select("n", F.lit(0.25).alias("dx"), F.lit(-0.5).alias("dy"))
    g = edits.with_moved_ends(turned, shifts).select("edge_id", "geom")
    first, last = F.get("geom", F.lit(0)), F.element_at("geom", -1)
    return g.select("edge_id", *[F.round(p[c], 4).alias(f"{n}{c}") for n, p in (("first_", first), ("last_", last)) for c in "xy"])


def chain_merge_lengths(spark, sf_dir):
    rows = edits.merge_chains(_edges(spark, sf_dir))
    return rows.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "parts", F.round("weight", 4).alias("weight"))


def chain_merge_geometry(spark, sf_dir):
    rows = edits.merge_chains(_with_course(_edges(spark, sf_dir)))
    return rows.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.size("geom").alias("points"), F.round(G.line_length(F.col("geom")), 4).alias("length"))


def planarize_segments(spark, sf_dir):
    rows = edits.planarize(_edges(spark, sf_dir))
    return rows.agg(F.count("*").alias("pieces"), F.round(F.sum(G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))), 0).alias("length"))


def segment_crossings(spark, sf_dir):
    pairs = edits.edge_pairs(_edges(spark, sf_dir), 0.0)
    both = pairs.where(G.crosses(*[F.col(f"a_{c}") for c in edits.XY], *[F.col(f"b_{c}") for c in edits.XY]))
    return both.select(F.col("a_edge_id").alias("i"), F.col("b_edge_id").alias("j"))


def bridge_candidates(spark, sf_dir):
    rows = edits.bridge_candidates(_edges(spark, sf_dir, 0.5))
    return rows.select("edge_id", "deg_u", "deg_v", F.round("weight", 4).alias("weight"))


def bridge_parallel_guard(spark, sf_dir):
    return edits.guarded_bridges(_edges(spark, sf_dir, 0.5)).select("edge_id", "preserve")


def junction_smooth(spark, sf_dir):
    rows = edits.smooth_junctions(_with_course(_edges(spark, sf_dir)))
    return rows.select("edge_id", F.size("geom").alias("points"))


def simplify_tolerance(spark, sf_dir):
    return edits.simplify_tolerance(_edges(spark, sf_dir)).select("edge_id", "tolerance")


_GONE = " SELECT edge_id FROM edges WHERE edge_id NOT IN (SELECT edge_id FROM gone)"
_TOWARDS_LEAF = ", lp AS (SELECT a0 AS leaf, edge_id, hops AS position, len AS upto, cur AS far FROM steps WHERE deg_a = 1)"
_COMPONENT = """, reach(n, c) AS (SELECT n, n FROM degree UNION SELECT adj.b, least(reach.c, adj.b) FROM reach JOIN adj ON adj.a = reach.n WHERE reach.c < adj.b), comp AS (SELECT n, min(c) AS root FROM reach GROUP BY n)"""
_NEAR = """, nodes AS (SELECT DISTINCT n, x, y FROM (SELECT u AS n, ux AS x, uy AS y FROM edges UNION ALL SELECT v, vx, vy FROM edges)),
    bd AS (SELECT n, min(CASE WHEN least(x - x0, x0 + w - x, y - y0, y0 + h - y) >= 0 THEN least(x - x0, x0 + w - x, y - y0, y0 + h - y)
        ELSE sqrt(power(greatest(x0 - x, 0, x - x0 - w), 2) + power(greatest(y0 - y, 0, y - y0 - h), 2)) END) AS dist FROM nodes, polys GROUP BY n)"""
_UNIT = """, dirs AS (SELECT edge_id, a, b, (bx - ax) / len AS dx, (by_ - ay) / len AS dy FROM (SELECT *, sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) AS len FROM (
    SELECT edge_id, u AS a, v AS b, ux AS ax, uy AS ay, vx AS bx, vy AS by_ FROM edges UNION ALL SELECT edge_id, v, u, vx, vy, ux, uy FROM edges)) WHERE len > 0)"""


def _distance_sql(px, py, ax, ay, bx, by):
    t = f"greatest(0, least(1, coalesce((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / nullif(power({bx} - {ax}, 2) + power({by} - {ay}, 2), 0), 0)))"
    return f"sqrt(power({px} - {ax} - {t} * ({bx} - {ax}), 2) + power({py} - {ay} - {t} * ({by} - {ay}), 2))"


def _cross_sql(a="a", b="b"):
    side = lambda p, q, r: f"((({q[0]}) - ({p[0]})) * (({r[1]}) - ({p[1]})) - (({q[1]}) - ({p[1]})) * (({r[0]}) - ({p[0]})))"
    p, q, r, s = (f"{a}.ux", f"{a}.uy"), (f"{a}.vx", f"{a}.vy"), (f"{b}.ux", f"{b}.uy"), (f"{b}.vx", f"{b}.vy")
    return f"({side(p, q, r)} * {side(p, q, s)} < 0 AND {side(r, s, p)} * {side(r, s, q)} < 0)"


_SEG_DIST = (
    f"CASE WHEN {_cross_sql()} THEN 0 ELSE least("
    + ", ".join(
        [
            _distance_sql("a.ux", "a.uy", "b.ux", "b.uy", "b.vx", "b.vy"),
            _distance_sql("a.vx", "a.vy", "b.ux", "b.uy", "b.vx", "b.vy"),
            _distance_sql("b.ux", "b.uy", "a.ux", "a.uy", "a.vx", "a.vy"),
            _distance_sql("b.vx", "b.vy", "a.ux", "a.uy", "a.vx", "a.vy"),
        ]
    )
    + ") END"
)
_BOX_NEAR = "least(a.ux, a.vx) - {0} <= greatest(b.ux, b.vx) AND least(b.ux, b.vx) - {0} <= greatest(a.ux, a.vx) AND least(a.uy, a.vy) - {0} <= greatest(b.uy, b.vy) AND least(b.uy, b.vy) - {0} <= greatest(a.uy, a.vy)"
_ANGLE = "degrees(acos(abs(greatest(-1, least(1, coalesce(((a.vx - a.ux) * (b.vx - b.ux) + (a.vy - a.uy) * (b.vy - b.uy)) / nullif(a.weight * b.weight, 0), 0))))))"
_LEAVES = """, heads AS (SELECT a AS n, ax AS x, ay AS y, (ax - bx) / len AS hx, (ay - by_) / len AS hy FROM (SELECT *, sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) AS len FROM (
    SELECT u AS a, ux AS ax, uy AS ay, vx AS bx, vy AS by_ FROM edges UNION ALL SELECT v, vx, vy, ux, uy FROM edges)) JOIN degree ON a = n AND d = 1 WHERE len > 0)"""


def _scaled(sql, factor):
    """The oracle's edges with all coordinates times ``factor``."""
    return sql.replace("edges AS (SELECT *, sqrt(", "raw_edges AS (SELECT *, sqrt(", 1).replace("degree AS (", f"edges AS (SELECT edge_id, u, v, ux * {factor} AS ux, uy * {factor} AS uy, vx * {factor} AS vx, vy * {factor} AS vy, weight * {factor} AS weight FROM raw_edges),\ndegree AS (", 1)


_RECONNECT = (
    _POLICY_NET
    + _LEAVES
    + """, cand AS (SELECT a.n AS a, b.n AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS distance, degrees(acos(abs(greatest(-1, least(1, a.hx * b.hx + a.hy * b.hy))))) AS angle
    FROM heads a JOIN heads b ON a.n < b.n AND abs(a.x - b.x) <= 14 AND abs(a.y - b.y) <= 14),
    ok AS (SELECT cand.* FROM cand, pol WHERE distance <= reconnect_radius AND angle <= reconnect_angle AND distance > 0 AND NOT EXISTS (SELECT 1 FROM edges WHERE least(u, v) = a AND greatest(u, v) = b))"""
)

_ROUND = (
    ", degree AS MATERIALIZED (SELECT n, count(*) AS d FROM (SELECT u AS n FROM edges UNION ALL SELECT v FROM edges) GROUP BY n)"
    + _TRACE.replace("adj AS", "adj AS MATERIALIZED").replace("steps AS", "steps AS MATERIALIZED")
    + ", lp AS MATERIALIZED (SELECT a0 AS leaf, edge_id, hops AS position, len AS upto, cur AS far FROM steps WHERE deg_a = 1)"
)
_ROUND_NAMES = re.compile(r"\b(degree|adj|trace|steps|walks|paths|lp|gone|cand|hits|judged|bridge|unit|alike|ready|first|chosen|moves|kept|edges)\b")


def _until_stable(head: str, doomed: str, rounds: int = 6) -> str:
    """``head`` and so many rounds of ``doomed``, which defines ``gone``; the edges that are left are ``edges_0``, ``edges_1`` and so on.

    The last round must find nothing, or the query fails.
    """
    return _rounds(head, _ROUND + doomed + ", left_over AS MATERIALIZED (SELECT * FROM edges WHERE edge_id NOT IN (SELECT edge_id FROM gone))", "gone", rounds)


def _rounds(head: str, body: str, empty: str, rounds: int) -> str:
    out = head + ", edges_0 AS MATERIALIZED (SELECT * FROM edges)"
    for k in range(rounds):
        named = _ROUND_NAMES.sub(rf"\1_{k}", body)
        out += named.replace("left_over", f"edges_{k + 1}")
    return out + f", settled AS (SELECT CASE WHEN count(*) > 0 THEN error('not settled') ELSE 'true' END AS yes FROM {empty}_{rounds - 1})"


def _stable(rounds: int = 6) -> str:
    return f" SELECT edge_id FROM edges_{rounds}, settled WHERE yes = 'true'"


_CLIP = """, part AS (SELECT a, b, distance, greatest(0, coalesce(CASE WHEN bx <> ax THEN least((x0 - ax) / (bx - ax), (x0 + w - ax) / (bx - ax)) END, 0), coalesce(CASE WHEN by_ <> ay THEN least((y0 - ay) / (by_ - ay), (y0 + h - ay) / (by_ - ay)) END, 0)) AS t0,
    least(1, coalesce(CASE WHEN bx <> ax THEN greatest((x0 - ax) / (bx - ax), (x0 + w - ax) / (bx - ax)) END, 1), coalesce(CASE WHEN by_ <> ay THEN greatest((y0 - ay) / (by_ - ay), (y0 + h - ay) / (by_ - ay)) END, 1)) AS t1,
    (bx = ax AND (ax < x0 OR ax > x0 + w)) OR (by_ = ay AND (ay < y0 OR ay > y0 + h)) AS outside
    FROM ok JOIN polys ON least(ax, bx) <= x0 + w AND greatest(ax, bx) >= x0 AND least(ay, by_) <= y0 + h AND greatest(ay, by_) >= y0),
    share AS (SELECT a, b, distance, sum(CASE WHEN outside OR t0 >= t1 THEN 0 ELSE (t1 - t0) * distance END) AS inside FROM part GROUP BY ALL)"""
_PROTECTED = (
    _ADJ
    + _COMPONENT
    + ", totals AS (SELECT root, sum(weight) AS total_len FROM edges JOIN comp ON n = u GROUP BY root), widest AS (SELECT root, max(0.25 * "
    + _RADIUS
    + ") AS max_radius FROM comp GROUP BY root), protected AS MATERIALIZED (SELECT n FROM comp JOIN totals USING (root) JOIN widest USING (root) WHERE total_len >= 30 OR max_radius >= 1.0)"
)
_NEAR_BOUNDARY = (
    ", hits AS (SELECT leaf, count(*) AS nodes, sum((0.25 * "
    + _RADIUS
    + " <= radius_hit)::INT) AS hits_n FROM (SELECT leaf, far AS n FROM lp UNION ALL SELECT leaf, leaf FROM paths), pol WHERE leaf NOT IN (SELECT n FROM protected) GROUP BY leaf), judged AS (SELECT leaf, 0.25 * "
    + _RADIUS.replace("n *", "junction *")
    + """ <= 0.05 AS hard, hits_n / nodes::DOUBLE >= hit_ratio OR hits_n >= hit_count AS soft FROM hits JOIN paths USING (leaf), pol),
    gone AS MATERIALIZED (SELECT DISTINCT edge_id FROM lp JOIN judged USING (leaf) WHERE hard OR soft AND position <= 2)"""
)
_CONTRACT = (
    """, degree AS MATERIALIZED (SELECT n, count(*) AS d FROM (SELECT u AS n FROM edges UNION ALL SELECT v FROM edges) GROUP BY n),
    bridge AS MATERIALIZED (SELECT edges.* FROM edges JOIN degree a ON a.n = u JOIN degree b ON b.n = v WHERE a.d >= 3 AND b.d >= 3 AND u <> v AND weight <= 1.5),
    unit AS MATERIALIZED (SELECT edge_id, a, (bx - ax) / len AS dx, (by_ - ay) / len AS dy FROM (SELECT *, sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) AS len FROM (
        SELECT edge_id, u AS a, ux AS ax, uy AS ay, vx AS bx, vy AS by_ FROM edges UNION ALL SELECT edge_id, v, vx, vy, ux, uy FROM edges)) WHERE len > 0),
    alike AS (SELECT DISTINCT bridge.edge_id FROM bridge JOIN unit p ON p.a = bridge.u AND p.edge_id <> bridge.edge_id JOIN unit q ON q.a = bridge.v AND q.edge_id <> bridge.edge_id
        WHERE degrees(acos(abs(greatest(-1, least(1, p.dx * q.dx + p.dy * q.dy))))) <= 15),
    ready AS MATERIALIZED (SELECT * FROM bridge WHERE edge_id NOT IN (SELECT edge_id FROM alike)),
    first AS MATERIALIZED (SELECT * FROM (SELECT n, edge_id, row_number() OVER (PARTITION BY n ORDER BY weight, edge_id) AS r FROM (SELECT u AS n, * FROM ready UNION ALL SELECT v, * FROM ready)) WHERE r = 1),
    chosen AS MATERIALIZED (SELECT ready.* FROM ready JOIN first a ON a.n = u AND a.edge_id = ready.edge_id JOIN first b ON b.n = v AND b.edge_id = ready.edge_id),
    moves AS MATERIALIZED (SELECT n, least(u, v) AS goal, round_even((ux + vx) / 2 * 1000, 0) / 1000 AS x, round_even((uy + vy) / 2 * 1000, 0) / 1000 AS y FROM (SELECT u AS n, * FROM chosen UNION ALL SELECT v, * FROM chosen)),
    kept AS (SELECT edges.edge_id, coalesce(a.goal, u) AS u, coalesce(b.goal, v) AS v, coalesce(a.x, ux) AS ux, coalesce(a.y, uy) AS uy, coalesce(b.x, vx) AS vx, coalesce(b.y, vy) AS vy
        FROM edges LEFT JOIN moves a ON a.n = u LEFT JOIN moves b ON b.n = v WHERE edges.edge_id NOT IN (SELECT edge_id FROM chosen)),
    left_over AS MATERIALIZED (SELECT *, sqrt((ux - vx) * (ux - vx) + (uy - vy) * (uy - vy)) AS weight FROM kept WHERE u <> v)"""
)
_PLANAR = f""", pr AS (SELECT a.edge_id AS i, b.edge_id AS j, a.ux AS aux, a.uy AS auy, b.ux AS bux, b.uy AS buy, b.vx AS bvx, b.vy AS bvy, a.vx AS avx, a.vy AS avy,
        a.vx - a.ux AS px, a.vy - a.uy AS py, b.vx - b.ux AS qx, b.vy - b.uy AS qy, b.ux - a.ux AS wx, b.uy - a.uy AS wy FROM edges a JOIN edges b ON a.edge_id < b.edge_id AND {_BOX_NEAR.format(0)}),
    de AS (SELECT *, px * qy - py * qx AS det FROM pr),
    ts AS (SELECT *, CASE WHEN det <> 0 THEN (wx * qy - wy * qx) / det END AS t, CASE WHEN det <> 0 THEN (wx * py - wy * px) / det END AS s, det = 0 AND abs(wx * py - wy * px) <= 1e-9 AS level FROM de),
    found AS (SELECT i AS edge_id, t AS place FROM ts WHERE t BETWEEN -1e-9 AND 1 + 1e-9 AND s BETWEEN -1e-9 AND 1 + 1e-9
        UNION ALL SELECT j, s FROM ts WHERE t BETWEEN -1e-9 AND 1 + 1e-9 AND s BETWEEN -1e-9 AND 1 + 1e-9
        UNION ALL SELECT i, ((bux - aux) * px + (buy - auy) * py) / (px * px + py * py) FROM ts WHERE level UNION ALL SELECT i, ((bvx - aux) * px + (bvy - auy) * py) / (px * px + py * py) FROM ts WHERE level
        UNION ALL SELECT j, ((aux - bux) * qx + (auy - buy) * qy) / (qx * qx + qy * qy) FROM ts WHERE level UNION ALL SELECT j, ((avx - bux) * qx + (avy - buy) * qy) / (qx * qx + qy * qy) FROM ts WHERE level),
    cuts AS (SELECT DISTINCT edge_id, round(place, 9) AS place FROM found WHERE place > 1e-9 AND place < 1 - 1e-9 UNION ALL SELECT edge_id, 0 FROM edges UNION ALL SELECT edge_id, 1 FROM edges),
    spans AS (SELECT edge_id, place, lead(place) OVER (PARTITION BY edge_id ORDER BY place) AS till FROM cuts),
    pieces AS (SELECT round_even((ux + place * (vx - ux)) * 1000, 0) / 1000 AS ax, round_even((uy + place * (vy - uy)) * 1000, 0) / 1000 AS ay,
        round_even((ux + till * (vx - ux)) * 1000, 0) / 1000 AS bx, round_even((uy + till * (vy - uy)) * 1000, 0) / 1000 AS by_ FROM spans JOIN edges USING (edge_id) WHERE till IS NOT NULL),
    once AS (SELECT DISTINCT CASE WHEN (ax, ay) <= (bx, by_) THEN ax ELSE bx END AS ax, CASE WHEN (ax, ay) <= (bx, by_) THEN ay ELSE by_ END AS ay,
        CASE WHEN (ax, ay) <= (bx, by_) THEN bx ELSE ax END AS bx, CASE WHEN (ax, ay) <= (bx, by_) THEN by_ ELSE ay END AS by_ FROM pieces WHERE ax <> bx OR ay <> by_)"""
#: More rounds than the test tables need; the oracle fails if they were too few.
_CONTRACT_ROUNDS = 8
CONTRACTED = _rounds(_scaled(_NET, 0.5), _CONTRACT, "ready", _CONTRACT_ROUNDS)

QUERIES = {
    "node_degree": (node_degree, _NET + " SELECT n, d FROM degree"),
    "self_loop_degree": (self_loop_degree, with_tables("net") + " SELECT n, count(*) AS d FROM (SELECT u AS n FROM net UNION ALL SELECT v FROM net) GROUP BY n"),
    "degree_classes": (degree_classes, _NET + " SELECT count(*) AS nodes, count(*) FILTER (d = 1) AS d1, count(*) FILTER (d = 2) AS d2, count(*) FILTER (d >= 3) AS d3_plus, max(d) AS most FROM degree"),
    "edge_degree_join": (edge_degree_join, _NET + " SELECT edge_id, a.d AS deg_u, b.d AS deg_v, least(a.d, b.d) = 1 AS is_leaf_edge, greatest(a.d, b.d) <= 2 AS is_chain_edge FROM edges JOIN degree a ON a.n = u JOIN degree b ON b.n = v"),
    "graph_build_last_wins": (
        graph_build_last_wins,
        """SELECT u, v, edge_id, round(weight, 2) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY edge_id DESC) AS r FROM (
            SELECT least(o_custkey % 50, o_orderkey % 50) AS u, greatest(o_custkey % 50, o_orderkey % 50) AS v, o_orderkey AS edge_id, o_totalprice AS weight FROM orders WHERE o_custkey % 50 <> o_orderkey % 50)) WHERE r = 1""",
    ),
    "adjacency": (adjacency, _NET + _ADJ + " SELECT a AS n, count(*) AS neighbours, min(b) AS least, max(b) AS most FROM adj GROUP BY a"),
    "leaf_trace": (leaf_trace, _REC + _TRACE + " SELECT leaf, junction, round(total_len, 4) AS total_len, n_edges FROM paths"),
    "branch_trace": (branch_trace, _REC + _TRACE + " SELECT a0 AS junction, first_edge AS edge_id, round(len, 4) AS length, deg_last = 1 AS is_spur FROM walks WHERE deg_a >= 3"),
    "path_positions": (path_positions, _REC + _TRACE + _TOWARDS_LEAF + " SELECT leaf, edge_id, position, round(upto, 4) AS upto FROM lp"),
    "ratio_prune_round": (
        ratio_prune_round,
        _POLICY_NET.replace("WITH", "WITH RECURSIVE", 1) + _TRACE + _TOWARDS_LEAF + ", gone AS (SELECT edge_id FROM lp JOIN paths USING (leaf), pol WHERE total_len < " + _RADIUS.replace("n *", "junction *") + " * prune_ratio)" + _GONE,
    ),
    "ratio_prune": (
        ratio_prune,
        _until_stable(
            _POLICY_NET.replace("WITH", "WITH RECURSIVE", 1),
            ", gone AS MATERIALIZED (SELECT edge_id FROM lp JOIN paths USING (leaf), pol WHERE total_len < " + _RADIUS.replace("n *", "junction *") + " * prune_ratio)",
        )
        + _stable(),
    ),
    "boundary_near_round": (
        boundary_near_round,
        _POLICY_NET.replace("WITH", "WITH RECURSIVE", 1)
        + _TRACE
        + _TOWARDS_LEAF
        + ", hits AS (SELECT leaf, count(*) AS nodes, sum((0.25 * "
        + _RADIUS
        + " <= radius_hit)::INT) AS hits FROM (SELECT leaf, far AS n FROM lp UNION ALL SELECT leaf, leaf FROM paths), pol GROUP BY leaf)"
        + """, j AS (SELECT leaf, 0.25 * """
        + _RADIUS.replace("n *", "junction *")
        + """ <= 0.05 AS hard, hits / nodes::DOUBLE >= hit_ratio OR hits >= hit_count AS soft FROM hits JOIN paths USING (leaf), pol)
            SELECT DISTINCT edge_id FROM lp JOIN j USING (leaf) WHERE hard OR soft AND position <= 2""",
    ),
    "boundary_near_prune": (
        boundary_near_prune,
        _until_stable(_scaled(_POLICY_NET, 0.02).replace("WITH", "WITH RECURSIVE", 1) + _PROTECTED, _NEAR_BOUNDARY, 16) + _stable(16),
    ),
    "components": (components, _REC + _ADJ + _COMPONENT + " SELECT n, root AS component FROM comp"),
    "component_totals": (
        component_totals,
        _REC
        + _ADJ
        + _COMPONENT
        + ", t AS (SELECT root, sum(weight) AS total_len FROM edges JOIN comp ON n = u GROUP BY root), m AS (SELECT root, max("
        + _RADIUS
        + ") AS max_radius, count(*) FILTER (d >= 3) AS junctions, count(*) AS nodes FROM comp JOIN degree USING (n) GROUP BY root) SELECT root, round(total_len, 2) AS total_len, round(max_radius, 4) AS max_radius, junctions, nodes FROM t JOIN m USING (root)",
    ),
    "component_prune": (
        component_prune,
        POLICY_TABLES
        + """, frag AS (SELECT c_custkey AS edge_id, c_custkey AS u, c_custkey + 1 AS v, c_nationkey % 8 * 0.5::DOUBLE AS weight, (c_custkey - 1) // 5 AS c FROM customer WHERE c_custkey % 5 <> 0),
            t AS (SELECT c, sum(weight) AS total_len FROM frag GROUP BY c), m AS (SELECT c, max("""
        + _RADIUS
        + """) AS max_radius FROM (SELECT c, u AS n FROM frag UNION ALL SELECT c, v FROM frag) GROUP BY c)
            SELECT edge_id FROM frag JOIN t USING (c) JOIN m USING (c), pol WHERE NOT (total_len < component_min_length AND max_radius < 1.0)""",
    ),
    "spur_prune": (
        spur_prune,
        _scaled(_POLICY_NET, 0.25).replace("WITH", "WITH RECURSIVE", 1)
        + _TRACE
        + ", br AS (SELECT *, max(len) OVER (PARTITION BY a0) AS longest FROM walks WHERE deg_a >= 3), gone AS (SELECT first_edge AS edge_id FROM br, pol WHERE deg_last = 1 AND len <= spur_max_length AND len <= longest * spur_ratio)"
        + _GONE,
    ),
    "spur_clean_round": (spur_clean_round, _REC + _TRACE + _TOWARDS_LEAF + ", gone AS (SELECT edge_id FROM lp JOIN paths USING (leaf) WHERE total_len <= 2.5)" + _GONE),
    "spur_clean": (spur_clean, _until_stable(_REC, ", gone AS MATERIALIZED (SELECT edge_id FROM lp JOIN paths USING (leaf) WHERE total_len <= 2.5)") + _stable()),
    "fork_clean_round": (
        fork_clean_round,
        with_tables("polys", "net", "edges", "degree").replace("WITH", "WITH RECURSIVE", 1)
        + _TRACE
        + _TOWARDS_LEAF
        + _NEAR
        + """, cand AS (SELECT paths.*, count(*) OVER (PARTITION BY junction) AS leaves FROM paths JOIN bd ON bd.n = leaf WHERE dist <= 0.8),
            gone AS (SELECT edge_id FROM lp JOIN cand USING (leaf) WHERE CASE WHEN leaves >= 2 THEN total_len <= 25 ELSE upto <= 4 END)"""
        + _GONE,
    ),
    "fork_clean": (
        fork_clean,
        _until_stable(
            with_tables("polys", "net", "edges", "degree").replace("WITH", "WITH RECURSIVE", 1) + _NEAR.replace("bd AS", "bd AS MATERIALIZED"),
            """, cand AS (SELECT paths.*, count(*) OVER (PARTITION BY junction) AS leaves FROM paths JOIN bd ON bd.n = leaf WHERE dist <= 0.8),
            gone AS MATERIALIZED (SELECT DISTINCT edge_id FROM lp JOIN cand USING (leaf) WHERE CASE WHEN leaves >= 2 THEN total_len <= 25 ELSE upto <= 4 END)""",
        )
        + _stable(),
    ),
    "hook_prefix": (hook_prefix, _REC + _TRACE + _TOWARDS_LEAF + " SELECT leaf, edge_id, round(upto, 4) AS upto FROM lp WHERE upto <= 4.0"),
    "node_radius": (node_radius, with_tables("polys", "net", "edges", "degree") + _NEAR + " SELECT n, round(greatest(dist, 0.1), 4) AS radius FROM bd"),
    "parallel_pairs": (
        parallel_pairs,
        _POLICY_NET
        + f""", pr AS (SELECT a.edge_id AS i, b.edge_id AS j, {_SEG_DIST} AS distance, {_ANGLE} AS angle FROM edges a JOIN edges b ON a.edge_id < b.edge_id AND {_BOX_NEAR.format(3)})
            SELECT i, j, round(distance, 4) AS distance, round(angle, 3) AS angle FROM pr, pol WHERE distance <= lane_width * 0.8 AND angle <= 12""",
    ),
    "has_parallel_pair": (has_parallel_pair, _NET + f" SELECT count(*) > 0 AS found FROM edges a JOIN edges b ON a.edge_id < b.edge_id AND {_BOX_NEAR.format(2)} WHERE {_SEG_DIST} <= 2.0 AND {_ANGLE} <= 10"),
    "reconnect_candidates": (reconnect_candidates, _RECONNECT + " SELECT a, b, round(distance, 4) AS distance, round(angle, 3) AS angle FROM ok"),
    "reconnect_inside": (reconnect_inside, _RECONNECT + _CLIP + " SELECT a, b, round(distance, 4) AS distance FROM share, pol WHERE inside >= 0.97 * distance"),
    "endpoint_heading": (endpoint_heading, _NET + _LEAVES + " SELECT n, round(hx, 4) AS hx, round(hy, 4) AS hy FROM heads"),
    "direction_field_shift": (direction_field_shift, _NET + _UNIT + " SELECT a AS n, count(*) AS neighbours, round(avg(dx), 4) AS mx, round(avg(dy), 4) AS my FROM dirs GROUP BY a HAVING count(*) >= 2"),
    "morph_orientation": (
        morph_orientation,
        _NET
        + """ SELECT edge_id, round(CASE WHEN edge_id % 2 = 0 THEN vx ELSE ux END + 0.25, 4) AS first_x, round(CASE WHEN edge_id % 2 = 0 THEN vy ELSE uy END - 0.5, 4) AS first_y,
            round(CASE WHEN edge_id % 2 = 0 THEN ux ELSE vx END + 0.25, 4) AS last_x, round(CASE WHEN edge_id % 2 = 0 THEN uy ELSE vy END - 0.5, 4) AS last_y FROM edges""",
    ),
    "chain_merge_lengths": (chain_merge_lengths, _REC + _TRACE + " SELECT a0 AS u, cur AS v, hops AS parts, round(len, 4) AS weight FROM walks WHERE deg_a <> 2 AND a0 < cur"),
    "chain_merge_geometry": (chain_merge_geometry, _REC + _TRACE + " SELECT a0 AS u, cur AS v, (8 * hops + 1)::INT AS points, round(len, 4) AS length FROM walks WHERE deg_a <> 2 AND a0 < cur"),
    "planarize_segments": (planarize_segments, _NET + _PLANAR + " SELECT count(*) AS pieces, round(sum(sqrt(power(ax - bx, 2) + power(ay - by_, 2))), 0) AS length FROM once"),
    "segment_crossings": (segment_crossings, _NET + f" SELECT a.edge_id AS i, b.edge_id AS j FROM edges a JOIN edges b ON a.edge_id < b.edge_id AND {_BOX_NEAR.format(0)} WHERE {_cross_sql()}"),
    "bridge_candidates": (bridge_candidates, _scaled(_NET, 0.5) + " SELECT edge_id, a.d AS deg_u, b.d AS deg_v, round(weight, 4) AS weight FROM edges JOIN degree a ON a.n = u JOIN degree b ON b.n = v WHERE a.d >= 3 AND b.d >= 3 AND weight <= 1.5"),
    "bridge_parallel_guard": (
        bridge_parallel_guard,
        _scaled(_NET, 0.5)
        + _UNIT
        + """, br AS (SELECT edges.* FROM edges JOIN degree a ON a.n = u JOIN degree b ON b.n = v WHERE a.d >= 3 AND b.d >= 3 AND weight <= 1.5),
            alike AS (SELECT DISTINCT br.edge_id FROM br JOIN dirs p ON p.a = br.u AND p.edge_id <> br.edge_id JOIN dirs q ON q.a = br.v AND q.edge_id <> br.edge_id WHERE degrees(acos(abs(greatest(-1, least(1, p.dx * q.dx + p.dy * q.dy))))) <= 15)
            SELECT edge_id, edge_id IN (SELECT edge_id FROM alike) AS preserve FROM br""",
    ),
    "junction_smooth": (
        junction_smooth,
        _NET
        + """, pts AS (SELECT edge_id, k, k > 0 AND k < 8 AND (a.d >= 3 AND k / 8.0::DOUBLE * weight <= 2.0 OR b.d >= 3 AND (8 - k) / 8.0::DOUBLE * weight <= 2.0) AS gone FROM (SELECT edges.*, unnest(range(9)) AS k FROM edges) JOIN degree a ON a.n = u JOIN degree b ON b.n = v)
            SELECT edge_id, count(*) FILTER (NOT gone)::INT AS points FROM pts GROUP BY edge_id""",
    ),
    "simplify_tolerance": (simplify_tolerance, _NET + " SELECT edge_id, CASE WHEN a.d >= 3 OR b.d >= 3 THEN 0.12 ELSE 0.05 END::DOUBLE AS tolerance FROM edges JOIN degree a ON a.n = u JOIN degree b ON b.n = v"),
}
