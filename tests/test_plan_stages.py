"""The stages of the centreline plan over rings of any form, against slow versions."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from waylace.functions import geometry as G
from waylace.functions import graphs, kernels, offsets
from waylace.operators import dissolve, edits
from waylace.plans import centerlines as C
from waylace.plans.policy import policy_for_width


def points(xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def surface(spark, *polygons):
    """Polygons as (outer ring, hole, hole ...)."""
    rows = [(i, points(p[0]), [points(h) for h in p[1:]]) for i, p in enumerate(polygons)]
    df = spark.createDataFrame(rows, f"poly_id long, ring {G.LINE}, holes array<{G.LINE}>")
    return df.select("poly_id", "ring", dissolve.with_holes(F.col("ring"), F.col("holes")).alias("whole"))


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


L_SHAPE = [(0, 0), (40, 0), (40, 10), (10, 10), (10, 40), (0, 40), (0, 0)]


def slow_inside(rings, p):
    inside = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay <= p[1]) != (by <= p[1]) and p[0] < ax + (p[1] - ay) * (bx - ax) / (by - ay):
                inside = not inside
    return inside


def slow_gap(rings, p):
    def one(a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        size = dx * dx + dy * dy
        t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / size)) if size else 0.0
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    return min(one(a, b) for ring in rings for a, b in zip(ring, ring[1:]))


def test_simple_edges_turn_with_their_nodes(spark):
    e = spark.createDataFrame([(1, 5, 2, 50.0, 0.0, 20.0, 0.0, points([(50, 0), (20, 0)]), 30.0)], f"edge_id long, u long, v long, ux double, uy double, vx double, vy double, geom {G.LINE}, weight double")
    row = graphs.simple_edges(e).first()
    assert (row["u"], row["v"], row["ux"], row["vx"]) == (2, 5, 20.0, 50.0)
    assert [p["x"] for p in row["geom"]] == [20.0, 50.0]


def test_boundary_keeps_holes(spark):
    polygons = surface(spark, (box(0, 0, 20, 20), box(5, 5, 10, 10)), (box(20, 0, 10, 20),))
    length = dissolve.union_boundary(polygons, "whole").agg(F.sum(G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))).first()[0]
    assert abs(length - (100 + 40)) < 1e-6
    samples = spark.createDataFrame([(k, float(x), 10.0) for k, x in enumerate([2, 8, 14, 16, 25, 31])], "k long, px double, py double")
    assert sorted(r["k"] for r in C.covered_samples(samples, polygons, ["k"]).collect()) == [0, 3, 4]


def slow_voronoi(samples):
    """Edges of the Voronoi diagram by clipping every bisector with every other sample."""
    out = []
    for i in range(len(samples)):
        for j in range(i + 1, len(samples)):
            p, q = samples[i], samples[j]
            m, d = (p + q) / 2, np.array([-(q - p)[1], (q - p)[0]])
            lo, hi = -1e6, 1e6
            for k in range(len(samples)):
                if k in (i, j):
                    continue
                w = samples[k] - p  # nearer to p than to k: 2 (m + s d - p) . w <= w . w
                a, b = 2 * (d @ w), w @ w - 2 * ((m - p) @ w)
                if abs(a) < 1e-12:
                    if b < -1e-9:
                        lo, hi = 1.0, 0.0
                        break
                elif a > 0:
                    hi = min(hi, b / a)
                else:
                    lo = max(lo, b / a)
            if hi - lo > 1e-6:
                out.append((m + lo * d, m + hi * d))
    return out


def test_voronoi_skeleton_against_clipped_bisectors():
    r = random.Random(6)
    for ring in (L_SHAPE, box(0, 0, 30, 8), [(0, 0), (25, 3), (31, 20), (12, 14), (2, 24), (0, 0)]):
        ring = np.array([(x + r.random() * 0.01, y + r.random() * 0.01) for x, y in ring[:-1]])
        ring = np.concatenate([ring, ring[:1]])
        samples = kernels.densified(ring, 3.0)
        got = kernels.voronoi_skeleton(ring, 3.0, 2.0)
        want = [(a, b) for a, b in slow_voronoi(samples) if slow_inside([ring.tolist()], a) and slow_inside([ring.tolist()], b) and 2 * slow_gap([ring.tolist()], (a + b) / 2) >= 2.0]
        size = lambda parts: sum(math.hypot(*(b - a)) for a, b in parts)
        assert abs(size(got) - size(want)) < 0.02 * size(want) and size(want) > 10


def test_reconnected_edges_against_samples(spark):
    policy = policy_for_width(8.0)
    hole = box(18, 2, 6, 6)
    rings = [L_SHAPE, hole]
    polygons = surface(spark, (L_SHAPE, hole), (box(60, 0, 10, 10),))
    pieces = dissolve.union_boundary(polygons, "whole")
    r = random.Random(3)
    rows = []
    for k in range(60):  # short stubs, mostly along the arms
        x, y = r.uniform(0, 42), r.uniform(0, 11)
        if k % 2:
            x, y = y, x
        dx, dy = (r.uniform(1, 2), r.uniform(-0.3, 0.3)) if k % 2 == 0 else (r.uniform(-0.3, 0.3), r.uniform(1, 2))
        geom = [(round(x, 3), round(y, 3)), (round(x + dx, 3), round(y + dy, 3))]
        rows.append((k, points(geom)))
    lines = spark.createDataFrame(rows, f"line_id long, geom {G.LINE}")
    edges = C.line_edges(lines).select(*C._EDGE)
    links = edits.reconnect_candidates(edges, policy)
    covered = lambda samples, keys: C.covered_samples(samples, polygons, keys)
    found = {(tuple(x["a"]), tuple(x["b"])) for x in edits.links_on_surface(links, pieces, covered, policy).collect()}
    sure = seen = 0
    for x in links.collect():
        n = 800
        at = [(x["a_x"] + (k + 0.5) / n * (x["b_x"] - x["a_x"]), x["a_y"] + (k + 0.5) / n * (x["b_y"] - x["a_y"])) for k in range(n)]
        inner = [slow_inside(rings, p) for p in at]
        share = sum(inner) / n
        reach = max((slow_gap(rings, p) for p, i in zip(at, inner) if not i), default=0.0)
        seen += 1
        if abs(share - policy.reconnect_inside_ratio) < 0.01 or abs(reach - policy.reconnect_buffer) < 0.02:
            continue
        sure += 1
        assert ((tuple(x["a"]), tuple(x["b"])) in found) == (share >= policy.reconnect_inside_ratio or reach <= policy.reconnect_buffer), (share, reach)
    assert sure > 20 and found and len(found) < seen
    whole = edits.reconnected(edges, pieces, covered, policy)
    assert whole.count() == edges.count() + len(found) and whole.columns == edges.columns


def test_separation_moves_nodes_along(spark):
    policy = policy_for_width(8.0)
    by = policy.parallel_offset_factor * policy.lane_width
    lines = spark.createDataFrame([(1, points([(0, 0), (10, 0)])), (2, points([(0, 0.5), (10, 0.5)])), (3, points([(50, 50), (50, 60)]))], f"line_id long, geom {G.LINE}")
    edges = C.line_edges(lines).select(*C._EDGE)
    out = {r["edge_id"]: r for r in C.rekeyed(edits.split_parallels(edges, policy)).collect()}
    assert (out[2]["uy"], out[2]["u"]["y"], out[2]["geom"][0]["y"]) == (round(0.5 + by, 3), round(1000 * (0.5 + by)), 0.5 + by)
    assert out[1]["uy"] == 0 and out[3]["ux"] == 50


def test_rounded_nodes_meet(spark):
    rows = [(1, points([(0, 0), (1, 0)])), (2, points([(0, 0), (1.0004, 0)])), (3, points([(0, 0), (0.0003, 0)])), (4, points([(0, 0), (0.5, 1), (1, 0)]))]
    edges = spark.createDataFrame(rows, f"edge_id long, geom {G.LINE}")
    before = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 1, 4), (4, 1, 2)], "edge_id long, u long, v long")
    assert sorted(r["edge_id"] for r in C.rejoined(edges, before).collect()) == [2, 4]


def test_bridge_directions_use_the_next_vertex(spark):
    lines = [
        (1, [(0, 0), (1, 0)]),
        (2, [(0, 0), (0, 1), (-9, 9)]),
        (3, [(0, 0), (-1, -1)]),
        (4, [(1, 0), (1, 1), (9, 2)]),
        (5, [(1, 0), (2, -2)]),
    ]
    edges = C.line_edges(spark.createDataFrame([(i, points(g)) for i, g in lines], f"line_id long, geom {G.LINE}")).select(*C._EDGE)
    assert [r["preserve"] for r in edits.guarded_bridges(edges).collect()] == [True]  # both go up at first
    assert [r["preserve"] for r in edits.guarded_bridges(edges.drop("geom")).collect()] == [False]


def test_candidates_go_round_an_island(spark):
    polygons = surface(spark, (box(0, 0, 40, 40), box(10, 10, 20, 20)))
    lines = C.candidates(polygons, dissolve.union_boundary(polygons, "whole"), policy_for_width(10.0))
    skeleton = lines.where("origin = 'voronoi'").select(F.explode("geom").alias("p")).select("p.*").collect()
    assert len(skeleton) > 50
    assert all(slow_inside([box(0, 0, 40, 40), box(10, 10, 20, 20)], (p["x"], p["y"])) for p in skeleton)


def test_opening_against_swept_discs():
    rng = np.random.default_rng(2)
    dumbbell = [(0, 0), (20, 0), (20, 9), (40, 9), (40, 0), (60, 0), (60, 20), (40, 20), (40, 11), (20, 11), (20, 20), (0, 20), (0, 0)]
    star = [(20 * math.cos(a) * (0.4 + 0.6 * (k % 2)), 20 * math.sin(a) * (0.4 + 0.6 * (k % 2))) for k, a in enumerate(np.arange(10) * math.pi / 5)]
    for rings, d, parts in (([L_SHAPE], 3.0, 1), ([dumbbell], 2.0, 2), ([[*star, star[0]]], 1.5, 1), ([box(0, 0, 30, 30), box(10, 10, 5, 5)], 2.0, 1), ([box(0, 0, 30, 7)], 4.0, 0)):
        line = offsets.joined_line([np.array(r, dtype=float) for r in rings])
        out = offsets.polygons_of(offsets.opened_rings(offsets.split_line(line), d))
        assert len(out) == parts
        low, high = np.nanmin(line, axis=0), np.nanmax(line, axis=0)
        for p in rng.uniform(low, high, (150, 2)):
            near = rng.normal(size=(4000, 2)) * d / 2 + p
            near = np.concatenate([near[((near - p) ** 2).sum(axis=1) <= (d * 0.98) ** 2], [p]])
            swept = any(slow_inside(rings, c) and slow_gap(rings, c) >= d * 1.01 for c in near[:400])
            inside = any(slow_inside([r.tolist() for r in part], p) for part in out)
            assert inside or not swept
            if inside:
                assert slow_inside(rings, p) or slow_gap(rings, p) < 0.02


def test_stable_polygons():
    spike = [(0, 0), (30, 0), (30, 10), (16, 10), (15.1, 25), (15, 25), (14, 10), (0, 10), (0, 0)]
    found = offsets.stable_polygons(np.array(spike, dtype=float), 0.5, 0.3, 3.0)
    assert len(found) == 1 and found[0][0][:, 1].max() < 20 and offsets.area(found[0][0]) > 290
    assert offsets.stable_polygons(np.array(box(0, 0, 30, 2), dtype=float), 0.5, 0.3, 3.0) == []
    bow = np.array([(0, 0), (4, 0), (0, 0.02), (4, 0.04), (4, 4), (0, 4), (0, 0)], dtype=float)
    assert not offsets._crosses_itself(offsets.simplified_ring(bow, 0.5))


def test_stabilized_keeps_seams(spark):
    policy = policy_for_width(8.0)
    df = surface(spark, (box(0, 0, 30, 8),), (box(30, 0, 30, 8),), (box(0, 50, 30, 1),), (box(100, 0, 30, 9),))
    rows = {r["poly_id"]["poly_id"]: r for r in C.stabilized(df, policy).collect()}
    size = lambda r: offsets.area(np.array([tuple(p) for p in r["ring"]]))
    assert sorted(rows) == [0, 1, 3] and size(rows[0]) == 240 and 265 < size(rows[3]) < 270
    narrow = surface(spark, (box(0, 50, 30, 1),))
    assert [r["poly_id"] for r in C.stabilized(narrow, policy).collect()] == [0]
