import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waylace.functions import geometry as G
from waylace.functions import kernels, offsets
from waylace.operators import dissolve
from waylace.operators.spatial import near_pairs
from waylace.plans.policy import Settings, load_settings, policy_for_width, upper_median
from waylace.sources import geojson, shapefile, snapshots


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def lines(spark, *rows):
    return spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in g]) for i, g in enumerate(rows)], f"line_id long, geom {G.LINE}")


def one(df, column):
    return df.select(column.alias("v")).first()["v"]


def test_short_lines_collapse_under_the_average(spark):
    for n in (2, 3):
        df = lines(spark, [(k, k % 2) for k in range(n)])
        assert one(df, G.line_length(G.moving_average(F.col("geom")))) < 1e-12
    assert one(lines(spark, [(k, 0) for k in range(6)]), G.line_length(G.moving_average(F.col("geom")))) > 2


def test_round_line_and_ends(spark):
    df = lines(spark, [(0, 0), (0.0001, 0), (1, 0), (1.0002, 0), (2, 0)])
    assert [tuple(p) for p in one(df, G.round_line(F.col("geom")))] == [(0, 0), (1, 0), (2, 0)]
    assert [tuple(p) for p in one(lines(spark, [(0, 0), (0.0001, 0)]), G.round_line(F.col("geom")))] == [(0, 0), (0.0001, 0)]


def test_merge_lines(spark):
    a, b = [(0, 0), (1, 0)], [(1, 0), (2, 5)]
    for left, right, want in [(a, b, [(0, 0), (1, 0), (2, 5)]), (a, b[::-1], [(0, 0), (1, 0), (2, 5)]), (a[::-1], b, [(2, 5), (1, 0), (0, 0)]), (a[::-1], b[::-1], [(2, 5), (1, 0), (0, 0)])]:
        df = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in left], [{"x": float(x), "y": float(y)} for x, y in right])], f"a {G.LINE}, b {G.LINE}")
        assert [tuple(p) for p in one(df, G.merge_lines(F.col("a"), F.col("b")))] == want


def test_grid_join_finds_each_pair_once(spark):
    r = np.random.default_rng(5)
    rows = [(int(i), *map(float, x)) for i, x in enumerate(np.concatenate([r.uniform(-50, 50, (80, 2)), r.uniform(0, 30, (80, 2))], axis=1))]
    df = spark.createDataFrame(rows, "i long, x double, y double, w double, h double")
    side = lambda p: df.select(*[F.col(c).alias(p + c) for c in df.columns])
    b = lambda p: (F.col(p + "x"), F.col(p + "y"), F.col(p + "x") + F.col(p + "w"), F.col(p + "y") + F.col(p + "h"))
    got = sorted((x["a_i"], x["b_i"]) for x in near_pairs(side("a_"), side("b_"), b("a_"), b("b_"), 2.0, 8.0, F.col("a_i") < F.col("b_i")).collect())
    want = [(i, j) for i, x1, y1, w1, h1 in rows for j, x2, y2, w2, h2 in rows if i < j and x1 - 2 <= x2 + w2 and x2 <= x1 + w1 + 2 and y1 - 2 <= y2 + h2 and y2 <= y1 + h1 + 2]
    assert got == want


def test_smallest_rectangle():
    t = math.radians(30)
    turn = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
    width, length, ax, ay = kernels.smallest_rectangle(np.array(box(0, 0, 40, 8)) @ turn)
    assert (width, length) == pytest.approx((8, 40)) and abs(ax * math.cos(t) + ay * math.sin(t)) == pytest.approx(1)
    assert kernels.smallest_rectangle(np.array([[0, 0], [1, 1], [2, 2]])) is None


def test_simplify_keeps_ends():
    line = np.array([[0, 0], [1, 0.01], [2, 0], [3, 2], [4, 0]])
    assert kernels.simplify(line, 0.1).tolist() == [[0, 0], [2, 0], [3, 2], [4, 0]]
    assert kernels.simplify(line, 9.0).tolist() == [[0, 0], [4, 0]]


def test_delaunay_circles_are_empty():
    points = np.random.default_rng(1).random((60, 2)) * 10
    tri, centre = kernels.delaunay(points)
    for t, c in zip(tri, centre, strict=True):
        gaps = np.hypot(*(points - c).T)
        assert gaps.min() > gaps[t[0]] - 1e-4
    corners = kernels.convex_hull(points)
    assert len(tri) == 2 * len(points) - 2 - len(corners)


def test_skeleton_of_a_bar():
    parts = kernels.voronoi_skeleton(np.array(box(0, 0, 40, 8), dtype=float), 0.5, 3.0)
    middle = [p for p in parts if abs(p[:, 1] - 4).max() < 1e-3]
    assert sum(np.hypot(*(p[1] - p[0])) for p in middle) == pytest.approx(32, abs=1.5)


def test_opening():
    ring = np.array(box(0, 0, 20, 10), dtype=float)
    out = offsets.opened_rings(offsets.split_line(ring[::-1]), 2.0)
    assert len(out) == 1 and offsets.area(out[0]) == pytest.approx(200 - (4 - math.pi) * 4, abs=0.03)
    assert offsets.opened_rings(offsets.split_line(ring), 6.0) == []


def test_union_drops_shared_sides(spark):
    rows = [(1, box(0, 0, 10, 10)), (2, box(10, 0, 10, 10)), (3, box(5, 5, 10, 10)), (4, box(100, 0, 5, 5))]
    df = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in g]) for i, g in rows], f"poly_id long, ring {G.LINE}")
    pieces = dissolve.union_boundary(df)
    length = one(pieces.agg(F.sum(G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).alias("n")), F.col("n"))
    assert length == pytest.approx(20 + 15 + 20 + 15 + 20 - 20 + 20)


def test_upper_median(spark):
    for values, want in [([1, 2, 3, 10], 3), ([5], 5), ([0, -1], None), ([4, 4, 1, 9, 9], 4), (list(range(1, 1001)), 501)]:
        assert upper_median(spark.createDataFrame([(float(v),) for v in values], "width double"), "width") == want


def test_policy_and_settings(tmp_path):
    urban, rural = policy_for_width(None), policy_for_width(12.0)
    assert (urban.profile, urban.median_width, rural.profile) == ("urban", 8.0, "rural")
    assert urban.lane_width == 1.4 and rural.prune_ratio == 1.8 and policy_for_width(100).lane_width == 3.5
    (tmp_path / ".env").write_text("GIS_TOPOLOGY_JUNCTION_MIN_DEGREE=4\n# note\nGIS_DEBUG_EXPORT_INTERMEDIATE=true\n")
    found = load_settings({"GIS_TOPOLOGY_JUNCTION_MIN_DEGREE": "5"}, str(tmp_path / ".env"))
    assert found.topology_junction_min_degree == 5 and found.debug_export_intermediate
    with pytest.raises(ValueError):
        Settings(topology_intersection_parallel_angle_deg=91.0)


def test_shapefile_round_trip(spark, tmp_path):
    shapefile.register(spark)
    df = lines(spark, [(0, 0), (1, 2)], [(5, 5), (6, 6), (7, 5)])
    df.select("geom").coalesce(1).write.format("waylace_shp").mode("overwrite").save(str(tmp_path / "out"))
    path = next(str(p) for p in (tmp_path / "out").iterdir() if p.suffix == ".shp")
    back = spark.read.format("waylace_shp").load(path)
    assert back.columns == ["shape_id", "kind", "parts", "FID"]
    assert [([[tuple(p) for p in part] for part in r["parts"]], r["FID"]) for r in back.orderBy("shape_id").collect()] == [([[(0, 0), (1, 2)]], 0), ([[(5, 5), (6, 6), (7, 5)]], 1)]
    assert back.select("FID").collect()[1][0] == 1
    with pytest.raises(shapefile.UnfitFile):
        shapefile.check_source(str(tmp_path / "x.txt"))
    (tmp_path / "deg.shp").write_bytes(b"\0" * 200)
    (tmp_path / "deg.prj").write_text('GEOGCS["x",UNIT["degree",0.0174]]')
    with pytest.raises(shapefile.UnfitFile):
        shapefile.check_source(str(tmp_path / "deg.shp"))
    assert shapefile.epsg_of('PROJCS["a",AUTHORITY["EPSG","4326"],AUTHORITY["EPSG","5186"]]') == 5186 and shapefile.epsg_of("none") is None


def test_geojson(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type":"FeatureCollection","features":[{"geometry":{"type":"LineString","coordinates":[[0,0],[1,2]]}},{"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]]]}},{"geometry":null}]}')
    rows = geojson.read_geometries(spark, str(tmp_path / "a.json")).orderBy("feature").collect()
    assert [[[tuple(p) for p in part] for part in r["parts"] or []] for r in rows] == [[[(0, 0), (1, 2)]], [[(0, 0), (1, 0), (1, 1), (0, 0)]], []]
    (tmp_path / "t.json").write_text('{"max_components": 3, "require_parallel_pair": true}')
    t = geojson.read_thresholds(spark, str(tmp_path / "t.json"))
    assert (t.max_components, t.require_parallel_pair, t.sample_step) == (3, True, 1.0)


def test_snapshots(spark, tmp_path):
    df = lines(spark, [(0, 0), (1, 2)])
    assert snapshots.result_path("/b/", "/x/road.shp") == "/b/Result/road_centerline"
    path = snapshots.save_stage(df, f"file://{tmp_path}/road", "01_skeleton")
    assert spark.read.parquet(path).columns == ["geom"]
    assert snapshots.save_stage(df.where("false"), f"file://{tmp_path}/road", "02_planarized") is None
    assert snapshots.save_stage(df, f"file://{tmp_path}/road", "03_cleaned", enabled=False) is None
