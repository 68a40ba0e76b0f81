"""The union's joins do not go through the driver, whatever the size of the file its polygons come from."""

from pyspark.sql import functions as F

from waylace.catalog import surfaces
from waylace.functions import geometry as G
from waylace.operators import dissolve

SIZE = "spark.sql.autoBroadcastJoinThreshold"


def joins(df):
    """Kinds of joins and broadcasts in the plan as it was run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return {w for w in ("BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin") if w in plan}


def test_union_is_not_broadcast(spark, sf_dir):
    before = spark.conf.get(SIZE)
    try:
        spark.conf.set(SIZE, "10m")
        assert joins(surfaces.polygon_union(spark, sf_dir)) == {"SortMergeJoin"}
    finally:
        spark.conf.set(SIZE, before)


def test_crowded_cell_and_covered_sides(spark):
    """Copies of a box, a box inside them and one that crosses all: only the outline stays, each piece once."""
    boxes = [(k, 0, 0, 10, 10) for k in range(30)] + [(30, 2, 2, 3, 3), (31, 8, 4, 10, 2), (32, 500, 500, 200, 1)]
    df = spark.createDataFrame(boxes, "poly_id long, x0 long, y0 long, w long, h long")
    rings = df.select("poly_id", G.box_ring(*[F.col(c).cast("double") for c in ("x0", "y0", "w", "h")]).alias("ring"))
    got = {tuple(r) for r in dissolve.union_boundary(rings).collect()}
    outline = {(0, 0, 10, 0), (0, 0, 0, 10), (0, 10, 10, 10), (10, 0, 10, 4), (10, 6, 10, 10), (10, 4, 18, 4), (10, 6, 18, 6), (18, 4, 18, 6)}
    assert got == outline | {(500, 500, 700, 500), (500, 501, 700, 501), (500, 500, 500, 501), (700, 500, 700, 501)}


def test_boxes_are_compared_before_rings(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 0.0)])], f"poly_id long, ring {G.LINE}")
    plan = dissolve.union_boundary(df)._jdf.queryExecution().optimizedPlan().toString()
    (join,) = [line for line in plan.splitlines() if "Join Inner" in line and "aggregate(" in line]
    assert all(join.index(c) < join.index("aggregate(") for c in ("_lx1", "_rx2", "_ly1", "_ry2"))
