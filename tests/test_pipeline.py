from pyspark.sql import functions as F

from waylace.functions import geometry as G
from waylace.plans.centerlines import centerlines
from waylace.streaming.incremental import run_by_tiles, with_tiles


def polygons(spark, *rings):
    rows = [(i, [{"x": float(x), "y": float(y)} for x, y in r] if r is not None else None) for i, r in enumerate(rings)]
    return spark.createDataFrame(rows, f"poly_id long, ring {G.LINE}")


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def test_bar_has_one_centreline(spark):
    result = centerlines(polygons(spark, box(0, 0, 80, 8), None))
    rows = result.network.collect()
    assert result.policy.profile == "urban" and result.stages["input"] == 1
    length = sum(r["weight"] for r in rows)
    assert 60 < length < 90
    part = result.network.select(F.explode(G.segments(F.col("geom"))).alias("s"))
    size = G.distance(F.col("s.a.x"), F.col("s.a.y"), F.col("s.b.x"), F.col("s.b.y"))
    middle = (F.abs(F.col("s.a.y") - 4) < 0.6) & (F.abs(F.col("s.b.y") - 4) < 0.6)
    whole, kept = part.agg(F.sum(size), F.sum(F.when(middle, size))).first()
    assert kept / whole > 0.8


def test_tiles_stream(spark, tmp_path):
    df = polygons(spark, box(0, 0, 10, 10), box(510, 0, 10, 10))
    assert with_tiles(df).count() == 3
    source = str(tmp_path / "in")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    count = lambda known: known.groupBy("tx", "ty").agg(F.count("*").alias("n"))
    query = run_by_tiles(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "check"), count)
    query.awaitTermination(60)
    query.stop()
    assert sorted((r["tx"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 2), (1, 1)]
