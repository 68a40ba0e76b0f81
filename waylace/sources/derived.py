"""Geometry tables derived from the relational test tables.

The test tables have no geometry, so boxes come from ``part``, a road network
from ``customer`` and polylines from ``events``.  Coordinates of boxes and
nodes lie on a quarter-metre grid, which is exact in binary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def polys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-aligned boxes ``(poly_id, x0, y0, w, h)``; neighbours touch where w is 24."""
    key, size = F.col("p_partkey"), F.col("p_size")
    wide = key % 7 == 0
    return table(spark, sf_dir, "part").select(
        key.alias("poly_id"),
        ((key % 40) * 24.0).alias("x0"),
        (F.floor(key / 40.0) * 90.0).alias("y0"),
        F.when(wide, 24.0).otherwise(4.0 + size % 21).alias("w"),
        F.when(wide, 6.0 + size % 10).otherwise(20.0 + size).alias("h"),
    )


def net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge list ``(edge_id, u, v)``: a forest, with self-loops at its roots."""
    key = F.col("c_custkey")
    parent = F.when(key % 97 == 0, key).otherwise(F.greatest(F.lit(0).cast("long"), key - 1 - F.col("c_nationkey") % 5))
    return table(spark, sf_dir, "customer").select(key.alias("edge_id"), key.alias("u"), parent.cast("long").alias("v"))


def node_x(n: Column) -> Column:
    return (n % 40) + (n * 7 % 13) * 0.25


def node_y(n: Column) -> Column:
    return F.floor(n / 40.0) + (n * 11 % 17) * 0.25


def node_radius(n: Column) -> Column:
    return 0.1 + (n * 13 % 40) * 0.05


def edges(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    """``net`` without self-loops, with end coordinates and ``weight``, the straight length."""
    rows = net(spark, sf_dir).where("u <> v").select(
        "edge_id",
        "u",
        "v",
        (node_x(F.col("u")) * scale).alias("ux"),
        (node_y(F.col("u")) * scale).alias("uy"),
        (node_x(F.col("v")) * scale).alias("vx"),
        (node_y(F.col("v")) * scale).alias("vy"),
    )
    dx, dy = F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy")
    return rows.withColumn("weight", F.sqrt(dx * dx + dy * dy))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polyline vertices ``(line_id, seq, x, y)`` from a user's events in order of time."""
    window = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seq = F.row_number().over(window)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("line_id"), seq.alias("seq"), seq.cast("double").alias("x"), (F.col("value") / 10.0).alias("y"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(line_id, geom)`` with ``geom`` an array of (x, y) in order."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    return vertices(spark, sf_dir).groupBy("line_id").agg(F.transform(ordered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("geom"))


#: The same tables as DuckDB common table expressions.
ORACLE = {
    "polys": """polys AS (SELECT p_partkey AS poly_id, (p_partkey % 40) * 24.0::DOUBLE AS x0, floor(p_partkey / 40.0) * 90.0::DOUBLE AS y0,
        CASE WHEN p_partkey % 7 = 0 THEN 24.0 ELSE 4.0 + p_size % 21 END::DOUBLE AS w,
        CASE WHEN p_partkey % 7 = 0 THEN 6.0 + p_size % 10 ELSE 20.0 + p_size END::DOUBLE AS h FROM part)""",
    "net": """net AS (SELECT c_custkey AS edge_id, c_custkey AS u,
        CASE WHEN c_custkey % 97 = 0 THEN c_custkey ELSE greatest(0, c_custkey - 1 - c_nationkey % 5) END AS v FROM customer)""",
    "edges": """edges AS (SELECT *, sqrt((ux - vx) * (ux - vx) + (uy - vy) * (uy - vy)) AS weight FROM (SELECT edge_id, u, v,
        ((u % 40) + (u * 7 % 13) * 0.25::DOUBLE)::DOUBLE AS ux, (floor(u / 40.0) + (u * 11 % 17) * 0.25)::DOUBLE AS uy,
        ((v % 40) + (v * 7 % 13) * 0.25::DOUBLE)::DOUBLE AS vx, (floor(v / 40.0) + (v * 11 % 17) * 0.25)::DOUBLE AS vy FROM net WHERE u <> v))""",
    "vertices": """vertices AS (SELECT user_id AS line_id, seq, seq::DOUBLE AS x, value / 10.0::DOUBLE AS y FROM
        (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events))""",
    "degree": "degree AS (SELECT n, count(*) AS d FROM (SELECT u AS n FROM edges UNION ALL SELECT v FROM edges) GROUP BY n)",
}


def with_tables(*names: str) -> str:
    """``WITH`` clause that defines these tables, for an oracle query."""
    return "WITH " + ",\n".join(ORACLE[n] for n in names)
