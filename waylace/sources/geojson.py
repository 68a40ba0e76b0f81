"""GeoJSON features, thresholds and results as JSON."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waylace.functions import geometry as G
from waylace.operators.quality_gates import Thresholds

#: Coordinates of any depth stay text until the type is known.
_FEATURES = "features array<struct<geometry: struct<type: string, coordinates: string>>>"
_PAIRS = "array<array<double>>"


def read_geometries(spark: SparkSession, path: str) -> DataFrame:
    """``(feature, type, parts)``: lines or rings of every feature of a GeoJSON file; points and null geometries have none."""
    rows = spark.read.schema(_FEATURES).option("multiLine", True).json(path).select(F.posexplode("features").alias("feature", "f")).select("feature", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    one, two, three = (F.from_json("c", k) for k in (_PAIRS, f"array<{_PAIRS}>", f"array<array<{_PAIRS}>>"))
    raw = F.when(F.col("type") == "LineString", F.array(one)).when(F.col("type").isin("MultiLineString", "Polygon"), two).when(F.col("type") == "MultiPolygon", F.flatten(three))
    parts = F.transform(raw, lambda line: F.transform(line, lambda p: G.point(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))
    return rows.select("feature", "type", parts.alias("parts"))


def read_thresholds(spark: SparkSession, path: str) -> Thresholds:
    """Thresholds from a JSON object; absent ones keep their defaults."""
    kinds = {float: "double", int: "long", bool: "boolean"}
    schema = ", ".join(f"{f.name} {kinds[type(f.default)]}" for f in fields(Thresholds))
    row = spark.read.schema(schema).option("multiLine", True).json(path).first()
    return Thresholds(**{k: v for k, v in row.asDict().items() if v is not None}) if row else Thresholds()


def evaluation_json(checks: DataFrame) -> DataFrame:
    """One column ``value``: ``{"metrics": ..., "checks": ..., "passed": ...}``."""
    metrics = ("component_count", "leaf_count", "branch_count", "total_length", "length_change_rate", "outside_ratio", "parallel_pair_found")
    gates = ("max_components", "min_leaf_count", "max_branch_count", "max_length_change_rate", "max_outside_ratio", "parallel_pair_required")
    return checks.select(F.to_json(F.struct(F.struct(*metrics).alias("metrics"), F.struct(*gates).alias("checks"), "passed")).alias("value"))
