"""Diagnostics, validation and evaluation of a network."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylace.functions import geometry as G
from waylace.functions import graphs
from waylace.operators import edits, nearest, ranks
from waylace.operators.selection import covered_points, sample_count
from waylace.operators.spatial import near_pairs
from waylace.plans.components import connected_components
from waylace.plans.scratch import materialize

SAMPLES = 5
RISK_DISTANCE = 0.25
RISK_LENGTH = 3.0
TOUCH_TOLERANCE = 0.5


PERCENTILES = {"p1": 0.01, "p5": 0.05, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def describe(df: DataFrame, column: str) -> DataFrame:
    """Mean, sample deviation, extremes and interpolated percentiles of a column's values, as one row; nulls are left out."""
    c = F.col(column)
    values = df.where(c.isNotNull())
    row = values.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    n = row.first()["n"]
    found = ranks.quantiles(values, column, list(PERCENTILES.values()), n) if n else [None] * len(PERCENTILES)
    return row.select("*", *[F.lit(v).cast("double").alias(k) for k, v in zip(PERCENTILES, found, strict=True)])


def straight_samples(edges: DataFrame, n: Column) -> DataFrame:
    """``edge_id, n, i, px, py``: points at equal steps along straight edges, both ends included."""
    rows = edges.withColumn("n", n.cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("i") / (F.col("n") - 1)
    at = lambda c: F.col(f"u{c}") + t * (F.col(f"v{c}") - F.col(f"u{c}"))
    return rows.select("edge_id", "n", "i", at("x").alias("px"), at("y").alias("py"))


def edge_diagnostics(edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """``edge_id, length_m, min_bd_m, deg_u, deg_v, is_leaf_edge, is_chain_edge``."""
    near = nearest.nearest_boundary(straight_samples(edges, F.lit(SAMPLES)), boxes, ["edge_id", "i"])
    least = near.groupBy("edge_id").agg(F.min("dist").alias("min_bd_m"))
    rows = graphs.with_degrees(edges).join(least, "edge_id", "left")
    return rows.select(
        "edge_id",
        F.col("weight").alias("length_m"),
        "min_bd_m",
        "deg_u",
        "deg_v",
        (F.least("deg_u", "deg_v") == 1).alias("is_leaf_edge"),
        (F.greatest("deg_u", "deg_v") <= 2).alias("is_chain_edge"),
    )


def near_counts(diagnostics: DataFrame, distance: float = RISK_DISTANCE) -> DataFrame:
    near = F.col("min_bd_m") < distance
    return diagnostics.agg(F.count_if(near).alias("near"), F.count_if(near & F.col("is_leaf_edge")).alias("leaf_near"), F.count_if(near & F.col("is_chain_edge")).alias("chain_near"))


def risk_report(diagnostics: DataFrame, top: int = 20, distance: float = RISK_DISTANCE, length: float = RISK_LENGTH) -> DataFrame:
    """The short edges nearest to the boundary."""
    return diagnostics.where((F.col("min_bd_m") < distance) & (F.col("length_m") < length)).orderBy("min_bd_m", "length_m", "edge_id").limit(top)


def graph_summary(edges: DataFrame) -> DataFrame:
    """Nodes, edges, components and degree classes, as one row."""
    d = F.col("degree")
    degrees = graphs.node_degree(edges).agg(F.count("*").alias("nodes"), F.count_if(d == 1).alias("d1"), F.count_if(d == 2).alias("d2"), F.count_if(d >= 3).alias("d3_plus"))
    parts = connected_components(edges, "u", "v").agg(F.count_distinct("root").alias("components"))
    return degrees.crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(parts)  # three single rows


def component_sizes(edges: DataFrame) -> DataFrame:
    """``root, nodes``, largest first."""
    return connected_components(edges, "u", "v").groupBy("root").agg(F.count("*").alias("nodes")).orderBy(F.desc("nodes"), "root")


def connectivity(edges: DataFrame) -> DataFrame:
    """One row: number of components and whether the network is whole."""
    return component_sizes(edges).agg(F.count("*").alias("components"), (F.count("*") <= 1).alias("connected"), F.max("nodes").alias("largest"))


def open_terminals(edges: DataFrame, boxes: DataFrame, tolerance: float = TOUCH_TOLERANCE) -> DataFrame:
    """``n, dist`` of nodes of degree 1 that lie farther than ``tolerance`` from the boundary."""
    leaves = edits.endpoint_headings(edges).select("n", F.col("x").alias("px"), F.col("y").alias("py"))
    return nearest.nearest_boundary(leaves, boxes, ["n"]).where(F.col("dist") > tolerance)


def first_errors(errors: DataFrame, order: list[str], most: int) -> DataFrame:
    """Only so many errors are listed."""
    return errors.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= most)


def outside_ratio(edges: DataFrame, boxes: DataFrame, step: float = 1.0) -> DataFrame:
    """One row: the share of samples along straight edges that no box covers; 0 without samples."""
    samples = straight_samples(edges.where("weight > 0"), sample_count(F.col("weight"), step, 2))
    covered = covered_points(samples, boxes, ["edge_id", "i"]).agg(F.count("*").alias("inside"))
    total = samples.agg(F.count("*").alias("samples"))
    ratio = F.coalesce(F.try_divide(F.col("samples") - F.col("inside"), F.col("samples")), F.lit(0.0))
    return total.crossJoin(covered).select("samples", ratio.alias("outside_ratio"))  # two single rows


@dataclass(frozen=True)
class Thresholds:
    sample_step: float = 1.0
    parallel_max_dist: float = 2.0
    parallel_max_angle_deg: float = 10.0
    max_components: int = 999_999
    min_leaf_count: int = 0
    max_branch_count: int = 999_999
    max_length_change_rate: float = 1.0
    max_outside_ratio: float = 1.0
    require_parallel_pair: bool = False


def evaluation_metrics(edges: DataFrame, boxes: DataFrame, perimeter: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """One row of metrics; ``perimeter`` is one row ``(perimeter)``, the length of the surface's whole boundary."""
    d = F.col("degree")
    counts = graphs.node_degree(edges).agg(F.count_if(d == 1).alias("leaf_count"), F.count_if(d >= 3).alias("branch_count"))
    parts = connected_components(edges, "u", "v").agg(F.count_distinct("root").alias("component_count"))
    length = edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_length"))
    rate = F.coalesce(F.try_divide(F.abs(F.col("total_length") - F.col("perimeter")), F.col("perimeter")), F.lit(0.0))
    outside = outside_ratio(edges, boxes, thresholds.sample_step).select("outside_ratio")
    pair = edits.has_parallel_pair(edges, thresholds.parallel_max_dist, thresholds.parallel_max_angle_deg).select(F.col("found").alias("parallel_pair_found"))
    row = counts
    for more in (parts, length, perimeter, outside, pair):  # each is a single row
        row = row.crossJoin(more)
    return row.withColumn("length_change_rate", rate).drop("perimeter")


def evaluation_checks(metrics: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """The metrics with a column for each gate and ``passed``."""
    gates = {
        "max_components": F.col("component_count") <= thresholds.max_components,
        "min_leaf_count": F.col("leaf_count") >= thresholds.min_leaf_count,
        "max_branch_count": F.col("branch_count") <= thresholds.max_branch_count,
        "max_length_change_rate": F.col("length_change_rate") <= thresholds.max_length_change_rate,
        "max_outside_ratio": F.col("outside_ratio") <= thresholds.max_outside_ratio,
        "parallel_pair_required": F.lit(not thresholds.require_parallel_pair) | F.col("parallel_pair_found"),
    }
    every = F.lit(True)
    for gate in gates:
        every = every & F.col(gate)
    return metrics.withColumns(gates).withColumn("passed", every)


def expired_logs(names: DataFrame, today: Column, keep_days: int = 3) -> DataFrame:
    """Names ``Log_YYYYMMDD...`` older than ``keep_days``; names without a date are never listed."""
    day = F.try_to_timestamp(F.regexp_extract("name", "^Log_([0-9]{8})", 1), F.lit("yyyyMMdd")).cast("date")
    return names.where(F.datediff(today, day) > keep_days)


def box_dissolve_perimeter(boxes: DataFrame) -> DataFrame:
    """One row ``(perimeter)``: boundary length of the union of boxes that at most touch."""
    side = lambda p: boxes.select(F.col("poly_id").alias(f"{p}id"), *[F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "w", "h")])
    box = lambda p: (F.col(f"{p}x0"), F.col(f"{p}y0"), F.col(f"{p}x0") + F.col(f"{p}w"), F.col(f"{p}y0") + F.col(f"{p}h"))
    shared = near_pairs(side("a_"), side("b_"), box("a_"), box("b_"), 0.0, 64.0, F.col("a_id") < F.col("b_id")).agg(F.coalesce(F.sum(G.box_shared_boundary("a_", "b_")), F.lit(0.0)).alias("shared"))
    whole = boxes.agg(F.coalesce(F.sum(2 * (F.col("w") + F.col("h"))), F.lit(0.0)).alias("whole"))
    return whole.crossJoin(shared).select((F.col("whole") - 2 * F.col("shared")).alias("perimeter"))  # two single rows


def report(edges: DataFrame, boxes: DataFrame, scan_cap: int | None = None) -> dict[str, DataFrame]:
    """All diagnostics by name: ``graph``, ``lengths`` and, with a boundary, ``boundary``, ``near`` and ``risks``.

    ``scan_cap`` leaves the boundary part out for larger networks; by default
    there is no cap.  No edges give no tables.
    """
    n = edges.count()
    if not n:
        return {}
    out = {"graph": graph_summary(edges), "lengths": describe(edges, "weight")}
    if boxes.isEmpty() or scan_cap is not None and n > scan_cap:
        return out
    diagnostics = materialize(edge_diagnostics(edges, boxes), "diagnostics")
    return out | {"boundary": describe(diagnostics, "min_bd_m"), "near": near_counts(diagnostics), "risks": risk_report(diagnostics)}


MOST_ERRORS = 5
MOST_TERMINAL_ERRORS = 3


def validate(edges: DataFrame, boxes: DataFrame, tolerance: float = TOUCH_TOLERANCE) -> DataFrame:
    """``(check, detail)``: at most five errors, of which at most three are terminals off the boundary; none if all is well."""
    whole = connectivity(edges).where("components > 1").select(F.lit("connectivity").alias("check"), F.concat("components", F.lit(" components, largest "), "largest").alias("detail"))
    ends = first_errors(open_terminals(edges, boxes, tolerance), ["n"], MOST_TERMINAL_ERRORS)
    off = ends.select(F.lit("terminal").alias("check"), F.concat(F.lit("node "), F.col("n").cast("string"), F.lit(" is "), F.round("dist", 3), F.lit(" m off")).alias("detail"))
    return whole.unionByName(off).orderBy("check", "detail").limit(MOST_ERRORS)
