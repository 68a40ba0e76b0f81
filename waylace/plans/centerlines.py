"""The whole way from road polygons to a clean centreline network."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylace.functions import along, graphs, kernels, offsets
from waylace.functions import geometry as G
from waylace.operators import dissolve, edits, nearest, pruning, selection
from waylace.operators.spatial import near_pairs
from waylace.plans.policy import Policy, Settings, policy_from_widths
from waylace.plans.scratch import materialize

FORK_REACH = 0.8
#: How far around a ring its skeleton looks, in median widths.
HALO_WIDTHS = 2.0


@dataclass(frozen=True)
class Result:
    policy: Policy
    skeleton: DataFrame
    network: DataFrame
    stages: dict[str, int]


def node(p: Column) -> Column:
    """The node of a point: whole millimetres."""
    return F.struct(G.millimetres(p["x"]).alias("x"), G.millimetres(p["y"]).alias("y"))


def line_edges(lines: DataFrame) -> DataFrame:
    """Lines ``(line_id, geom)`` as edges between the nodes of their ends; loops and null lines go."""
    first, last = F.element_at("geom", 1), F.element_at("geom", -1)
    rows = lines.where("geom is not null and size(geom) >= 2").select(
        F.col("line_id").alias("edge_id"), node(first).alias("u"), node(last).alias("v"), "geom", G.line_length(F.col("geom")).alias("weight")
    )
    at = lambda n, c: (F.col(n)[c] / 1000.0).alias(f"{n}{c}")
    return rows.where("u <> v").select("edge_id", "u", "v", at("u", "x"), at("u", "y"), at("v", "x"), at("v", "y"), "geom", "weight")


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with ids that depend on their course alone."""
    return lines.select(F.xxhash64(F.to_json("geom")).alias("line_id"), "geom").dropDuplicates(["line_id"])


def candidates(polygons: DataFrame, boundary: DataFrame, policy: Policy) -> DataFrame:
    """``(line_id, origin, geom)``: the surface's Voronoi skeleton, and lines through paired boundary samples.

    The skeleton is made ring by ring from the boundary of the whole surface
    around it; an edge belongs to the ring that holds its middle.  The halo is
    wide enough where the surface is at most twice as wide as it.  Pairing needs
    a surface's whole ring, so it is done for rings that no other one touches.
    """
    halo = HALO_WIDTHS * policy.median_width
    box = (F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by"))
    rings = polygons.select("poly_id", "ring", "whole")
    near = near_pairs(boundary, rings, box, dissolve.ring_box(F.col("ring")), halo, max(64.0, 2 * halo))
    around = near.groupBy("poly_id").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("pieces"))  # one ring's surroundings
    voronoi = kernels.surface_skeleton(rings.join(around, "poly_id"), policy.voronoi_step, policy.lane_width, "whole")
    step = max(policy.pair_step, policy.boundary_step_floor)
    pairs = kernels.pair_lines(rings.join(beside(polygons), "poly_id", "left_anti"), step, policy.axis_bin, policy.lane_width, policy.axis_bin * policy.pair_break_bins)
    lines = lambda df: _numbered(df.select(F.explode("parts").alias("geom")).select(G.round_line(F.col("geom")).alias("geom")))
    return lines(voronoi).withColumn("origin", F.lit("voronoi")).unionByName(lines(pairs).withColumn("origin", F.lit("boundary_pair")))


def beside(polygons: DataFrame) -> DataFrame:
    """``poly_id`` of polygons whose boxes meet another's."""
    rings = polygons.select("poly_id", "ring")
    other = polygons.select(F.col("poly_id").alias("other_id"), F.col("ring").alias("other_ring"))
    return near_pairs(rings, other, dissolve.ring_box(F.col("ring")), dissolve.ring_box(F.col("other_ring")), 0.0, 64.0, F.col("poly_id") != F.col("other_id")).select("poly_id").distinct()


def stabilized(polygons: DataFrame, policy: Policy) -> DataFrame:
    """Polygons opened and simplified, without parts narrower than a lane; all as they are if none would be left.

    Polygons beside others stay as they are: opened one by one they would get
    notches along their seams.
    """
    touching = materialize(beside(polygons), "beside")
    lone = polygons.join(touching, "poly_id", "left_anti")
    parts = offsets.with_stable(lone, policy.protrusion, policy.sharp_simplify, policy.lane_width).select("poly_id", F.posexplode("parts").alias("part", "p"))
    stable = parts.select(F.struct("poly_id", "part").alias("poly_id"), "p.ring", "p.whole")
    seams = polygons.join(touching, "poly_id", "left_semi").select(F.struct("poly_id", F.lit(0).alias("part")).alias("poly_id"), "ring", "whole")
    out = materialize(stable.unionByName(seams), "stable")
    return polygons if out.isEmpty() else out


def covered_samples(samples: DataFrame, polygons: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of the samples inside some ring or within a millimetre of it, once each."""
    at = (F.col("px"), F.col("py"), F.col("px"), F.col("py"))
    pairs = near_pairs(samples, polygons.select(F.col("whole").alias("_ring")), at, dissolve.ring_box(F.col("_ring")), 0.001, 64.0)
    px, py = F.col("px"), F.col("py")
    on = F.exists(G.segments(F.col("_ring")), lambda s: G.point_segment_distance(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]) <= 0.001)
    return pairs.where(on | dissolve.ring_contains(F.col("_ring"), px, py)).select(*keys).distinct()


def scored(lines: DataFrame, polygons: DataFrame, policy: Policy) -> DataFrame:
    """``lines`` with ``score``."""
    samples = selection.line_samples(lines, max(policy.selector_step, 0.1), 3)
    hits = covered_samples(samples, polygons, ["line_id", "i", "n"]).groupBy("line_id", "n").agg((F.count("*") / F.first("n")).alias("inside"))
    score = 0.55 * F.coalesce("inside", F.lit(0.0)) + 0.25 * (1 - G.curvature_penalty(F.col("geom"))) + 0.20 * selection.length_score(G.line_length(F.col("geom")), policy)
    return lines.join(hits.select("line_id", "inside"), "line_id", "left").withColumn("score", G.clamp(score, 0, 1)).drop("inside")


def boundary_distance(points: DataFrame, boundary: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """``keys, dist``: least distance to a boundary piece, where that is at most ``reach``."""
    at = (F.col("px"), F.col("py"), F.col("px"), F.col("py"))
    box = (F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by"))
    pairs = near_pairs(points, boundary, at, box, reach, max(16.0, 2 * reach))
    d = G.point_segment_distance(F.col("px"), F.col("py"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return pairs.groupBy(*keys).agg(F.min(d).alias("dist")).where(F.col("dist") <= reach)


def node_radii(edges: DataFrame, boundary: DataFrame) -> DataFrame:
    """``(n, radius)``: distance of each node to the boundary, with its floor; exact by rounds of growing reach."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("ux").alias("px"), F.col("uy").alias("py")), F.struct(F.col("v").alias("n"), F.col("vx").alias("px"), F.col("vy").alias("py"))))
    left = materialize(edges.select(ends.alias("p")).select("p.*").distinct(), "nodes")
    reach, found = nearest.FIRST_REACH, left.select("n", F.lit(0.0).alias("dist")).where("false")
    if boundary.isEmpty():
        return left.select("n", F.lit(pruning.MIN_RADIUS).alias("radius"))
    while not left.isEmpty():
        here = materialize(boundary_distance(left, boundary, ["n"], reach), "radii")
        found = found.unionByName(here)
        left = materialize(left.join(here, "n", "left_anti"), "nodes")
        reach *= nearest.GROWTH
    return found.select("n", F.greatest("dist", F.lit(pruning.MIN_RADIUS)).alias("radius"))


_EDGE = ("edge_id", "u", "v", *edits.XY, "geom", "weight")


def rekeyed(edges: DataFrame) -> DataFrame:
    """Edges between the nodes of their courses' ends; loops go."""
    return line_edges(edges.select(F.col("edge_id").alias("line_id"), "geom")).select(*_EDGE)


def rejoined(edges: DataFrame, before: DataFrame) -> DataFrame:
    """:func:`rekeyed` edges; of several whose nodes were different ``before`` and are the same now the last stays."""
    pair = [F.least("u", "v"), F.greatest("u", "v")]
    nth = F.row_number().over(Window.partitionBy(*pair).orderBy("edge_id"))  # courses beside each other between two nodes stay apart
    numbered = rekeyed(edges).join(before.select("edge_id", nth.alias("nth")), "edge_id")
    last = numbered.groupBy(pair[0].alias("p"), pair[1].alias("q"), "nth").agg(F.max_by(F.struct(*_EDGE), "edge_id").alias("last"))
    return last.select("last.*")


def separated_and_reconnected(edges: DataFrame, polygons: DataFrame, boundary: DataFrame, policy: Policy) -> DataFrame:
    """Parallel edges moved apart, with nodes where their shifted ends are, and breaks closed inside the surface."""
    split = materialize(rekeyed(edits.split_parallels(edges, policy)), "split")
    return edits.reconnected(split, boundary, lambda samples, keys: covered_samples(samples, polygons, keys), policy)


def smoothed(edges: DataFrame, policy: Policy) -> DataFrame:
    """Rounds of moving inner nodes along the direction field, then of averaging and resampling each course.

    Moved nodes are rounded to millimetres again: edges whose ends meet go, and
    of several between two nodes the last stays.  Courses of up to three vertices
    keep their shape: the average would draw them together into one point.
    """
    step = max(policy.resample_floor, policy.resample_step)
    current = edges
    for _ in range(policy.smooth_rounds):
        moved = edits.with_moved_ends(current, edits.direction_field(current, policy)).select(*edges.columns)
        averaged = moved.withColumn("geom", F.when(F.size("geom") > 3, G.moving_average(F.col("geom"))).otherwise(F.col("geom")))
        spaced = along.evenly_spaced(averaged, ["edge_id"], F.greatest(F.lit(2), F.floor(F.col("total") / step).cast("int") + 1))
        lines = along.as_lines(spaced, ["edge_id"])
        place = lambda e: G.point(G.snapped(F.col(f"{e}x")), G.snapped(F.col(f"{e}y")))
        ends = G.with_ends(F.col("geom"), F.element_at("geom", 1), F.element_at("geom", -1), place("u"), place("v"))
        drawn = moved.drop("geom").join(lines, "edge_id").withColumn("geom", ends)
        current = materialize(rejoined(drawn, current), "smoothed")
    return current


def skeleton(polygons: DataFrame, policy: Policy, stages: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Edges of the skeleton and the boundary of the surface."""
    polygons = stabilized(polygons, policy)
    stages["01_preprocess"] = polygons.count()
    boundary = materialize(dissolve.union_boundary(polygons, "whole"), "boundary")
    stages["00_merge"] = boundary.count()
    lines = materialize(candidates(polygons, boundary, policy), "candidates")
    stages["02_candidates"] = lines.count()
    chosen = selection.select_candidates(scored(lines, polygons, policy), policy, "origin")
    edges = materialize(graphs.simple_edges(line_edges(chosen.select("line_id", "geom"))).select(*_EDGE), "graph")
    stages["03_graph_build"] = edges.count()
    radius = materialize(node_radii(edges, boundary), "radius")
    edges = pruning.ratio_prune(edges, radius, policy)
    edges = pruning.boundary_near_prune(edges, radius, policy)
    edges = pruning.component_prune(edges, radius, policy)
    edges = materialize(pruning.spur_prune(edges, policy), "pruned")
    stages["04_pruned"] = edges.count()
    merged = edits.merge_chains(edges).select(F.col("edge_id"), F.col("geom").alias("geom"))
    merged = materialize(line_edges(merged.withColumnRenamed("edge_id", "line_id")), "merged")
    joined = materialize(separated_and_reconnected(merged, polygons, boundary, policy), "reconnected")
    smooth = smoothed(joined, policy)
    stages["05_graph_refine"] = smooth.count()
    return materialize(smooth.where(F.col("weight") >= policy.min_length), "skeleton"), boundary


def normalized(edges: DataFrame, boundary: DataFrame, settings: Settings, stages: dict[str, int]) -> DataFrame:
    """Topology: nodes at all meetings, then bridges, forks, spurs, junctions, chains and simplification."""
    pieces = edges.select("edge_id", F.posexplode(G.segments(G.round_line(F.col("geom")))).alias("k", "s"))
    straight = pieces.select(F.struct("edge_id", "k").alias("edge_id"), node(F.col("s.a")).alias("u"), node(F.col("s.b")).alias("v"), *[F.col(f"s.{p}.{c}").alias(f"{e}{c}") for p, e in (("a", "u"), ("b", "v")) for c in "xy"])
    flat = edits.planarize(straight.where("u <> v"))
    line = F.array(G.point(F.col("ax"), F.col("ay")), G.point(F.col("bx"), F.col("by")))
    planar = materialize(line_edges(_numbered(flat.select(line.alias("geom")))), "planar")
    stages["06_planarized"] = planar.count()
    whole = edits.contract_bridges(planar, settings.topology_intersection_merge_threshold_m, settings.topology_intersection_parallel_angle_deg)
    ends = whole.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("ux").alias("px"), F.col("uy").alias("py")), F.struct(F.col("v").alias("n"), F.col("vx").alias("px"), F.col("vy").alias("py")))).alias("p")).select("p.*").distinct()
    near = materialize(boundary_distance(ends, boundary, ["n"], FORK_REACH).select("n"), "near")
    cleaned = pruning.spur_clean(pruning.fork_clean(whole, near))
    stages["07_cleaned"] = cleaned.count()
    smooth = edits.smooth_junctions(cleaned)
    merged = edits.merge_chains(smooth).select(F.col("edge_id").alias("line_id"), "geom")
    rows = line_edges(materialize(merged, "chains"))
    tolerances = edits.simplify_tolerance(rows, settings.topology_simplify_main_tolerance_m, settings.topology_simplify_junction_tolerance_m, settings.topology_junction_min_degree)
    final = kernels.with_simplified(tolerances).select(*rows.columns).withColumn("weight", G.line_length(F.col("geom")))
    return materialize(final, "network")


def polygon_widths(polygons: DataFrame) -> DataFrame:
    """``(poly_id, width)``: short side of each ring's smallest rectangle."""
    return kernels.with_rectangle(polygons.select("poly_id", "ring")).select("poly_id", F.col("rect.width").alias("width"))


def centerlines(polygons: DataFrame, settings: Settings | None = None, policy: Policy | None = None) -> Result:
    """The centreline network of road polygons ``(poly_id, ring)`` with closed rings and, if given, an array ``holes`` of them.

    ``network`` has ``edge_id, u, v``, end coordinates, ``geom`` and ``weight``;
    null rings and rings without area are ignored; no polygons give no edges.
    """
    holes = F.col("holes") if "holes" in polygons.columns else F.lit(None).cast(f"array<{G.LINE}>")
    rings = materialize(polygons.where("ring is not null and size(ring) >= 4").select("poly_id", "ring", dissolve.with_holes(F.col("ring"), holes).alias("whole")), "polygons")
    stages: dict[str, int] = {"input": rings.count()}
    policy = policy or policy_from_widths(polygon_widths(rings))
    bones, boundary = skeleton(rings, policy, stages)
    stages["skeleton"] = bones.count()
    network = normalized(bones, boundary, settings or Settings(), stages)
    stages["network"] = network.count()
    return Result(policy, bones, network, stages)
