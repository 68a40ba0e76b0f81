"""Graphs as edge tables: degrees, adjacency and walks along chains.

An edge table has ``edge_id, u, v`` and usually ``weight``.  Parallel edges
and self-loops are allowed; a self-loop adds two to its node's degree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylace.plans.scratch import discard, materialize


def ends(edges: DataFrame) -> DataFrame:
    """Both ends of every edge: ``(edge_id, a, b, weight, forward)`` for u to v and v to u."""
    there = edges.select("edge_id", F.col("u").alias("a"), F.col("v").alias("b"), "weight", F.lit(True).alias("forward"))
    back = edges.select("edge_id", F.col("v").alias("a"), F.col("u").alias("b"), "weight", F.lit(False).alias("forward"))
    return there.unionByName(back)


def node_degree(edges: DataFrame) -> DataFrame:
    """``(n, degree)``."""
    both = edges.select(F.explode(F.array("u", "v")).alias("n"))
    return both.groupBy("n").agg(F.count("*").alias("degree"))


def simple_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair of different nodes, from the smaller to the larger; of several the last (largest ``edge_id``) stays.

    End coordinates and ``geom``, where given, are turned with their edge.
    """
    rest = [c for c in edges.columns if c not in ("u", "v")]
    turned = F.col("u") > F.col("v")
    other = {"ux": "vx", "vx": "ux", "uy": "vy", "vy": "uy"}

    def along(name: str) -> Column:
        if name in other and set(other) <= set(rest):
            return F.when(turned, F.col(other[name])).otherwise(F.col(name)).alias(name)
        return F.when(turned, F.reverse(name)).otherwise(F.col(name)).alias(name) if name == "geom" else F.col(name)

    return (
        edges.where("u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), *[along(c) for c in rest])
        .groupBy("u", "v")
        .agg(F.max_by(F.struct(*rest), "edge_id").alias("last"))
        .select("u", "v", "last.*")
    )


def with_degrees(edges: DataFrame, degrees: DataFrame | None = None) -> DataFrame:
    """``edges`` with ``deg_u`` and ``deg_v``; 0 for a node without a degree."""
    degrees = node_degree(edges) if degrees is None else degrees
    u = degrees.select(F.col("n").alias("u"), F.col("degree").alias("deg_u"))
    v = degrees.select(F.col("n").alias("v"), F.col("degree").alias("deg_v"))
    zero = F.lit(0).cast("long")
    return edges.join(u, "u", "left").join(v, "v", "left").withColumns({"deg_u": F.coalesce("deg_u", zero), "deg_v": F.coalesce("deg_v", zero)})


def chain_walks(edges: DataFrame) -> DataFrame:
    """Where each walk along a chain ends, for every edge in both directions.

    The walk ``(edge_id, a, b)`` starts at ``a`` over the edge to ``b`` and goes
    on through nodes of degree 2 to the first node of another degree.  Gives
    ``last`` (that node), ``last_edge``, ``length`` and ``hops`` of the whole
    walk, and the degrees ``deg_a`` and ``deg_last``; walks around a ring of
    degree-2 nodes have null ``last``, and a self-loop apart from all else none.  Pointers are doubled in each round, so rounds grow with
    the logarithm of the longest chain.
    """
    half = materialize(ends(edges), "half-edges")
    degrees = materialize(node_degree(edges), "degrees")
    deg_b = degrees.select(F.col("n").alias("b"), F.col("degree").alias("deg_b"))
    # at a node of degree 2, the one other way out; each such node has two half-edges, so no group grows
    onward = half.join(degrees.where("degree = 2").select(F.col("n").alias("a")), "a", "left_semi").select(
        F.col("a").alias("b"), F.col("edge_id").alias("next_edge"), F.col("forward").alias("next_forward")
    )
    state = materialize(
        half.join(deg_b, "b")
        .join(onward, "b", "left")
        .where("next_edge is null or next_edge <> edge_id")
        .select("edge_id", "forward", "a", "b", "next_edge", "next_forward", F.when(F.col("next_edge").isNull() & (F.col("deg_b") != 2), F.col("b")).alias("last"), F.col("weight").cast("double").alias("length"), F.lit(1).cast("long").alias("hops"), F.col("edge_id").alias("last_edge")),
        "walks",
    )
    open_before = -1
    while True:
        open_now = state.where("next_edge is not null").count()
        if open_now in (0, open_before):
            break
        open_before = open_now
        ahead = state.select(
            F.col("edge_id").alias("e"), F.col("forward").alias("f"), F.col("next_edge").alias("n_edge"), F.col("next_forward").alias("n_forward"), F.col("last").alias("n_last"), F.col("length").alias("n_length"), F.col("hops").alias("n_hops"), F.col("last_edge").alias("n_last_edge")
        )
        joined = state.join(ahead, (F.col("next_edge") == F.col("e")) & (F.col("next_forward") == F.col("f")), "left")
        moved = materialize(
            joined.select(
                "edge_id",
                "forward",
                "a",
                "b",
                F.col("n_edge").alias("next_edge"),
                F.col("n_forward").alias("next_forward"),
                F.coalesce("last", "n_last").alias("last"),
                (F.col("length") + F.coalesce("n_length", F.lit(0.0))).alias("length"),
                (F.col("hops") + F.coalesce("n_hops", F.lit(0))).alias("hops"),
                F.coalesce("n_last_edge", "last_edge").alias("last_edge"),
            ),
            "walks",
        )
        discard(state)
        state = moved
    discard(half)
    deg_a = degrees.select(F.col("n").alias("a"), F.col("degree").alias("deg_a"))
    deg_last = degrees.select(F.col("n").alias("last"), F.col("degree").alias("deg_last"))
    return state.join(deg_a, "a").join(deg_last, "last", "left").select("edge_id", "forward", "a", "b", "last", "last_edge", "length", "hops", "deg_a", "deg_last")


def leaf_paths(walks: DataFrame) -> DataFrame:
    """``(leaf, junction, total_len, n_edges)`` for every node of degree 1.

    In a component without a junction the path ends at the other leaf.
    """
    return walks.where("deg_a = 1").select(F.col("a").alias("leaf"), F.col("last").alias("junction"), F.col("length").alias("total_len"), F.col("hops").alias("n_edges"))


def path_edges(walks: DataFrame) -> DataFrame:
    """Every edge of every leaf's path: ``(leaf, edge_id, far, position, upto)``; ``far`` is its end away from the leaf.

    An edge lies on a leaf's path if the walk over it towards the leaf ends
    there; that walk's hops and length are the edge's position and the length of
    the path up to and with it.
    """
    return walks.where("deg_last = 1").select(F.col("last").alias("leaf"), "edge_id", F.col("a").alias("far"), F.col("hops").alias("position"), F.col("length").alias("upto"))
