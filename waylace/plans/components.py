"""Distributed connected components by alternating star contractions.

Each round rewires every node's larger neighbours to its smallest neighbour
(large star) and then every node's smaller neighbours to the smallest one
(small star), after Kiveris et al., "Connected Components in MapReduce and
Beyond" (2014).  Rounds grow with the logarithm of the longest path, the edge
set never grows, and no group of edges is gathered in one place: minima are
combined before the shuffle and the rewiring is a join that adaptive execution
may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylace.plans.scratch import discard, materialize


#: Up to so many edges a round is one plan; beyond, minima are written first, so that joins with them can split hot nodes.
ONE_PLAN_EDGES = 100_000


def _minima(edges: DataFrame, tag: str, few: bool) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return low if few else materialize(low, tag)


def _large_star(edges: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minima(both, "cc-large", few)
    out = (
        both.where("v > u")
        .join(low, "u")
        .select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        .where("a <> b")
        .distinct()
    )
    return out.select(F.col("a").alias("u"), F.col("b").alias("v")), low


def _small_star(edges: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    low = _minima(edges, "cc-small", few)
    joined = edges.join(low, "u")
    out = (
        joined.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .where("a <> b")
        .distinct()
    )
    return out.select(F.col("a").alias("u"), F.col("b").alias("v")), low


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node that has an edge to another node.

    ``root`` is the smallest node of the component.  Null ends and self-loops
    are ignored; repeated and reversed edges count once; no edges give no rows.
    Stops when a round leaves the edge set unchanged.
    """
    a, b = F.col(u), F.col(v)
    current = materialize(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "cc-edges",
    )
    mark = _mark(current)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        few = mark[0] <= ONE_PLAN_EDGES
        large, low1 = _large_star(current, few)
        if not few:
            large = materialize(large, "cc-round")
            discard(low1)
        starred, low2 = _small_star(large, few)
        small = materialize(starred, "cc-round")
        discard(low2)
        discard(large)
        seen = _mark(small)
        discard(current)
        current = small
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())
