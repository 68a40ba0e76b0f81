"""Points along lines, by explode and window: each line's vertices stay together, lines spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylace.functions import geometry as G


def segment_table(lines: DataFrame, keys: list[str], geom: str = "geom") -> DataFrame:
    """``keys`` and, for each segment, ``k, ax, ay, bx, by, before, after, total`` and ``is_last``."""
    rows = lines.select(*keys, F.posexplode(G.segments(F.col(geom))).alias("k", "s"))
    flat = rows.select(*keys, "k", *[F.col(f"s.{e}.{c}").alias(f"{e}{c}") for e in "ab" for c in "xy"])
    order = Window.partitionBy(*keys).orderBy("k")
    measured = flat.withColumn("after", F.sum(G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).over(order))
    whole = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return measured.withColumns({"before": F.coalesce(F.lag("after").over(order), F.lit(0.0)), "total": F.last("after").over(whole), "is_last": F.lead("k").over(order).isNull()})


def _at(t: Column) -> tuple[Column, Column]:
    r = F.coalesce(G.clamp(F.try_divide(t - F.col("before"), F.col("after") - F.col("before")), 0, 1), F.lit(0.0))
    return F.col("ax") + r * (F.col("bx") - F.col("ax")), F.col("ay") + r * (F.col("by") - F.col("ay"))


def evenly_spaced(lines: DataFrame, keys: list[str], n: Column, geom: str = "geom") -> DataFrame:
    """``keys, n, i, px, py``: ``n(total)`` points from end to end at equal lengths.

    ``n`` is an expression on ``total``, the line's length, and gives 2 or more.
    """
    parts = segment_table(lines, keys, geom).withColumn("n", n.cast("int"))
    upto = lambda c: F.coalesce(F.floor(F.try_divide(F.col(c) * (F.col("n") - 1), F.col("total"))), F.lit(0)).cast("int")
    first = F.when(F.col("k") == 0, 0).otherwise(upto("before") + 1)
    last = F.when(F.col("is_last"), F.col("n") - 1).otherwise(upto("after"))
    rows = parts.withColumns({"first": first, "last": last}).where("first <= last").withColumn("i", F.explode(F.sequence("first", "last")))
    x, y = _at(F.col("i") / (F.col("n") - 1) * F.col("total"))
    return rows.select(*keys, "n", "i", x.alias("px"), y.alias("py"))


def point_at_share(lines: DataFrame, keys: list[str], share: float, geom: str = "geom") -> DataFrame:
    """``keys, px, py``: the point at a share of each line's length; lines of no length are left out."""
    t = F.col("total") * share
    rows = segment_table(lines, keys, geom).where((F.col("total") > 0) & (F.col("before") < t) & ((t <= F.col("after")) | F.col("is_last")) | (F.lit(share) <= 0) & (F.col("k") == 0))
    x, y = _at(t)
    return rows.select(*keys, x.alias("px"), y.alias("py"))


def as_lines(points: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """``keys, geom`` from rows of ``px, py`` in order."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "px", "py")))
    return points.groupBy(*keys).agg(F.transform(ordered, lambda p: G.point(p["px"], p["py"])).alias("geom"))


def densified(rows: DataFrame, keys: list[str], longest: float, line: str = "geom") -> DataFrame:
    """``keys, i, x, y``: the vertices of lines with points added so that no segment is longer than ``longest``.

    The same as exploding :func:`waylace.functions.geometry.segmentize`, but only
    sides are worked on inside arrays; points are made by generated code.
    """
    geom = F.col(line)
    last = F.transform(F.slice(geom, -1, 1), lambda p: F.struct(p.alias("a"), p.alias("b")))
    pieces = lambda s: F.greatest(F.ceil(G.distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]) / longest), F.lit(1)).cast("int")
    sides = rows.select(*keys, F.concat(G.segments(geom), last).alias("s")).select(*keys, "s", F.transform("s", pieces).alias("n"))
    each = sides.select(*keys, "n", F.posexplode("s").alias("nth", "side"))
    first = F.aggregate(F.slice("n", F.lit(1), F.col("nth")), F.lit(0), lambda total, m: total + m)
    points = each.select(*keys, F.col("side.a.x").alias("ax"), F.col("side.a.y").alias("ay"), F.col("side.b.x").alias("bx"), F.col("side.b.y").alias("by"), F.element_at("n", F.col("nth") + 1).alias("m"), first.alias("first"))
    cut = points.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("q"))
    share = F.col("q") / F.col("m")
    return cut.select(*keys, (F.col("first") + F.col("q")).alias("i"), (F.col("ax") + share * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + share * (F.col("by") - F.col("ay"))).alias("y"))
