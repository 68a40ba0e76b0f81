"""Elements at given places of an ordered column, without ordering all of it.

Approximate percentiles bracket each place with room to spare; only values in
the brackets are ordered, a bracket at a time.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Share of the rows on either side of a place that its bracket holds; twenty times the error of the percentiles.
_ROOM = 2e-4
_ACCURACY = 100_000


def elements_at(df: DataFrame, column: str, places: list[int], n: int) -> list[float]:
    """The elements at ``places`` (from 0) of the ordered values of ``column``, of which there are ``n`` and none is null."""
    if not places:
        return []
    values = df.select(F.col(column).cast("double").alias("v"))
    shares = [s for p in places for s in (max(0.0, p / n - _ROOM), min(1.0, (p + 1) / n + _ROOM))]
    found = values.agg(F.percentile_approx("v", F.array(*[F.lit(s) for s in shares]), _ACCURACY)).first()[0]
    brackets = list(zip(found[::2], found[1::2], strict=True))
    below = values.agg(*[F.count_if(F.col("v") < low) for low, _ in brackets]).first()
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"), F.lit(p - b).alias("place")) for k, ((low, high), p, b) in enumerate(zip(brackets, places, below, strict=True))])
    near = values.select("v", F.explode(F.filter(rows, lambda r: F.col("v").between(r["low"], r["high"]))).alias("r"))
    counts = near.groupBy("r.k", "r.place", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("v"))
    picked = counts.withColumn("upto", upto).where(F.col("upto") > F.col("place")).groupBy("k").agg(F.min("v").alias("v")).collect()
    by_bracket = {r["k"]: r["v"] for r in picked}
    return [by_bracket[k] for k in range(len(places))]


def quantiles(df: DataFrame, column: str, shares: list[float], n: int) -> list[float]:
    """Interpolated quantiles of ``n`` values, none of which is null."""
    at = [(n - 1) * s for s in shares]
    places = sorted({f(a) for a in at for f in (math.floor, math.ceil)})
    value = dict(zip(places, elements_at(df, column, places, n), strict=True))
    return [value[math.floor(a)] + (a - math.floor(a)) * (value[math.ceil(a)] - value[math.floor(a)]) for a in at]
