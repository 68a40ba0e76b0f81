import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waylace.operators import quality_gates, ranks, selection
from waylace.plans.policy import policy_for_width, upper_median


@pytest.mark.parametrize("n", [1, 2, 3, 10, 5000])
def test_places_and_quantiles(spark, n):
    r = random.Random(n)
    values = [round(r.gauss(0, 1), 2) if r.random() < 0.5 else 1.5 for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    places = sorted({0, n // 3, n // 2, n - 1})
    assert ranks.elements_at(df, "v", places, n) == [sorted(values)[p] for p in places]
    row = quality_gates.describe(df.unionByName(spark.createDataFrame([(None,)], "v double")), "v").first()
    assert row["n"] == n
    for name, share in quality_gates.PERCENTILES.items():
        assert row[name] == pytest.approx(np.percentile(values, 100 * share))


def test_no_values(spark):
    none = spark.createDataFrame([], "v double")
    assert quality_gates.describe(none, "v").first()["p50"] is None and upper_median(none, "v") is None
    assert ranks.elements_at(none, "v", [], 0) == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1000])
def test_fallback_keeps_the_best_share(spark, n):
    policy = policy_for_width(8.0)
    r = random.Random(n)
    rows = [(i, g, round(r.random() * 0.3, 2)) for i in range(n) for g in "ab"] + [(n, "c", 0.9), (n + 1, "c", 0.1)]
    df = spark.createDataFrame(rows, "line_id long, g string, score double")
    got = sorted((x["g"], x["line_id"]) for x in selection.select_candidates(df, policy, "g").select("g", "line_id").collect())
    want = [("c", n)]
    for g in "ab":
        own = sorted((x for x in rows if x[1] == g), key=lambda x: (-x[2], x[0]))
        want += [(g, x[0]) for x in own[: max(1, int(np.ceil(n * policy.keep_ratio)))]]
    assert got == sorted(want)


def test_points_along_rings(spark):
    from waylace.functions import along
    from waylace.functions import geometry as G

    line = [(0, 0), (10, 0), (10, 3), (10, 3), (0, 0)]
    df = spark.createDataFrame([(1, [{"x": float(x), "y": float(y)} for x, y in line])], f"k long, geom {G.LINE}")
    want = [tuple(p) for p in df.select(F.explode(G.segmentize(F.col("geom"), 2.5)).alias("p")).select("p.*").collect()]
    got = along.densified(df, ["k"], 2.5).orderBy("i").collect()
    assert [(r["x"], r["y"]) for r in got] == want and [r["i"] for r in got] == list(range(len(want)))
