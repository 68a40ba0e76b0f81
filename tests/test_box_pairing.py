import math
import random

from waylace.operators import pairing
from waylace.plans.policy import policy_for_width

POLICY = policy_for_width(12.0)


def boxes(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(4000) / 4, r.randrange(4000) / 4, r.choice([4.0, 9.25, 24.0, 700.0]), r.choice([6.0, 24.0, 35.5])) for i in range(60)]
    rows += [(i, x + 3.0, y, w + 2.25, h + 1.0) for i, x, y, w, h in rows[:5]] + [(99, 0.0, 0.0, 0.0, 0.0)]  # polygons of two boxes, and one of no size
    return spark.createDataFrame(rows, "poly_id long, x0 double, y0 double, w double, h double")


def slow_mids(rows):
    step = max(POLICY.pair_step, POLICY.boundary_step_floor)
    best = {}
    for poly, x0, y0, w, h in rows:
        length = 2 * (w + h)
        n = max(8, math.floor(length / step)) if length else 0
        for i in range(n):
            t = i / n * length
            x = x0 + (t if t <= w else w if t <= w + h else 2 * w + h - t if t <= 2 * w + h else 0.0)
            y = y0 + (0.0 if t <= w else t - w if t <= w + h else h if t <= 2 * w + h else 2 * w + 2 * h - t)
            rx, ry = x - (x0 + w / 2), y - (y0 + h / 2)
            along, across = (rx, ry) if w >= h else (ry, -rx)
            key = (poly, round(along / POLICY.axis_bin), across >= 0)
            best[key] = max(best.get(key, ((-1.0, 0),)), ((round(abs(across), 9), -i), (x, y)))
    out = []
    for (poly, k, left), (_, p) in best.items():
        if left and (poly, k, False) in best:
            q = best[poly, k, False][1]
            if math.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) >= POLICY.lane_width:
                out.append((poly, k, round((p[0] + q[0]) / 2, 6), round((p[1] + q[1]) / 2, 6)))
    return sorted(out)


def test_mids_without_rows_of_samples(spark):
    df = boxes(spark)
    found = pairing.boundary_mids(df, POLICY)
    assert sorted((r["poly_id"], r["bin"], round(r["x"], 6), round(r["y"], 6)) for r in found.collect()) == slow_mids([tuple(r) for r in df.collect()])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # samples are neither rows nor joined


def test_segments_without_rows_of_samples(spark):
    found = pairing.break_segments(pairing.boundary_mids(boxes(spark), POLICY), POLICY)
    rows = {}
    for poly, k, x, y in slow_mids([tuple(r) for r in boxes(spark).collect()]):
        rows.setdefault(poly, []).append((k, x, y))
    want = []
    for poly, mids in rows.items():
        segment = 0
        for a, b in zip([mids[0], *mids], mids, strict=False):
            segment += math.hypot(a[1] - b[1], a[2] - b[2]) > POLICY.axis_bin * POLICY.pair_break_bins
            want.append((poly, b[0], segment))
    assert sorted((r["poly_id"], r["bin"], r["segment"]) for r in found.collect()) == sorted(want)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def slow_lines(mids, limit):
    lines, line = [], []
    for p in mids:
        if len(line) >= 2 and math.hypot(p[0] - line[-1][0], p[1] - line[-1][1]) > limit:
            lines.append(line)
            line = []
        line.append(p)
    return [*lines, line] if len(line) >= 2 else lines


def test_lines_without_a_fold(spark):
    r = random.Random(2)
    limit = POLICY.axis_bin * POLICY.pair_break_bins
    rows, want = [], []
    for poly in range(120):
        x, mids = 0.0, []
        for _ in range(r.randrange(1, 14)):
            x += r.choice([1.0, 1.0, 50.0, 50.0])
            mids.append((x, 0.0))
        rows += [(poly, k, *p) for k, p in enumerate(mids)]
        want += [(poly, k, line) for k, line in enumerate(slow_lines(mids, limit))]
    found = pairing.boundary_pair_lines(spark.createDataFrame(rows, "poly_id long, bin long, x double, y double"), POLICY)
    got = [(p["poly_id"], p["segment"], [(q["x"], q["y"]) for q in p["geom"]]) for p in found.orderBy("poly_id", "segment").collect()]
    assert got == want
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()  # a fold copies the line at each midpoint
