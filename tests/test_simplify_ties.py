import math
import random

import numpy as np

from waylace.functions import kernels


def slow_simplify(points, tolerance):
    """The rule of the SQL of simplify_lines, vertex by vertex."""

    def gap(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        gx, gy = p[0] - a[0] - t * dx, p[1] - a[1] - t * dy
        return math.sqrt(gx * gx + gy * gy)

    kept, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        gaps = [gap(p, points[i], points[j]) for p in points[i + 1 : j]]
        if max(gaps) > tolerance:
            k = i + 1 + gaps.index(max(gaps))
            kept.add(k)
            stack += [(i, k), (k, j)]
    return [points[k] for k in sorted(kept)]


def test_equal_gaps_go_by_the_sql():
    r = random.Random(5)
    for _ in range(60):  # runs of one value, so that many vertices are equally far
        runs = [r.randrange(50_000) / 100 / 10 for _ in range(40)]
        points = [(float(60 * k + m + 1), y) for k, y in enumerate(runs) for m in range(60)]
        assert kernels.simplify(np.array(points), 2.0).tolist() == [list(p) for p in slow_simplify(points, 2.0)]
