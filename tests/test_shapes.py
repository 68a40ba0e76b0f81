import numpy as np
import pyarrow as pa
import pytest

from waylace.functions import kernels, offsets
from waylace.functions.geometry import LINE


def test_equal_shapes_are_worked_on_once(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def fn(line):
        with open(seen, "a") as out:
            out.write("x")
        return [line * 2, line[:1]] if len(line) > 2 else []

    shapes = [[(0.0, 0.0), (1.0, 0.0), (1.0, 2.0)], [(0.0, 0.0), (1.0, 1.0)]]
    lines = [(k, [(x + 3.5 * k, y - k) for x, y in shapes[k % 2]]) for k in range(40)] + [(40, None), (41, [])]
    df = spark.createDataFrame(lines, f"id long, geom {LINE}").coalesce(1)
    found = {r["id"]: r["parts"] for r in kernels.map_shapes(df, "geom", fn, "parts", f"array<{LINE}>").collect()}
    for k, line in lines:
        want = None if line is None else [] if len(line) < 3 else [[(2 * x - line[0][0], 2 * y - line[0][1]) for x, y in line], [line[0]]]
        assert (found[k] if found[k] is None else [[(p["x"], p["y"]) for p in part] for part in found[k]]) == want
    assert len(open(seen).read()) == 3


def test_structs_of_lines():
    first = np.array([[1.0, 2.0], [0.0, 0.0], [5.0, 5.0]])
    shape = kernels._flat([{"ring": np.array([[0.0, 0.0], [1.0, 1.0]]), "whole": np.array([[0.5, 0.5]])}], ["ring", "whole"])
    line = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    kind = pa.list_(pa.struct([("ring", line), ("whole", line)]))
    got = kernels._joined([shape, None, shape], first, kind, ["ring", "whole"]).to_pylist()
    at = lambda x, y: [{"ring": [{"x": x, "y": y}, {"x": x + 1, "y": y + 1}], "whole": [{"x": x + 0.5, "y": y + 0.5}]}]
    assert got == [at(1.0, 2.0), None, at(5.0, 5.0)]


def test_stable_parts_lie_where_the_polygon_does(spark):
    ring = [(0.0, 0.0), (40.0, 0.0), (40.0, 20.0), (0.0, 20.0), (0.0, 0.0)]
    places = [(0.0, 0.0), (1200.5, -300.25), (7.0, 9000.0)]
    df = spark.createDataFrame([(k, [(x + dx, y + dy) for x, y in ring]) for k, (dx, dy) in enumerate(places)], f"id long, whole {LINE}")
    done = offsets.with_stable(df, 2.0, 0.2, 4.0)
    for r in done.collect():
        (part,) = r["parts"]
        dx, dy = places[r["id"]]
        for line in (part["ring"], part["whole"]):
            assert min(p["x"] for p in line) == pytest.approx(dx, abs=0.05) and max(p["y"] for p in line) == pytest.approx(dy + 20, abs=0.05)
