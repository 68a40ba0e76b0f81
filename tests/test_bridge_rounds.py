import math

from tests.test_graphs import straight
from waylace.operators import edits


def test_hub_with_sixty_bridges(spark):
    """The far edges start where their bridge ends and have no direction, so none guards a bridge."""
    rows = []
    for k in range(60):
        end = (0.5 * math.cos(k * math.pi / 30), 0.5 * math.sin(k * math.pi / 30))
        rows.append((3 * k, 0, 1000 + k, 0.0, 0.0, *end))
        rows += [(3 * k + n, 1000 + k, 2000 + 2 * k + n, *end, *end) for n in (1, 2)]
    out = edits.contract_bridges(straight(spark, rows))
    assert sorted(r["edge_id"] for r in out.collect()) == [r[0] for r in rows if r[0] % 3]
