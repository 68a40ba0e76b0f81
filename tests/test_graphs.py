import random

import pytest

from waylace.functions import graphs
from waylace.operators import edits, pruning
from waylace.plans import components
from waylace.plans.policy import policy_for_width


def forest(r, n):
    return [(i, i, r.randint(max(0, i - 4), i - 1), float(r.randint(1, 9))) for i in range(1, n) if r.random() < 0.95]


def brute_roots(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("one_plan", [True, False])
def test_components(spark, monkeypatch, one_plan):
    if not one_plan:
        monkeypatch.setattr(components, "ONE_PLAN_EDGES", 0)
    r = random.Random(1)
    pairs = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(80)] + [(i, i + 1) for i in range(200, 260)] + [(300, k) for k in range(301, 340)]
    df = spark.createDataFrame([*pairs, (None, 3), (7, 7), (9, None), pairs[0]], "u long, v long")
    got = {x["node"]: x["root"] for x in components.connected_components(df).collect()}
    want = {k: v for k, v in brute_roots([p for p in pairs if p[0] != p[1]]).items()}
    assert got == want
    assert components.connected_components(df.where("false")).count() == 0


def brute_walks(edges):
    at = {}
    for e, u, v, w in edges:
        at.setdefault(u, []).append((e, v, w))
        at.setdefault(v, []).append((e, u, w))
    out = {}
    for e, u, v, w in edges:
        for a, b in ((u, v), (v, u)):
            length, hops, cur, last_edge, seen = w, 1, b, e, {(e, b)}
            while len(at[cur]) == 2:
                nxt = [x for x in at[cur] if x[0] != last_edge]
                if not nxt or (nxt[0][0], nxt[0][1]) in seen:
                    cur = None
                    break
                last_edge, cur, step = nxt[0]
                seen.add((last_edge, cur))
                length, hops = length + step, hops + 1
            out[(e, a)] = (cur, length, hops) if cur is not None else (None,)
    return out


def test_walks(spark):
    r = random.Random(2)
    edges = forest(r, 120) + [(1000 + i, 500 + i, 500 + (i + 1) % 6, 1.0) for i in range(6)] + [(2000, 600, 601, 2.0), (2001, 600, 601, 3.0), (2002, 601, 602, 1.0)]
    df = spark.createDataFrame(edges, "edge_id long, u long, v long, weight double")
    got = {(x["edge_id"], x["a"]): (x["last"], x["length"], x["hops"]) if x["last"] is not None else (None,) for x in graphs.chain_walks(df).collect()}
    assert got == brute_walks(edges)


def brute_spurs(edges, longest):
    edges = list(edges)
    while True:
        deg = {}
        for _, u, v, _ in edges:
            deg[u], deg[v] = deg.get(u, 0) + 1, deg.get(v, 0) + 1
        gone = set()
        for leaf in (n for n, d in deg.items() if d == 1):
            cur, last, total, path = leaf, None, 0.0, []
            while True:
                nxt = [(e, v if u == cur else u, w) for e, u, v, w in edges if cur in (u, v) and e != last]
                if not nxt:
                    break
                last, cur, w = nxt[0]
                total += w
                path.append(last)
                if deg[cur] != 2:
                    break
            if total <= longest:
                gone.update(path)
        if not gone:
            return sorted(e[0] for e in edges)
        edges = [e for e in edges if e[0] not in gone]


def test_spur_clean_reaches_the_fixpoint(spark):
    edges = forest(random.Random(3), 90)
    df = spark.createDataFrame(edges, "edge_id long, u long, v long, weight double")
    once = pruning.spur_clean(df, 4.0)
    assert sorted(x["edge_id"] for x in once.collect()) == brute_spurs(edges, 4.0)
    assert pruning.spur_clean(once, 4.0).count() == once.count()


def test_ratio_prune_is_stable(spark):
    edges = forest(random.Random(4), 90)
    df = spark.createDataFrame(edges, "edge_id long, u long, v long, weight double")
    radius = spark.createDataFrame([(n, 0.5 + n % 3) for n in range(90)], "n long, radius double")
    policy = policy_for_width(8.0)
    once = pruning.ratio_prune(df, radius, policy)
    assert once.count() < len(edges)
    assert pruning.short_for_radius(once, radius, policy).isEmpty()


def test_hard_rule_never_fires_above_the_floor(spark):
    policy = policy_for_width(8.0)
    assert policy.hard_radius < pruning.MIN_RADIUS


def test_chains_keep_length_and_rings(spark):
    edges = [(1, 1, 2, 1.0), (2, 2, 3, 2.0), (3, 3, 4, 3.0), (4, 3, 5, 1.0), (5, 6, 7, 1.0), (6, 7, 8, 1.0), (7, 8, 6, 1.0), (8, 5, 9, 1.0), (9, 9, 10, 1.0), (10, 10, 5, 1.0)]
    df = spark.createDataFrame(edges, "edge_id long, u long, v long, weight double")
    rows = edits.merge_chains(df).collect()
    assert sum(r["weight"] for r in rows) == sum(e[3] for e in edges)
    assert sorted((min(r["u"], r["v"]), max(r["u"], r["v"]), r["weight"], r["parts"]) for r in rows) == [(1, 3, 3.0, 2), (3, 4, 3.0, 1), (3, 5, 1.0, 1), (5, 5, 3.0, 3), (6, 7, 1.0, 1), (6, 8, 1.0, 1), (7, 8, 1.0, 1)]


def straight(spark, rows):
    full = [(i, u, v, *xy, ((xy[0] - xy[2]) ** 2 + (xy[1] - xy[3]) ** 2) ** 0.5) for i, u, v, *xy in rows]
    return spark.createDataFrame(full, "edge_id long, u long, v long, ux double, uy double, vx double, vy double, weight double")


def test_bridge_contracts_unless_lines_run_on_beside_it(spark):
    cross = [(1, 1, 2, 0.0, 0.0, 1.0, 0.0), (2, 1, 3, 0.0, 0.0, 0.0, 5.0), (3, 1, 4, 0.0, 0.0, -5.0, 1.0), (4, 2, 5, 1.0, 0.0, 4.0, 4.0), (5, 2, 6, 1.0, 0.0, 5.0, -3.0)]
    out = edits.contract_bridges(straight(spark, cross)).orderBy("edge_id").collect()
    assert [(r["edge_id"], r["u"], r["ux"], r["uy"]) for r in out] == [(i, 1, 0.5, 0.0) for i in (2, 3, 4, 5)]
    beside = [(1, 1, 2, 0.0, 0.0, 0.0, 1.0), (2, 1, 3, 0.0, 0.0, 9.0, 0.0), (3, 1, 4, 0.0, 0.0, -9.0, 0.0), (4, 2, 5, 0.0, 1.0, 9.0, 1.0), (5, 2, 6, 0.0, 1.0, -9.0, 1.0)]
    assert edits.contract_bridges(straight(spark, beside)).count() == 5


def test_planarize(spark):
    cross = straight(spark, [(1, 1, 2, 0.0, 0.0, 10.0, 0.0), (2, 3, 4, 5.0, -5.0, 5.0, 5.0), (3, 5, 6, 2.0, 0.0, 2.0, 3.0), (4, 7, 8, 8.0, 0.0, 12.0, 0.0)])
    pieces = {tuple(r) for r in edits.planarize(cross).collect()}
    assert pieces == {(0, 0, 2, 0), (2, 0, 5, 0), (5, 0, 8, 0), (8, 0, 10, 0), (10, 0, 12, 0), (5, -5, 5, 0), (5, 0, 5, 5), (2, 0, 2, 3)}
    again = spark.createDataFrame([(i, 2 * i, 2 * i + 1, *map(float, p), 1.0) for i, p in enumerate(sorted(pieces))], cross.schema)
    assert {tuple(r) for r in edits.planarize(again).collect()} == pieces
