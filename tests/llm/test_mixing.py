import itertools

import numpy as np

from tests.llm.conftest import odd_rows, plain
from tests.llm.test_quality import words_of
from waylace.llm import mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = dict(zip(names, itertools.cycle([5, 2, 1])))
    total, target, open_ = sum(sizes.values()), {}, set(names)
    left = total
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * share for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check(df, rows):
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words_of(text))
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == sum(t["words"] * t["times"] for t in r["times"]) and r["size"] == sum(t["words"] for t in r["times"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(1, min(mixing.BLOCK_WORDS, sizes[s] / mixing.FINE))
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((i or -1, len(words_of(t))) for i, t, _ in rows)


def test_documents(docs):
    check(docs, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])


def test_odd_rows_and_empty(odd, none):
    check(odd, [(r[0], r[1], r[3]) for r in odd_rows()])
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd.where("text is null")).agg({"taken": "sum"}).first()[0] == 0
    assert mixing.mixed_documents(none).count() == 0


def test_caps_share_on(spark):
    rows = [(i, "w " * 4, "a") for i in range(10)] + [(100 + i, "w " * 500, s) for i in range(20) for s in ("b", "c", "é", None)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows)


def test_reruns_agree(docs):
    columns = ("doc_id", "size", "source_size", "target", "taken")
    assert plain(mixing.mix(docs), *columns) == plain(mixing.mix(docs.repartition(7, "lang")), *columns)


def test_permutation_is_one():
    for n in (1, 2, 3, 64, 65, 1000, 4097):
        for key in (1, 99):
            assert sorted(mixing.permuted(np.arange(n), n, key).tolist()) == list(range(n))
    assert mixing.permuted(np.arange(1000), 1000, 1).tolist() != mixing.permuted(np.arange(1000), 1000, 2).tolist()


def test_counts_are_multinomial_with_exact_totals():
    shards = 5 * mixing.GROUP_SHARDS + 3
    for slots in (0, 1, 4, 90, 100_000, 7 * 10**11):  # the last is beyond what the corpus of 100 TB needs
        group, count = mixing.group_counts(slots, shards, 3, 5)
        assert count.sum() == slots and (count > 0).all() and (np.diff(group) > 0).all() and (len(group) == 0 or group[-1] <= 5)
        assert [x.tolist() for x in mixing.group_counts(slots, shards, 3, 5)] == [group.tolist(), count.tolist()]
    means = np.zeros(6)
    for rank in range(2000):
        group, count = mixing.group_counts(4, shards, rank, 1)
        means[group] += count
    share = np.array([mixing.GROUP_SHARDS] * 5 + [3]) / shards
    assert np.abs(means / 8000 - share).max() < 4 * np.sqrt(0.25 / 8000)
    large = mixing.group_counts(7 * 10**11, shards, 0, 1)[1]
    spread = (large - 7e11 * share) / np.sqrt(7e11 * share * (1 - share))
    assert 0.05 < np.abs(spread).max() < 5  # drawn, not dealt by proportion
    drawn = mixing.group_shards(1000, 5, shards, 0, 1)
    assert len(drawn) == 1000 and (np.diff(drawn) >= 0).all() and drawn.min() >= 80 and drawn.max() < shards
    assert 250 < (drawn == 81).sum() < 420


def test_small_sources_meet_their_targets(spark):
    rows = [(i * 10 + k, " ".join(["w"] * 5), f"s{i:03}") for i in range(90) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 0.5 for r in got) and min(r["sum(taken)"] for r in got) > 0


def test_plan_reads_every_block_equally_often(spark):
    sources = spark.createDataFrame([(0, 40, 100), (1, 1, 3), (2, 7, 0), (3, 5000, 9000)], "rank long, blocks long, slots long")
    plan = mixing.mix_plan(sources, shard_slots=64).collect()
    assert len(plan) == 9103
    for rank, blocks, slots in ((0, 40, 100), (1, 1, 3), (3, 5000, 9000)):
        own = [r for r in plan if r["rank"] == rank]
        times = np.bincount([r["block"] for r in own], minlength=blocks)
        assert len(own) == slots and len(times) == blocks and times.min() >= slots // blocks and times.max() <= -(-slots // blocks)
        assert len({(r["epoch"], r["block"]) for r in own}) == slots
    sizes = np.bincount([r["shard"] for r in plan])
    assert len(sizes) == -(-9103 // 64) and abs(sizes.mean() - 64) < 1 and 5 < sizes.std() < 11


def test_many_sources(spark):
    sizes = spark.range(20_000).selectExpr("printf('%08d', id) as source", "2 + id % 5 as size")
    got = mixing.source_targets(sizes).collect()
    by_rank = sorted(got, key=lambda r: r["rank"])
    assert [r["rank"] for r in by_rank] == list(range(20_000)) and [r["source"] for r in by_rank] == sorted(r["source"] for r in got)
    want = brute_targets({r["source"]: r["source_size"] for r in got})
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]] for r in got)


def test_internal_names_may_be_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 7, 8, 9, 1), (2, "d e", "t", 7, 8, 9, 1)], "doc_id long, text string, source string, _wl_times int, row int, times int, _ int")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and {tuple(r)[3:] for r in out.collect()} == {(7, 8, 9, 1)}


def test_texts_of_the_mix(docs, odd):
    for df in (docs, odd):
        want = {}
        for r in mixing.mix(df).collect():
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
        out = mixing.mixed_documents(df)
        assert out.columns == df.columns
        got = {}
        for r in out.collect():
            assert r["n_chars"] == len(r["text"])
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words_of(r["text"]))
        assert got == {i: n for i, n in want.items() if n}


def test_taken_texts():
    text = " one two\nthree four five "
    assert mixing.taken_texts(text, [(2, 1), (3, 1)]) == [text]
    assert mixing.taken_texts(text, [(2, 2), (1, 0), (2, 1)]) == ["one two\nfour five", "one two"]
    assert mixing.taken_texts(text, [(2, 0), (3, 0)]) == []
