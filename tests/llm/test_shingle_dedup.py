import random
from itertools import combinations

import corpus_pipeline
from tests.llm.conftest import odd_rows
from waylace.llm import shingle_dedup, simhash


def slow_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_ids(rows):
    sets = [slow_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] | sets[j])
        if not both or len(sets[i] & sets[j]) >= 0.8 * both:
            root[find(j)] = find(i)
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), doc_id), doc_id)
    return sorted(first.values())


def test_stage_joins_edited_copies(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([40, 100, 300]))]
        rows.append(base)
        for edits in (1, 1, 2, 3, 6):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = word()
            rows.append(copy)
    common = [word() for _ in range(90)]
    rows += [[*common, *[word() for _ in range(30)]] for _ in range(40)]  # alike, but below 0.8
    chain = [word() for _ in range(100)]
    for k in range(12):  # only neighbours are near
        chain = chain[:8 * k] + [word() for _ in range(3)] + chain[8 * k + 3 :]
        rows.append(list(chain))
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.near_deduplication(spark, df, "")
    assert sorted(x["doc_id"] for x in out.collect()) == kept_ids(rows)
    one_word = spark.createDataFrame([rows[0], (1, rows[0][1].rsplit(" ", 1)[0] + " other")], "doc_id long, text string")
    assert [x["doc_id"] for x in corpus_pipeline.near_deduplication(spark, one_word, "").collect()] == [0]


def test_odd_rows_and_empty(odd, none):
    out = shingle_dedup.keep_one_of_each(odd)
    assert out.columns == odd.columns
    rows = [(i, t) for i, t, *_ in odd_rows() if i is not None]
    assert sorted(x["doc_id"] for x in out.collect()) == kept_ids(rows)
    assert shingle_dedup.keep_one_of_each(none).count() == 0


def test_simhash_links_are_proposed(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(30):
        base = [word() for _ in range(400)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:-1], word()]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketched = shingle_dedup.sketches(docs).collect()
    fps = {x["doc_id"]: x["fp"] & (1 << 64) - 1 for x in sketched}
    for i, text in rows:
        assert fps[i] == simhash.fingerprint(text.encode(), 5)
    nodes = {x["node"]: x["doc_id"] for x in sketched}
    pairs = shingle_dedup._simhash_pairs(shingle_dedup.sketches(docs)).collect()
    got = {tuple(sorted((nodes[p["u"]], nodes[p["v"]]))) for p in pairs}
    want = {(i, j) for i, j in combinations(sorted(fps), 2) if (fps[i] ^ fps[j]).bit_count() <= 3}
    assert got == want and len(want) >= 20  # of 30
