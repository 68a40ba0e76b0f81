import hashlib
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import odd_rows, plain
from waylace.llm import exact_dedup, simhash


def brute_exact(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out, seen = [], set()
    for i, text in rows:
        own = groups[text or ""]
        keep = max((x for x in own if x is not None), default=None)
        kept = i == keep and (text or "", i) not in seen
        seen.add((text or "", i))
        out.append((i, keep, len(own), kept, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("block_bytes", [exact_dedup.BLOCK_BYTES, 8])
def test_exact_odd_rows(odd, block_bytes):
    if block_bytes == 8:
        odd = odd.where("doc_id is null or doc_id not in (4, 5, 6)")
    want = brute_exact([(r[0], r[1]) for r in odd.select("doc_id", "text").collect()])
    assert plain(exact_dedup.exact_duplicates(odd, block_bytes=block_bytes), *COLUMNS) == want


def test_exact_levels_and_hot_blocks(spark):
    r = random.Random(1)
    pieces = ["aaaa", "bbbb", "cccc"]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randint(0, 9)))) for i in range(300)]
    rows += [(i, "same text of a large group") for i in range(300, 520)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(exact_dedup.exact_duplicates(df, block_bytes=4), *COLUMNS) == brute_exact(rows)


def test_exact_empty(none):
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(none).count() == 0


def test_drop_exact_keeps_columns(odd):
    out = exact_dedup.drop_exact_duplicates(odd)
    assert out.columns == odd.columns
    rows = [(r[0], r[1]) for r in odd_rows()]
    want = sorted((i, t) for i, _, _, kept, t in brute_exact(rows) if kept)
    got = sorted((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect())
    assert got == want


def slow_fingerprint(text):
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in raw + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids):
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(distinct, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    low = {}
    for f, i in zip(fps, ids, strict=True):
        k = find(f)
        if i is not None:
            low[k] = min(low.get(k, i), i)
    return [low.get(find(f)) for f in fps]


def brute_near(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    return sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute_components(fps, [i for i, _ in rows]), strict=True)), key=repr)


def test_near_on_documents(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert plain(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == brute_near(rows)


def test_near_odd_rows_and_empty(odd, none):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert plain(simhash.near_duplicates(odd), "doc_id", "fingerprint", "component_id") == brute_near(rows)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    want = {c for _, _, c in brute_near(rows)}  # every component has a row with an id here
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert [r["text"] for r in kept.where("doc_id = 3").collect()] == ["one two four"]
    assert simhash.keep_one_of_each(none).count() == 0


def near_values(r, centres, n):
    out = set()
    while len(out) < n:
        f = r.choice(centres)
        for _ in range(r.randint(0, 6)):
            f ^= 1 << r.randrange(64)
        out.add(f)
    return sorted(out)


def link_classes(links, fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for x in links:
        root[find(x["u"] & (1 << 64) - 1)] = find(x["v"] & (1 << 64) - 1)
    first = {}
    return [first.setdefault(find(f), i) for i, f in enumerate(fps)]


def test_links_join_exactly_the_near_ones(spark):
    r = random.Random(5)
    fps = near_values(r, [r.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1], 900)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    assert link_classes(simhash.near_links(df).collect(), fps) == brute_components(fps, list(range(len(fps))))


def test_long_lists_are_dealt_again(spark):
    r = random.Random(9)
    hot = [0x123400005678 << 16 | r.getrandbits(16) ^ r.getrandbits(16) << 32 for _ in range(500)]
    fps = sorted(set(hot) | {f ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for f in hot[:100]} | set(near_values(r, [5 << 50, 1 << 63], 100)))
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    assert link_classes(simhash.near_links(df, walked=64).collect(), fps) == brute_components(fps, list(range(len(fps))))


def test_any_five_positions_hold_one_choice():
    masks = simhash.position_masks()
    assert len(masks) == 14 and {m.bit_count() for m in masks} == {32}
    for five in combinations(range(8), simhash.MIN_SHARED):
        whole = sum(0xFF << 8 * p for p in five)
        assert sum(m & whole == m for m in masks) == 1
    finer = simhash.finer_masks(masks[0])
    assert all(f & masks[0] == masks[0] for f in finer) and sum(f ^ masks[0] for f in finer) == masks[0] ^ (1 << 64) - 1


def test_tally_rejects_pairs_that_share_the_posted_bytes_alone():
    value = 0x0101010101010101
    mask = simhash.position_masks()[0]
    spread = [8 * p for p in range(8) if not mask >> 8 * p & 1]
    far = value ^ sum(1 << b for b in spread)  # four bytes differ, by a bit each
    near = value ^ sum(1 << b for b in spread[:3])
    two = np.array([far, near], dtype=np.uint64)
    assert simhash._near(two, np.uint64(value)).tolist() == [False, True]


def test_pair_at_three_bits_links_and_four_does_not(spark):
    base = 0x0123456789ABCDEF
    df = lambda *f: spark.createDataFrame([(simhash._signed(x),) for x in f], "fp long")
    assert simhash.near_links(df(base, base ^ 0x8000010000000001)).count() > 0
    assert simhash.near_links(df(base, base ^ 0x8000010000000101)).count() == 0


def test_batches_split_a_posting_list():
    import pyarrow as pa

    fps = sorted({0b111 << k for k in range(8)} | {0})
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(fps), pa.int64()), pa.array([0] * len(fps), pa.int64()), pa.array(fps, pa.int64())], names=["m", "k", "f"])
    whole = [r for b in simhash._posting_links(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    parts = [r for b in simhash._posting_links(batch.slice(i, 2) for i in range(0, len(fps), 2)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert whole == parts and whole




def test_batches_split_a_list_that_is_dealt_again():
    import pyarrow as pa

    fps = list(range(40))
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 45, pa.int64()), pa.array([0] * 40 + [1] * 5, pa.int64()), pa.array([*fps, 1, 2, 3, 64, 65], pa.int64())], names=["m", "k", "f"])
    for step in (2, 7, 45):
        out = [r for b in simhash._posting_links((batch.slice(i, step) for i in range(0, 45, step)), walked=16) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert sorted(u for m, u, v in out if m is not None) == fps and {m for m, *_ in out} == {1, None}
        assert {x for m, *pair in out if m is None for x in pair} == {1, 2, 3, 64, 65}


def test_internal_names_may_be_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", 5, 6, 7, 8), (2, "a b c d", 1, 2, 3, 4)], "doc_id long, text string, _wl_key int, row int, own_id int, n int")
    for out, kept in ((exact_dedup.drop_exact_duplicates(df), 2), (simhash.keep_one_of_each(df), 1)):
        assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [tuple(r) for r in df.where(f"doc_id = {kept}").collect()]


def test_buckets_follow_the_bytes():
    assert exact_dedup._buckets(0) == exact_dedup.LEAST_BUCKETS
    assert exact_dedup._buckets(10**12) == 10**12 // exact_dedup.BUCKET_BYTES
    assert exact_dedup._buckets(10**18) == exact_dedup.MOST_BUCKETS <= 1 << 62 - exact_dedup._RANK_BITS
