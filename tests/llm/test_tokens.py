import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import odd_rows, plain
from waylace.llm import bpe, token_files
from waylace.llm.pretokens import BYTE_LEVEL_PATTERN, splitter
from waylace.plans.scratch import scratch_path

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))


def strange_texts():
    r = random.Random(4)
    parts = ["a", "b", " ", "\n", "é", "漢", "1", "²", "!", "'s", "'ll", "\t", "𝄞", "zz", "the", " the", "\x1c", "\xa0", "_", "<|endoftext|>"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(1500)] + ["", "ab" * 5000, " " * 300]


def test_split_is_the_pattern():
    import regex

    plain_split, own = regex.compile(BYTE_LEVEL_PATTERN).findall, splitter()
    assert BYTE_LEVEL_PATTERN == tokenizers.PATTERN
    for text in strange_texts():
        assert own(text) == plain_split(text)


def test_perfect_hash_is_minimal_and_whole():
    keys = [b"k%d" % i for i in range(777)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.at(k) for k in keys) == list(range(777))
    one = bpe.PerfectHash([b"only"])
    assert one.at(b"only") == 0


def test_encoder_equals_library(reference):
    encoder = bpe.Encoder(bpe.load_vocabulary(bpe.default_vocabulary_path()), tokenizers.PATTERN)
    for text in strange_texts():
        assert encoder.encode(text) == reference.encode_ordinary(text)


def test_round_trip_query(odd, none, docs, reference):
    for df in (odd, docs):
        rows = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
        want = []
        for i, text in rows:
            ids = reference.encode_ordinary(text)
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert plain(bpe.round_trip(df), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.round_trip(none).count() == 0


def test_encode_decode_and_append(odd):
    encoded = bpe.encode_documents(odd)
    decoded = plain(bpe.decode_ids(encoded), "doc_id", "raw")
    assert decoded == sorted(((r[0], (r[1] or "").encode()) for r in odd_rows()), key=repr)
    more = bpe.append_ids(odd)
    assert more.columns == [*odd.columns, "token_ids", "decoded_sha256"]
    assert bpe.append_ids(more).columns == more.columns


def brute_positions(rows, library):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_token_positions(docs, library):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert plain(token_files.token_positions(docs), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(brute_positions(rows, library), key=repr)


def test_token_positions_odd_rows(odd, none, library):
    got = plain(token_files.token_positions(odd), "doc_id", "start", "n_tokens", "ids_crc32")
    want = brute_positions([(r[0], r[1]) for r in odd_rows()], library)
    # rows of one id may come in any order among themselves
    assert sorted((i, n, c) for i, _, n, c in got if i is not None) == sorted((i, n, c) for i, _, n, c in want if i is not None)
    assert sorted(s for _, s, _, _ in got)[0] == 0 and sum(n for *_, n, _ in got) == sum(n for *_, n, _ in want)
    single = {i for i, *_ in want if [w[0] for w in want].count(i) == 1}
    assert [x for x in got if x[0] in single] == sorted((x for x in want if x[0] in single), key=repr)
    assert token_files.token_positions(none).count() == 0


def test_files_read_back_whole_and_by_index(spark, docs, library):
    path = scratch_path(spark, "test-tokens")
    shards = token_files.write_token_files(docs, f"{path}/records", shard_bytes=1 << 17)
    assert shards > 2
    index = token_files.index_token_files(spark, f"{path}/records", f"{path}/index")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    assert {r["doc_id"]: r["ids"] for r in token_files.read_token_files(spark, f"{path}/records").collect()} == want
    picks = index.where("doc_id % 7 = 3")
    assert {r["doc_id"]: r["ids"] for r in token_files.read_token_files(spark, f"{path}/records", picks).collect()} == {i: x for i, x in want.items() if i % 7 == 3}
    ordered = [r["doc_id"] for r in index.orderBy("shard", "ordinal").collect()]
    assert ordered == sorted(texts)


def test_damage_is_found():
    data = token_files.frame(7, np.array([1, 2, 0], dtype="<u2").tobytes(), 2) + b"\n"
    assert [(i, x.tolist()) for _, _, i, x in token_files.records(data + data)] == [(7, [1, 2, 0])] * 2
    for at in range(len(data)):
        broken = bytearray(data)
        broken[at] ^= 0x40
        with pytest.raises(ValueError):
            list(token_files.records(bytes(broken)))
    with pytest.raises(ValueError):
        list(token_files.records(data[:-1]))


def test_batches_equal_whole_texts(library):
    with open(token_files.default_tokenizer_path(), encoding="utf-8") as f:
        encoder = token_files.BatchEncoder(f.read())
    texts = strange_texts()
    assert encoder.by_pretoken
    assert encoder.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts]
    with open(tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        other = token_files.BatchEncoder(f.read())
    assert not other.by_pretoken and len(other.encode(["Two words"])) == 1


def test_every_letter_number_and_space_is_split_as_the_library_does(library):
    import unicodedata

    with open(token_files.default_tokenizer_path(), encoding="utf-8") as f:
        encoder = token_files.BatchEncoder(f.read())
    signs = [c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] in "LNZ" or c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85"]
    texts = [" ".join(f"a{c}1{c}{c}!{c} {c}" for c in signs[k : k + 50]) for k in range(0, len(signs), 50)]
    assert encoder.by_pretoken
    assert encoder.encode(texts) == [np.array(e.ids, dtype="<u2").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_encoders_are_known_by_their_definition():
    paths = [tokenizers.path("byte_bpe_50k.json"), tokenizers.path("word_bpe_49k.json")]
    seen = []
    for n in range(6):
        with open(paths[n % 2], encoding="utf-8") as f:
            definition = f.read()  # dropped in turn, so that addresses are used again
        seen.append(token_files._encoder(hashlib.sha256(definition.encode()).hexdigest(), definition).encode(["Two words"])[0])
        del definition
    assert seen == [seen[0], seen[1]] * 3 and seen[0] != seen[1]


def test_alternating_definitions_in_one_session(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(1, "Two words, and some more"), (2, "another 12 text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    known = {p: brute_positions(rows, Tokenizer.from_file(tokenizers.path(p))) for p in ("byte_bpe_50k.json", "word_bpe_49k.json")}
    for n in range(10):
        name = list(known)[n % 2]
        assert plain(token_files.token_positions(df, tokenizer_path=tokenizers.path(name)), "doc_id", "start", "n_tokens", "ids_crc32") == known[name]


def test_bounds_place_keys():
    bounds = token_files.Bounds([(False, 0, 7, 0), (True, 3, -5, 2), (True, 3, -5, 9), (True, 8, 0, 0)])
    assert [bounds.shard(*k) for k in [(None, 0, 0), (None, 7, 0), (2, 9, 9), (3, -6, 0), (3, -5, 2), (3, -5, 8), (3, -5, 9), (3, 0, 0), (8, 0, 0), (9, -1, 0)]] == [0, 1, 1, 1, 2, 2, 3, 3, 4, 4]
    assert token_files.Bounds([]).shard(None, 1, 1) == 0


def test_hot_ids_spread_over_shards(spark, library):
    rows = [(None, f"row {i} without an id " * 5) for i in range(60)] + [(4, f"text {i} of one id " * 5) for i in range(60)] + [(5, "the same row " * 8)] * 60 + [(i, "x") for i in range(6, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = scratch_path(spark, "test-tokens")
    shards = token_files.write_token_files(df, f"{path}/records", shard_bytes=1000)
    index = token_files.index_token_files(spark, f"{path}/records", f"{path}/index").orderBy("shard", "ordinal").collect()
    assert shards > 12 and len(index) == len(rows)
    for hot in (None, 4, 5):
        assert len({r["shard"] for r in index if r["doc_id"] == hot}) > 3
    ids = [r["doc_id"] for r in index]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    got = token_files.starts(spark.read.parquet(f"{path}/index")).orderBy("start").collect()
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]
    assert sorted((repr(r["doc_id"]), r["ids_crc32"]) for r in got) == sorted((repr(i), c) for i, _, _, c in brute_positions(rows, library))


def test_records_are_deleted_once_they_are_indexed(spark):
    import glob

    from waylace.plans.scratch import cleared, shared_root

    folder = f"{shared_root(spark).removeprefix('file://')}/waylace"
    with cleared(spark):
        before = set(glob.glob(f"{folder}/*/records"))
        token_files.token_positions(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
        assert set(glob.glob(f"{folder}/*/records")) == before
