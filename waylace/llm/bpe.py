"""Byte-level BPE with a two-tier lookup.

A pre-token that is a whole vocabulary entry is resolved by a minimal perfect
hash (hash and displace: one hash of the bytes, one displacement per bucket,
one comparison).  Any other pre-token goes through the merges: its bytes form a
linked list, adjacent pairs that are entries wait in a heap by (rank, place),
and stale heap items are skipped.  A pre-token of ``n`` bytes thus costs
``O(n log n)`` however long it is.  Results are remembered in a bounded memo in
each worker process.

The vocabulary (about 50,000 entries) is sent to the tasks once.

Defined results: null counts as an empty text and gives no ids; decoding the
ids gives the text's UTF-8 bytes back; rows that repeat an id each get their
row; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waylace.llm.arrow import append_columns, map_rows
from waylace.llm.pretokens import Memo, splitter

#: Pre-tokens that a worker process remembers; the memo is emptied between texts.
MEMO_ENTRIES = 500_000
_BUCKET = 4
_SEEDS = 64
_TRIALS = 2_000_000
#: A prime, so that its multiples visit every pair.
_SCATTER = 2_654_435_761
_DEAD = -1


class PerfectHash:
    """Minimal perfect hash from the keys to ``range(len(keys))`` places.

    A bucket's keys move together: place = first + turn * step + extra, modulo
    the number of keys.  Pairs (turn, extra) are tried in a fixed scattered order
    that reaches all of them; should none fit (two keys of one bucket that hash
    alike), everything is hashed again with another seed.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = max(1, len(keys)), max(1, -(-len(keys) // _BUCKET))
        for self.seed in range(_SEEDS):
            if self._build(keys):
                return
        raise ValueError("keys repeat")

    def _build(self, keys: list[bytes]) -> bool:
        n = self.n
        groups: list[list[tuple[int, int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            b, first, step = self._hash(key)
            groups[b].append((first, step, i))
        taken = bytearray(n)
        self.shift = [0] * self.buckets  # turn and extra in one number, by divmod with n
        self.place = np.zeros(len(keys), dtype=np.int64)
        free = None
        for b in sorted(range(self.buckets), key=lambda x: -len(groups[x])):
            group = groups[b]
            if not group:
                break
            if len(group) == 1:  # these come last: any free place will do
                free = free or iter([p for p in range(n) if not taken[p]])
                spot = next(free)
                first, _, i = group[0]
                self.shift[b], self.place[i] = (spot - first) % n, spot
                continue
            for trial in range(min(n * n, _TRIALS)):
                turn, extra = divmod(trial * _SCATTER % (n * n), n)
                at = [(first + turn * step + extra) % n for first, step, _ in group]
                if len(set(at)) == len(at) and not any(taken[p] for p in at):
                    break
            else:
                return False
            self.shift[b] = turn * n + extra
            for p, (_, _, i) in zip(at, group, strict=True):
                taken[p] = 1
                self.place[i] = p
        return True

    def _hash(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key, self.seed)
        return (h & 0xFFFFFFFF) % self.buckets, (h >> 32 & 0xFFFFFFFF) % self.n, h >> 64 & 0xFFFFFFFF

    def at(self, key: bytes) -> int:
        """The key's place; some place or other for bytes that are no key."""
        b, first, step = self._hash(key)
        turn, extra = divmod(self.shift[b], self.n)
        return (first + turn * step + extra) % self.n


class Vocabulary:
    """Entries by id, ids by entry through a perfect hash, and the merges."""

    def __init__(self, entries: dict[bytes, int]):
        keys = list(entries)
        self.hash = PerfectHash(keys)
        self.key_at: list[bytes] = [b""] * len(keys)
        self.id_at = [0] * len(keys)
        for key, place in zip(keys, self.hash.place.tolist(), strict=True):
            self.key_at[place], self.id_at[place] = key, entries[key]
        del self.hash.place
        self.bytes_of = {i: key for key, i in entries.items()}

    def whole(self, token: bytes) -> int | None:
        """The id of an entry, or None."""
        place = self.hash.at(token)
        return self.id_at[place] if self.key_at[place] == token else None


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    """A vocabulary from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


class Encoder:
    """Encodes pre-tokens; one for each worker process, whose tasks share its memo."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.split = splitter(pattern)
        self.rank = {key: i for i, key in vocabulary.bytes_of.items()}
        self.memo = Memo(self.pretoken)
        pairs = [self.rank.get(bytes((a, b)), _DEAD) for a in range(256) for b in range(256)]
        self.two = lambda a, b: pairs[a << 8 | b]

    def merged(self, token: bytes) -> list[int]:
        """Ids after all merges: lowest rank first, leftmost among equals."""
        rank, n = self.rank.get, len(token)
        waiting = list(map(self.two, token, token[1:]))
        heap = [r << 32 | i for i, r in enumerate(waiting) if r >= 0]
        if not heap:
            return [self.rank[token[i : i + 1]] for i in range(n)]
        waiting.append(_DEAD)
        ends = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            if waiting[i] != top >> 32:
                continue
            j = ends[i]
            ends[i] = end = ends[j]
            waiting[j] = _DEAD
            if end < n:
                before[end] = i
                waiting[i] = r = rank(token[i : ends[end]], _DEAD)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            else:
                waiting[i] = _DEAD
            if i:
                p = before[i]
                waiting[p] = r = rank(token[p:end], _DEAD)
                if r >= 0:
                    heappush(heap, r << 32 | p)
        ids, i = [], 0
        while i < n:
            j = ends[i]
            ids.append(self.rank[token[i:j]])
            i = j
        return ids

    def pretoken(self, token: str) -> tuple[int, ...]:
        raw = token.encode()
        whole = self.vocabulary.whole(raw)
        return (whole,) if whole is not None else tuple(self.merged(raw))

    def encode(self, text: str | None) -> list[int]:
        tokens = self.split(text or "")
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        return list(chain.from_iterable(map(self.memo.__getitem__, tokens)))


_encoders: dict[tuple[int, str], Encoder] = {}


def _encoder(shared, pattern: str) -> Encoder:
    """This process's encoder for a broadcast vocabulary."""
    key = (id(shared.value), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value, pattern)
    return _encoders[key]


def default_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _shared(docs: DataFrame, path: str | None):
    return docs.sparkSession.sparkContext.broadcast(load_vocabulary(path or default_vocabulary_path()))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)``."""
    shared, pattern = _shared(docs, path), pattern or default_pattern()

    def make():
        encoder = _encoder(shared, pattern)
        return lambda doc_id, text: (doc_id, encoder.encode(text))

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), text_col), make, schema)


def append_ids(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", digest_col: str = "decoded_sha256", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with all its columns, the ids of its texts and the SHA-256 of what they decode to.

    Columns that have these two names already are replaced.
    """
    shared, pattern = _shared(docs, path), pattern or default_pattern()

    def make():
        encoder = _encoder(shared, pattern)
        entry = shared.value.bytes_of.__getitem__

        def row(text):
            ids = encoder.encode(text)
            return ids, hashlib.sha256(b"".join(map(entry, ids))).hexdigest()

        return row

    return append_columns(docs.drop(ids_col, digest_col), make, [text_col], f"{ids_col} array<int>, {digest_col} string")


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``(doc_id, raw binary)``: the bytes that the ids stand for; null ids give no bytes."""
    shared = _shared(encoded, path)

    def make():
        entry = shared.value.bytes_of.__getitem__
        return lambda doc_id, ids: (doc_id, b"".join(map(entry, ids or [])))

    schema = T.StructType([T.StructField("doc_id", encoded.schema[id_col].dataType), T.StructField("raw", T.BinaryType())])
    return map_rows(encoded.select(F.col(id_col).alias("doc_id"), ids_col), make, schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids and of their decoding."""
    shared, pattern = _shared(docs, path), pattern or default_pattern()

    def make():
        encoder = _encoder(shared, pattern)
        entry = shared.value.bytes_of.__getitem__
        decimal = {i: str(i) for i in shared.value.bytes_of}.__getitem__

        def row(doc_id, text):
            ids = encoder.encode(text)
            written = hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest()
            return doc_id, len(ids), written, hashlib.sha256(b"".join(map(entry, ids))).hexdigest()

        return row

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col)
    return map_rows(rows, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
