"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint has one bit per column of the shingle hashes: set if more than
half of them have it.  Two fingerprints within three bits of each other differ
in at most three of their eight bytes, so they share at least five positional
bytes.  A posting under one byte position would hold a 256th of all
fingerprints; the index therefore posts each distinct fingerprint under
fourteen choices of four positions.  They are the planes of the cube whose
corners are the positions, and any five corners hold exactly one of them whole,
so pairs with the guaranteed five meet, and unrelated ones do so with odds of
2^-32 a list.  In a list the shared positional bytes of each pair are tallied:
pairs with the list's four alone go, the rest are verified bit by bit.

A list never yields all its pairs: it is walked from neighbour to neighbour,
and each member is linked once to a member of its cluster.  A list longer than
``WALKED`` is not held by one task: its members are posted again under the
list's bits and each quarter of the bits that are left, one of which any two
fingerprints within three bits have in common.  Such a list has two to the
number of its free bits members at most, so four turns always end.
Copies share a fingerprint and enter the index once.

Defined results: null counts as an empty text; a text without words has
fingerprint zero and is linked like any other; a component's id is its smallest
``doc_id`` (nulls ignored; null if it has no other); repeated rows each get
their row; no rows give no rows; texts of any length are read whole; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylace.llm.arrow import map_rows
from waylace.plans.components import connected_components
from waylace.plans.scratch import discard, materialize, read_from

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
_BYTES = 8
#: Fewest positional bytes that fingerprints within MAX_BITS bits can share.
MIN_SHARED = _BYTES - MAX_BITS
#: Positions that a posting fixes.
POSTED = 4
#: A posting list longer than this is dealt again and not walked.
WALKED = 4_096
_CHUNK = 1 << 15
_ALL = (1 << 64) - 1


def fingerprint(raw: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text; zero if it has no words."""
    words = (raw or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    total = max(1, n - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, total, _CHUNK):
        if n <= width:
            shingles = iter([b" ".join(words)])
        else:
            end = min(total, at + _CHUNK)
            shingles = map(b" ".join, zip(*(words[at + k : end + k] for k in range(width)), strict=True))
        hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(ones * 2 > total, bitorder="little")
    return int(set_bits.view("<u8")[0])


def _make_fingerprint(width: int):
    def make():
        def row(doc_id, tie, raw):
            fp = fingerprint(raw, width)
            return doc_id, tie, fp - (1 << 64) if fp >> 63 else fp

        return row

    return make


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, ``tie`` (a hash that tells texts of one id apart) and ``fp``, the 64 bits as signed, for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).cast("binary").alias("raw"))
    return map_rows(rows, _make_fingerprint(width), "doc_id long, tie long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def position_masks() -> list[int]:
    """One 64-bit mask for each choice of POSTED positions whose numbers have exclusive-or zero.

    Any five of the eight positions hold exactly one such choice.
    """
    return [sum(0xFF << (8 * p) for p in (a, b, c, d)) for a, b, c, d in combinations(range(_BYTES), POSTED) if a ^ b ^ c ^ d == 0]


def finer_masks(mask: int) -> list[int]:
    """``mask`` with each of MAX_BITS + 1 parts of its free bits."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in part.tolist()) for part in np.array_split(free, MAX_BITS + 1)]


def _near(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Which pairs pass the tally of shared positional bytes and then the check of bits."""
    diff = a ^ b
    shared = (diff.view(np.uint8).reshape(-1, _BYTES) == 0).sum(axis=1)
    ok = shared >= MIN_SHARED
    ok[ok] = np.bitwise_count(diff[ok]) <= MAX_BITS
    return ok


def _walk(values: np.ndarray) -> list[tuple[int, int]]:
    """Links that join each cluster of a short list, one for each further member."""
    links = []
    left = values
    while len(left) > 1:
        root, stack, left = left[0], [left[0]], left[1:]
        while stack and len(left):
            hit = _near(left, stack.pop())
            if hit.any():
                found = left[hit]
                left = left[~hit]
                links += [(int(root), int(x)) for x in found]
                stack += list(found)
    return links


_LINKS = pa.schema([("mask", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])


def _posting_links(batches: Iterator[pa.RecordBatch], walked: int = WALKED) -> Iterator[pa.RecordBatch]:
    """Links in each posting list of rows sorted by (mask, key, fingerprint), with null masks.

    Members of a list that is too long to walk come back as (mask, fingerprint, null).
    """

    def links(out: list[tuple[int, int]]) -> pa.RecordBatch:
        u, v = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()), pa.array(map(_signed, u), pa.int64()), pa.array(map(_signed, v), pa.int64())], schema=_LINKS)

    def again(mask: int, fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), mask)), pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64())], schema=_LINKS)

    open_mask, open_key, held, too_long = 0, None, np.zeros(0, np.uint64), False
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        mask, key, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        fps = fps.view(np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))))
        ends = np.append(starts[1:], n)
        out: list[tuple[int, int]] = []
        if (mask[0], key[0]) != (open_mask, open_key):
            out += _walk(held)
            open_mask, open_key, held, too_long = int(mask[0]), int(key[0]), np.zeros(0, np.uint64), False
        # the first list of the batch goes on with what is held; only the last may go on in the next batch
        held = np.concatenate([held, fps[: ends[0]]])
        if too_long or len(held) > walked:
            yield again(open_mask, held)
            held, too_long = np.zeros(0, np.uint64), True
        if len(starts) > 1:
            out += _walk(held)
            inner, lengths = starts[1:-1], ends[1:-1] - starts[1:-1]
            twos = inner[lengths == 2]
            if len(twos):
                good = twos[_near(fps[twos], fps[twos + 1])]
                out += zip(fps[good].tolist(), fps[good + 1].tolist(), strict=True)
            for s, length in zip(inner[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
                if length > walked:
                    yield again(int(mask[s]), fps[s : s + length])
                else:
                    out += _walk(fps[s : s + length])
            open_mask, open_key, held, too_long = int(mask[starts[-1]]), int(key[starts[-1]]), fps[starts[-1] :].copy(), False
            if len(held) > walked:
                yield again(open_mask, held)
                held, too_long = np.zeros(0, np.uint64), True
        if out:
            yield links(out)
    if out := _walk(held):
        yield links(out)


def _dealt(posted: DataFrame, walked: int) -> DataFrame:
    """Links of postings ``(mask, fp)`` and the members of lists that are too long."""
    keyed = posted.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    return keyed.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(partial(_posting_links, walked=walked), "mask long, u long, v long")


def near_links(distinct: DataFrame, fp: str = "fp", walked: int = WALKED) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints that join every pair within MAX_BITS bits.

    One link ties each further member of a posting list's cluster to it; a pair
    may thus be joined through others.  ``walked`` is at least 2 ** MAX_BITS, as
    a list with fewer free bits than parts cannot be dealt again.
    """
    masks = [F.lit(_signed(m)).cast("long") for m in position_masks()]
    found = materialize(_dealt(distinct.select(F.col(fp).alias("fp"), F.explode(F.array(*masks)).alias("mask")), walked), "links")
    tables, links = [found], found.where("mask is null").select("u", "v")
    while coarse := [r["mask"] for r in found.where("mask is not null").select("mask").distinct().collect()]:  # few: the parts of fourteen masks
        finer = F.element_at(F.create_map(*[x for m in coarse for x in (F.lit(m).cast("long"), F.array(*[F.lit(_signed(f)).cast("long") for f in finer_masks(m & _ALL)]))]), F.col("mask"))
        found = materialize(_dealt(found.where("mask is not null").select(F.col("u").alias("fp"), F.explode(finer).alias("mask")), walked), "links")
        tables.append(found)
        links = links.unionByName(found.where("mask is null").select("u", "v"))
    if len(tables) == 1:
        return read_from(links, found)
    whole = materialize(links.distinct(), "links")
    for table in tables:
        discard(table)
    return whole


def _classified(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """All rows with their fingerprints, and ``(fp, root, component_id)`` of each fingerprint."""
    rows = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    links = near_links(distinct)
    roots = connected_components(links)
    discard(links)
    rooted = materialize(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "components")
    classes = materialize(rooted.join(smallest, "root").select("fp", "root", "component_id"), "classes")
    for table in (distinct, rooted, smallest):
        discard(table)
    return rows, classes


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (hex) and ``component_id``."""
    rows, classes = _classified(docs, id_col, text_col, width)
    return rows.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row for each component, the one with its smallest id; all columns stay.

    Null ids come last; of rows that share that id, one stays.
    """
    rows, classes = _classified(docs, id_col, text_col, width)
    stay = first_rows(rows, classes, "fp")
    for table in (rows, classes):
        discard(table)
    return picked_rows(docs, stay, id_col, text_col)


def first_rows(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """``(id, tie, n)`` of the first row for each ``root`` of ``classes`` (by ``key``); ``rows`` has ``doc_id, tie`` and ``key`` for each."""
    counted = rows.groupBy("doc_id", "tie", key).agg(F.count("*").alias("n")).join(classes.select(key, "root"), key)
    first = counted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "n")).alias("first"))
    return materialize(first.select(F.col("first.doc_id").alias("id"), F.col("first.tie").alias("tie"), F.col("first.n").alias("n")), "stay")


def picked_rows(docs: DataFrame, stay: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``stay`` (:func:`first_rows`) names, once each."""
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(F.col(text_col)).alias("own_tie"))
    joined = packed.join(stay, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_tie") == F.col("tie")))
    once = joined.where("n = 1").select("row.*")
    if stay.where("n > 1").isEmpty():
        return once
    return once.unionByName(joined.where("n > 1").dropDuplicates(["own_id", "own_tie"]).select("row.*"))
