"""Near-duplicates by similarity of word shingles: SimHash, then a wider byte-position index.

The pipeline's form of :mod:`waylace.llm.simhash`.  Two texts are
near-duplicates if the Jaccard similarity of their sets of five-word shingles is
at least 0.8.  The 64-bit SimHash of each set goes through that module's
byte-position index, tally and check of bits; texts that it links are verified
on their shingles.  One 64-bit SimHash cannot find all pairs: texts at 0.8
differ in some ten bits.  Each text therefore also has 125 minimum hashes (minima of keyed hashes
of its shingles), of which one byte each is kept as its positional bytes.  The
index posts a text under 25 choices of five positions, with the whole
fingerprints there: a pair at 0.8 shares no choice with odds of 5e-5, fewer
above.  For each pair the shared positional bytes are tallied; those with fewer
than ``LEAST_EQUAL`` of them (four standard deviations below what 0.8 gives) go,
the rest are verified on the whole sets of 64-bit shingle hashes, so no pair
below 0.8 is linked.

A list of the wider index does not yield all its pairs.  Neighbours in it are verified
first, with what the SimHash links; then, only in lists that still hold several components, each member with
the one of another component that it shares most positional bytes with, twice;
and then all pairs that are left across components and may be similar: pairs
with a shingle in common that at most ``RARE`` of these texts have, and pairs
whose intersection could be large enough by more frequent shingles alone.  What
only one text has is in no intersection, so edited copies that no text is close
to drop out before they are paired.  Shingle sets are made again
for the texts of tallied pairs alone and are never stored for the corpus.  Texts
of one shingle set enter the index once.

Defined results: null counts as an empty text; texts without words are equal to
each other; a text of fewer words than a shingle is one shingle; texts of any
length are read whole; otherwise as in :mod:`waylace.llm.simhash`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waylace.llm import simhash
from waylace.llm.arrow import map_rows
from waylace.llm.simhash import first_rows, picked_rows
from waylace.plans.components import connected_components
from waylace.plans.scratch import discard, materialize

SHINGLE_WORDS = 5
BANDS, BAND_ROWS = 25, 5
#: Least share of equal fingerprints for a verification: 0.8 less four standard deviations.
LEAST_EQUAL = 0.65
SEED = 42
#: Texts that have a rare shingle, at most.
RARE = 16
#: Parts in which a list is chained.
SALTS = 8
_CHUNK = 512
_BLOCK = 256
_A, _B = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64)
_A |= np.uint64(1)


def shingle_hashes(raw: bytes | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text; none if it has no words."""
    words = (raw or b"").lower().split()
    if not words:
        return np.array([], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[k : len(words) - width + 1 + k] for k in range(width)), strict=True))
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64, count=len(words) - width + 1))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The fingerprints of a set of shingles."""
    low = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(low, (hashes[at : at + _CHUNK] * _A + _B).min(axis=1), out=low)
    return low


def simhash_of(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingles: bits that over half of the hashes have; zero for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _make():
    def row(doc_id, tie, raw):
        hashes = shingle_hashes(raw)
        low = signature(hashes)
        keys = [_signed(xxhash.xxh64_intdigest(low[k : k + BAND_ROWS].tobytes(), k)) for k in range(0, len(low), BAND_ROWS)]
        brief = (low >> np.uint64(56)).astype(np.uint8).tobytes()
        return doc_id, tie, _signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)), len(hashes), _signed(simhash_of(hashes)), keys, brief

    return row


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row ``doc_id, tie``, the ``node`` of its shingle set, the set's ``size`` and SimHash ``fp``, ``keys`` of bands and ``brief`` fingerprints."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).cast("binary").alias("raw"))
    return map_rows(rows, _make, "doc_id long, tie long, node long, size int, fp long, keys array<long>, brief binary")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least 0.8."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * common >= 4 * (len(a) + len(b) - common)


def _make_check():
    return lambda u, v, a, b: (u, v, similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)))


def _make_set():
    return lambda node, raw: (node, shingle_hashes(raw).tobytes())


def _sets(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(node, hashes)`` for the ends of ``pairs``, from the texts that stand for them."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    stay = materialize(nodes.join(ends, "node", "left_semi").select("node", "id", "tie", "n"), "named")
    texts = docs.select(F.col(id_col).cast("long").alias("own_id"), F.xxhash64(F.col(text_col)).alias("own_tie"), F.col(text_col).cast("binary").alias("raw"))
    joined = texts.join(stay, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_tie") == F.col("tie")))
    once = joined.where("n = 1").select("node", "raw")
    if not stay.where("n > 1").isEmpty():
        once = once.unionByName(joined.where("n > 1").dropDuplicates(["node"]).select("node", "raw"))
    out = materialize(map_rows(once, _make_set, "node long, hashes binary"), "sets")
    discard(stay)
    return out


_SHINGLES = pa.schema([("node", pa.int64()), ("h", pa.int64())])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, h)`` for each shingle of rows ``(node, hashes)``."""
    for batch in batches:
        for node, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = np.frombuffer(hashes, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node)), pa.array(h)], schema=_SHINGLES)


def _shared(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, shared, often)``: how many shingles of each set another one has too, and how many more than ``RARE`` have; and pairs ``(u, v)`` with one in common that at most ``RARE`` have."""
    shingles = materialize(sets.mapInArrow(_shingles, "node long, h long"), "shingles")
    counts = materialize(shingles.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    known = materialize(shingles.join(counts, "h"), "known")
    sizes = materialize(known.groupBy("node").agg(F.count("*").cast("int").alias("shared"), F.count_if(F.col("n") > RARE).cast("int").alias("often")), "shared")
    few = known.where(F.col("n") <= RARE).groupBy("h").agg(F.collect_list("node").alias("ns"))  # at most RARE
    both = F.flatten(F.transform("ns", lambda x: F.transform(F.filter("ns", lambda y: y > x), lambda y: F.struct(x.alias("u"), y.alias("v")))))
    pairs = materialize(few.select(F.explode(both).alias("p")).select("p.*").distinct(), "rare-pairs")
    for table in (shingles, counts, known):
        discard(table)
    return sizes, pairs


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, sets: DataFrame | None = None) -> DataFrame:
    """Those of the distinct ``pairs`` that are similar, as a table."""
    sets = _sets(pairs, nodes, docs, id_col, text_col) if sets is None else sets
    whole = pairs
    for end, name in (("u", "a"), ("v", "b")):
        whole = whole.join(sets.select(F.col("node").alias(end), F.col("hashes").alias(name)), end)
    near = materialize(map_rows(whole.select("u", "v", "a", "b"), _make_check, "u long, v long, near boolean").where("near").select("u", "v"), "near")
    discard(sets)
    return near


def _bytes(column: pa.Array) -> np.ndarray:
    """Positional bytes by row."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


_PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``(u, v, a, b)`` whose positional bytes are equal often enough."""
    for batch in batches:
        if batch.num_rows:
            fine = (_bytes(batch.column(2)) == _bytes(batch.column(3))).mean(axis=1) >= LEAST_EQUAL
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_PAIRS).filter(pa.array(fine))


def _tally(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs`` that may be similar by size and by the tally of shared positional bytes."""
    for end, size, brief in (("u", "m", "a"), ("v", "n", "b")):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("size").alias(size), F.col("brief").alias(brief)), end)
    return pairs.where("5 * least(m, n) >= 4 * greatest(m, n)").select("u", "v", "a", "b").mapInArrow(_tallied, "u long, v long")


def _cross_pairs(batches: Iterator[pa.RecordBatch], best: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs across components in lists of rows sorted by key that may be similar; with ``best`` one for each row at most, that with the most positional bytes."""

    def pairs_of(node: np.ndarray, root: np.ndarray, size: np.ndarray, often: np.ndarray, brief: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, group, counts = np.unique(root, return_inverse=True, return_counts=True)
        order = np.argsort(group == counts.argmax(), kind="stable")  # members of the largest component last
        node, group, size, often, brief = node[order], group[order], size[order], often[order], brief[order]
        found: list[tuple[int, int]] = []
        top = np.zeros(len(node)), np.full(len(node), -1)
        for i in range(len(node) - int(counts.max())):
            for at in range(i + 1, len(node), _BLOCK):
                j = np.arange(at, min(at + _BLOCK, len(node)))
                fits = 9 * np.minimum(often[j], often[i]) >= 4 * (size[j] + size[i])  # the intersection that 0.8 needs
                j = j[(group[j] != group[i]) & fits & (5 * np.minimum(size[j], size[i]) >= 4 * np.maximum(size[j], size[i]))]
                equal = (brief[j] == brief[i]).mean(axis=1) if len(j) else np.zeros(0)
                j, equal = j[equal >= LEAST_EQUAL], equal[equal >= LEAST_EQUAL]
                if not len(j):
                    continue
                if not best:
                    found += [(i, k) for k in j.tolist()]
                    continue
                k = int(equal.argmax())
                if equal[k] > top[0][i]:
                    top[0][i], top[1][i] = equal[k], j[k]
                more = equal > top[0][j]
                top[0][j[more]], top[1][j[more]] = equal[more], i
            if len(found) >= _BLOCK:
                yield emit(node, found)
                found = []
        found += [(i, k) for i, k in enumerate(top[1].tolist()) if k >= 0]
        if found:
            yield emit(node, found)

    def emit(node: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch:
        u, v = (node[list(c)] for c in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], schema=_PAIRS)

    open_key, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        parts = [*(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3, 4)), _bytes(batch.column(5))]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).tolist()
        for s, e in zip(starts, [*starts[1:], len(key)], strict=True):
            here = [x[s:e] for x in parts]
            if held is not None and key[s] == open_key:
                held = [np.concatenate(x) for x in zip(held, here, strict=True)]
                continue
            if held is not None:
                yield from pairs_of(*held)
            open_key, held = int(key[s]), here
    if held is not None:
        yield from pairs_of(*held)


def _lists(nodes: DataFrame) -> DataFrame:
    """``(node, key)`` of the index's lists that have several members, as a table."""
    posted = materialize(nodes.select("node", F.explode("keys").alias("key")), "posted")
    several = posted.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    lists = materialize(posted.join(several, "key"), "lists")
    discard(posted)
    return lists


def _chain(lists: DataFrame) -> DataFrame:
    """Distinct pairs ``(u, v)`` that join all members of each list.

    A list is chained in ``SALTS`` parts, so that a hot one is no single task's,
    and then the first members of its parts.
    """
    part = F.pmod(F.xxhash64("node"), F.lit(SALTS))
    before = F.lag("node").over(Window.partitionBy("key", "part").orderBy("node"))
    linked = materialize(lists.withColumn("part", part).select("key", before.alias("u"), F.col("node").alias("v")), "linked")
    first = F.lag("v").over(Window.partitionBy("key").orderBy("v"))
    heads = linked.where("u is null").select(first.alias("u"), "v").where("u is not null")
    out = materialize(linked.where("u is not null").select("u", "v").unionByName(heads).distinct(), "chain")
    discard(linked)
    return out


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Distinct pairs ``(u, v)``: nodes with links between their SimHashes, and a chain of those that share one."""
    known = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")), "simhashes")
    links = simhash.near_links(known)
    ends = links.join(known.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(known.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v").select("a", "b")
    several = nodes.join(known.where("first <> last").select("fp"), "fp").select("node", F.col("fp").alias("key"))
    out = materialize(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).unionByName(_chain(several)).distinct(), "simhash-pairs")
    for table in (links, known):
        discard(table)
    return out


def _proposed(chain: DataFrame, pairs: DataFrame) -> DataFrame:
    """The distinct pairs of two tables, as a table."""
    out = materialize(chain.unionByName(pairs).distinct(), "proposed")
    for table in (chain, pairs):
        discard(table)
    return out


def near_links(rows: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links ``(u, v)`` that join all similar nodes of ``rows`` (:func:`sketches` of ``docs``) that the SimHash links or that meet in the index."""
    own = rows.groupBy("node", "doc_id", "tie").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", "fp", "keys", "brief")])
    stands = F.min(F.struct("doc_id", "tie", "n")).alias("row")  # any row of the node will do
    nodes = own.groupBy("node").agg(stands, *[F.first(c).alias(c) for c in ("size", "fp", "keys", "brief")])
    nodes = materialize(nodes.select("node", "size", "fp", "keys", "brief", F.col("row.doc_id").alias("id"), F.col("row.tie").alias("tie"), F.col("row.n").alias("n")), "nodes")
    lists = _lists(nodes)
    chain = _proposed(_chain(lists), _simhash_pairs(nodes))
    alike = materialize(_tally(chain, nodes), "alike")
    links, tested = _verified(alike, nodes, docs, id_col, text_col), chain
    for best in (True, True, False):  # the likeliest pairs join most components, so that few pairs are left across them
        more, pairs = _across(links, tested, lists, nodes, docs, id_col, text_col, best)
        whole, all_tested = materialize(links.unionByName(more), "near-links"), materialize(tested.unionByName(pairs), "tested")
        for table in (links, more, tested, pairs):
            discard(table)
        links, tested = whole, all_tested
    for table in (lists, alike, tested, nodes):
        discard(table)
    return links


def _across(links: DataFrame, tested: DataFrame, lists: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, best: bool) -> tuple[DataFrame, DataFrame]:
    """Further links across the components that ``links`` leave in ``lists``, and the pairs that were verified for them."""
    roots = materialize(connected_components(links), "near-roots")
    rooted = materialize(lists.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "rooted-lists")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    whole, sets, rare = rooted.join(mixed, "key"), None, None
    brief = nodes.select("node", "size", "brief")
    if best:
        whole = whole.join(brief, "node").withColumn("often", F.col("size"))
    else:
        whole = materialize(whole, "mixed")
        sets = _sets(whole.select(F.col("node").alias("u"), F.col("node").alias("v")), nodes, docs, id_col, text_col)
        sizes, rare = _shared(sets)
        # a text that shares less than four fifths of its own shingles is similar to none
        own = materialize(whole.select("node", "root").distinct().join(brief.drop("brief"), "node").join(sizes, "node").where("5 * shared >= 4 * size"), "own")
        whole = whole.join(brief, "node").join(own.select("node", "often"), "node")
        for end, names in (("u", ("ru", "m", "a")), ("v", ("rv", "n", "b"))):
            rare = rare.join(own.select(F.col("node").alias(end), *[F.col(c).alias(x) for c, x in zip(("root", "size", "shared"), names, strict=True)]), end)
        rare = rare.where("ru <> rv and 9 * least(a, b) >= 4 * (m + n) and 5 * least(m, n) >= 4 * greatest(m, n)").select("u", "v")
    crossed = whole.select("key", "node", "root", "size", "often", "brief").repartition("key").sortWithinPartitions("key", "node").mapInArrow(partial(_cross_pairs, best=best), "u long, v long")
    crossed = crossed if rare is None else crossed.unionByName(rare)
    pairs = materialize(crossed.distinct().join(tested, ["u", "v"], "left_anti"), "crossed")
    more = _verified(pairs, nodes, docs, id_col, text_col, sets)
    for table in (roots, rooted):
        discard(table)
    return more, pairs


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each component, as :func:`waylace.llm.simhash.keep_one_of_each`."""
    rows = materialize(sketches(docs, id_col, text_col), "sketches")
    links = near_links(rows, docs, id_col, text_col)
    roots = connected_components(links)
    discard(links)
    nodes = rows.select("node").distinct()
    classes = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    stay = first_rows(rows, classes, "node")
    discard(rows)
    return picked_rows(docs, stay, id_col, text_col)
