"""Mixing sources to target weights by blocks, shards and permutations.

The words of a source, in order of ``doc_id``, are packed into blocks of a
fixed number of words (``BLOCK_WORDS``; a source of less than ``FINE`` such
blocks has shorter ones, down to a word, so that its target is met as well); the
last block of a source may be short.  The mix has a number of slots for each
source, and output shards of ``SHARD_SLOTS`` slots on average.  A source's counts
in the shards are one multinomial draw of its slots over all shards, made first
over groups of shards and then within each group; the totals stay exact, and a
source needs nothing of any other, so there is no limit to their number and no
table of them on the driver.  A source's slot ``j`` reads block
``perm(j mod n)`` of its ``n`` blocks, with a keyed Feistel permutation for each
pass ``j div n``; slots and blocks are then joined by block index.  Every draw
is keyed by ``seed`` and the source's rank, so reruns agree.  All of this is the
same at every size.

No source is one task's work: offsets and ranks come from range partitionings and
sums by partition, a source's slots are drawn by groups of shards, and all joins
are by (source, block).

Defined results: null text has size 0 and takes nothing; a null source is a
source of its own, last in order; rows that repeat an id count separately;
if all sizes are 0 all targets are 0; no rows give no rows; further columns
are ignored, and kept by :func:`mixed_documents`; a text of any length is cut into
as many blocks as it needs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waylace.llm.arrow import append_columns, map_rows
from waylace.plans.scratch import discard, materialize

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 32
SHARD_SLOTS = 4_096
SEED = 20_240_501
#: A source has at least so many blocks, or one for each word.
FINE = 256
#: Shards whose slots of a source are drawn together.
GROUP_SHARDS = 16
#: Slots that a task draws, until there are ``MOST_TASKS``.
TASK_SLOTS = 1 << 16
MOST_TASKS = 20_000


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``doc_id, source, size`` in words and ``tie``, a hash of the text that orders rows of one id."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.xxhash64(F.col(text_col)), F.col(text_col).cast("binary"))

    def make():
        return lambda doc_id, source, tie, raw: (doc_id, source, len(raw.split()) if raw else 0, tie)  # bytes split at 0x20 and 0x09-0x0D

    return map_rows(rows, make, "doc_id long, source string, size long, tie long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """``source, rank, source_size, weight, target`` from ``(source, size)`` rows.

    Weights repeat along the sources in code-point order, nulls last.  Targets
    share the sum of all sizes by weight; those above ``max_repeats`` times
    their source's size stop there and the excess is shared again by weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = materialize(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "totals")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row for each partition
    bases = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = dealt.withColumn("place", place).join(F.broadcast(bases), "part").select("source", "source_size", (F.col("base") + F.col("place") - 1).cast("long").alias("rank"))
    ranked = materialize(ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))), "sources")
    discard(dealt)
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.col("source_size") * float(max_repeats)
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * level > cap
        n, fixed, open_weight = ranked.agg(F.count_if(over), F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight or n == capped:
            break
        capped, level = n, (total - fixed) / open_weight
    return ranked.withColumn("target", F.least(F.col("weight") * level, cap))


_OFFSETS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("tie", pa.int64()), ("part", pa.int32()), ("before", pa.int64())])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words before each row within its partition and source; rows come sorted by source."""
    last, carry = object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        source = batch.column(1).to_pylist()
        size = batch.column(2).to_numpy(zero_copy_only=False)
        before = np.zeros(len(size), dtype=np.int64)
        at = 0
        while at < len(size):
            end = at
            while end < len(size) and source[end] == source[at]:
                end += 1
            if source[at] != last:
                last, carry = source[at], 0
            sums = np.cumsum(size[at:end])
            before[at:end] = carry + sums - size[at:end]
            carry += int(sums[-1])
            at = end
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], schema=_OFFSETS)


def _placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` with ``rank`` and ``start``: words of the source before the document."""
    order = ["source", "doc_id", "size", "tie"]
    dealt = sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    rows = materialize(dealt.mapInArrow(_running, "doc_id long, source string, size long, tie long, part int, before long"), "offsets")
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    window = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("words").over(window), F.lit(0)).alias("base"))
    base = materialize(base.join(sources.select(F.col("source").alias("s2"), "rank", "block_words"), F.col("s").eqNullSafe(F.col("s2"))).select("s", "p", "base", "rank", "block_words"), "bases")
    placed = rows.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select("doc_id", "source", "size", "tie", "rank", "block_words", (F.col("base") + F.col("before")).alias("start"))
    out = materialize(placed, "placed")
    discard(rows)
    discard(base)
    return out


def with_slots(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``sources`` with the ``block_words``, ``blocks`` and ``slots`` of each."""
    size = F.col("source_size")
    words = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(size / FINE))).cast("long")
    rows = sources.withColumn("block_words", words).withColumn("blocks", F.ceil(size / F.col("block_words")).cast("long"))
    wanted = F.rint(F.col("target") * F.col("blocks") / F.greatest(size, F.lit(1))).cast("long")
    return rows.withColumn("slots", F.least(wanted, MAX_REPEATS * F.col("blocks")))


def group_counts(slots: int, shards: int, rank: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of shards that have slots of a source, and how many: a multinomial draw over equal shards."""
    rng = np.random.default_rng([seed, rank])
    groups = -(-shards // GROUP_SHARDS)
    if slots <= groups:
        return np.unique(rng.integers(0, shards, slots) // GROUP_SHARDS, return_counts=True)
    share = np.full(groups, GROUP_SHARDS / shards)
    share[-1] = (shards - (groups - 1) * GROUP_SHARDS) / shards
    counts = rng.multinomial(slots, share / share.sum())
    found = np.flatnonzero(counts)
    return found, counts[found]


def group_shards(count: int, group: int, shards: int, rank: int, seed: int) -> np.ndarray:
    """The shard of each of a source's slots in a group, ascending: a multinomial draw over the group's shards."""
    n = min(GROUP_SHARDS, shards - group * GROUP_SHARDS)
    counts = np.random.default_rng([seed, rank, group]).multinomial(count, np.full(n, 1 / n))
    return group * GROUP_SHARDS + np.repeat(np.arange(n), counts)


def permuted(index: np.ndarray, n: int, key: int | list[int]) -> np.ndarray:
    """Images of ``index`` under a keyed permutation of ``range(n)``: a Feistel network with cycle walking."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    rounds = [np.uint64(x) for x in np.random.default_rng(key).integers(0, 1 << 63, size=4)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in rounds:
            mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            left, right = right, left ^ (mixed & mask)
        return left << shift | right

    out = once(index.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


_GROUPS = pa.schema([("rank", pa.int64()), ("blocks", pa.int64()), ("group", pa.int64()), ("count", pa.int64()), ("before", pa.int64())])
_SLOTS = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("rank", pa.int64()), ("epoch", pa.int32()), ("block", pa.int64())])
#: Rows of a batch.
_AT_ONCE = 1 << 16


def _batches(rows: Iterator[list[np.ndarray]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Columns by columns, put together to batches of some size."""
    held, n = [], 0
    for columns in rows:
        held.append(columns)
        n += len(columns[0])
        if n >= _AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _grouped(shards: int, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            for rank, blocks, slots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                group, count = group_counts(slots, shards, rank, seed)
                for at in range(0, len(group), _AT_ONCE):
                    g, c = group[at : at + _AT_ONCE], count[at : at + _AT_ONCE]
                    yield [np.full(len(g), rank), np.full(len(g), blocks), g, c, count[:at].sum() + np.cumsum(c) - c]

    return lambda batches: _batches(rows(batches), _GROUPS)


def _drawn(shards: int, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            for rank, blocks, group, count, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = group_shards(count, group, shards, rank, seed)
                place = np.random.default_rng([seed, rank, group, 1]).integers(0, 1 << 62, count)
                j = np.arange(before, before + count)
                epoch, index = j // blocks, j % blocks
                block = np.empty(count, dtype=np.int64)
                for e in np.unique(epoch).tolist():
                    here = epoch == e
                    block[here] = permuted(index[here], blocks, [seed, rank, e])
                for at in range(0, count, _AT_ONCE):
                    some = slice(at, at + _AT_ONCE)
                    yield [shard[some], place[some], np.full(len(shard[some]), rank), epoch[some], block[some]]

    return lambda batches: _batches(rows(batches), _SLOTS)


def mix_plan(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix as ``(shard, slot, rank, epoch, block)`` rows; a trainer reads each shard in order of ``slot``."""
    total = sources.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // shard_slots))
    groups = sources.where("slots > 0").select("rank", "blocks", "slots").mapInArrow(_grouped(shards, seed), "rank long, blocks long, group long, count long, before long")
    tasks = max(1, min(total // TASK_SLOTS, MOST_TASKS))
    return groups.repartition(tasks, "rank", "group").mapInArrow(_drawn(shards, seed), "shard long, slot long, rank long, epoch int, block long")


def block_repeats(plan: DataFrame) -> DataFrame:
    """``(rank, block, times)``: how often the mix reads each block."""
    return plan.groupBy("rank", "block").agg(F.count("*").alias("times"))


def _pieces(placed: DataFrame) -> DataFrame:
    """One row for each part of a document that lies in one block."""
    words = F.col("block_words")
    first, last = F.floor(F.col("start") / words), F.floor((F.col("start") + F.col("size") - 1) / words)
    rows = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start"), F.col("block") * words)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * words)
    return rows.withColumn("words", high - low)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken, tie`` and ``times``.

    ``times`` lists how often the mix reads each piece of the document, a piece
    being its words in one block; ``taken`` is the sum of words times repeats.
    """
    sizes = materialize(_sizes(docs, id_col, text_col, source_col), "sizes")
    sources = materialize(with_slots(source_targets(sizes, weights), block_words), "targets")
    placed = _placed(sizes, sources)
    repeats = materialize(block_repeats(mix_plan(sources, shard_slots, seed)), "repeats")
    pieces = _pieces(placed).join(repeats, ["rank", "block"], "left")
    key = ["doc_id", "size", "tie", "rank", "start"]
    taken = pieces.groupBy(*key).agg(
        F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"),
        F.transform(F.array_sort(F.collect_list(F.struct("block", "words", F.coalesce("times", F.lit(0)).alias("times")))), lambda x: F.struct(x["words"].alias("words"), x["times"].alias("times"))).alias("times"),
    )
    empty = placed.where("size = 0").select(*key, F.lit(0).cast("long").alias("taken"), F.array().cast(taken.schema["times"].dataType).alias("times"))
    rows = materialize(taken.unionByName(empty), "taken")
    for table in (sizes, placed, repeats):
        discard(table)
    return rows.join(sources.select("rank", "source", "source_size", "target"), "rank").select("doc_id", "source", "size", "source_size", "target", "taken", "times", "tie")


_WORD = re.compile(WORD)


def taken_texts(text: str, times: list[tuple[int, int]]) -> list[str]:
    """The texts that the mix takes of one document, one for each pass over it.

    A pass that takes every piece gives the text unchanged; otherwise runs of
    adjacent pieces are cut out and joined by a line end.
    """
    most = max((t for _, t in times), default=0)
    if not most:
        return []
    spans = None
    out = []
    for done in range(most):
        if all(t > done for _, t in times):
            out.append(text)
            continue
        spans = spans or [m.span() for m in _WORD.finditer(text)]
        runs, at, begun = [], 0, None
        for words, t in [*times, (0, 0)]:
            if t > done and begun is None:
                begun = at
            elif t <= done and begun is not None:
                runs.append(text[spans[begun][0] : spans[at - 1][1]])
                begun = None
            at += words
        out.append("\n".join(runs))
    return out


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **options) -> DataFrame:
    """The mix as documents: each pass over a document gives a row with the words it takes.

    All columns stay; ``chars_col``, where present, follows the new text.
    """
    found = mix(docs, id_col, text_col, source_col, **options).where("taken > 0")
    # rows that repeat a key have one text: their lists are kept side by side and dealt by ordinal
    plans = materialize(found.groupBy("doc_id", "source", "tie").agg(F.collect_list("times").alias("plans")), "plans")
    others = [F.col(c) for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*others).alias("row"), F.col(id_col).cast("long").alias("own_id"), F.col(source_col).cast("string").alias("own_source"), F.xxhash64(F.col(text_col)).alias("own_tie"), F.col(text_col).alias("text"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_tie") == F.col("tie"))
    joined = packed.join(plans, same)
    picked = joined.where(F.size("plans") == 1).select("row", "text", F.col("plans")[0].alias("times"))
    if not plans.where(F.size("plans") > 1).isEmpty():
        window = Window.partitionBy("doc_id", "source", "tie").orderBy("tie")
        several = joined.where(F.size("plans") > 1).withColumn("nth", F.row_number().over(window))
        picked = picked.unionByName(several.where(F.col("nth") <= F.size("plans")).select("row", "text", F.element_at("plans", F.col("nth")).alias("times")))

    def make():
        return lambda text, times: (taken_texts(text, [(x["words"], x["times"]) for x in times]),)

    out = append_columns(picked, make, ["text", "times"], "texts array<string>").select("row", F.explode("texts").alias("text"))
    columns = [F.col("text").alias(c) if c == text_col else F.length("text").cast(T.LongType()).alias(c) if c == chars_col else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*columns)
