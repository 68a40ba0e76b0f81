"""Exact de-duplication by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes.  Blocks are dealt to
naming partitions by hash and sorted there; a block's name is its partition
number and its rank among the partition's distinct blocks, so equal blocks get
one name and different blocks never share one (the hash only chooses the
partition, content decides).  Adjacent names are then paired and the pairs
named in the same way, level by level, until each document has one name.
Texts are equal exactly when their levels and names are equal.

Hot blocks (those of a large group of copies) never meet in one task: they are
found by a count of block hashes that is combined before its shuffle, named
apart and joined by content from a broadcast table.  At most ``1024`` hashes
can reach the share that makes a block hot, so that table is at most
``1024 * block_bytes`` (16 MB).

Defined results: a null text counts as empty; empty texts are equal to each
other; a null ``doc_id`` is an ordinary row and is kept only in a group
that has no other id; of rows that repeat both id and text one is kept; no rows
give no rows; further columns are ignored here and kept by
:func:`drop_exact_duplicates`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylace.plans.scratch import discard, materialize

BLOCK_BYTES = 16_384
HOT_SHARE = 1_024
HOT_LEAST = 64
#: Bytes of blocks or pairs that are sorted together.
BUCKET_BYTES = 4 << 20
LEAST_BUCKETS = 4_096
#: As many as the bits of a name leave; 100 TB give 24 MB to each.
MOST_BUCKETS = 1 << 22
_RANK_BITS = 40
_PAIR_BYTES = 32


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    raw = docs.select(F.col(id_col).alias("doc_id"), _text(text_col).cast("binary").alias("raw"))
    size = raw.select(
        "doc_id",
        "raw",
        F.unhex(F.sha2("raw", 256)).alias("sha"),
        F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / block_bytes).cast("int")).alias("n_blocks"),
    )
    return size.select("doc_id", "sha", "n_blocks", "raw", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("seq")).select(
        "doc_id", "sha", "n_blocks", "seq", F.substring("raw", F.col("seq") * block_bytes + 1, F.lit(block_bytes)).alias("block")
    )


def _ranked(rows: DataFrame, spread: Column, order: list[str], buckets: int) -> DataFrame:
    """``rows`` with ``name``: bucket number, then rank of ``order`` in the bucket."""
    window = Window.partitionBy("bucket").orderBy(*order)
    return rows.withColumn("bucket", F.pmod(spread, F.lit(buckets))).withColumn("name", F.shiftleft("bucket", _RANK_BITS) + F.dense_rank().over(window)).drop("bucket")


def _buckets(n_bytes: int) -> int:
    """Buckets of about ``BUCKET_BYTES``, so that none outgrows a task whatever the size."""
    return min(max(n_bytes // BUCKET_BYTES, LEAST_BUCKETS), MOST_BUCKETS)


def _name_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """One row per block with its name."""
    blocks = _blocks(docs, id_col, text_col, block_bytes)
    hashed = _hash_only(docs, text_col, block_bytes)
    counts = materialize(hashed.groupBy("h").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), "block-counts")
    total, n_bytes = (x or 0 for x in counts.agg(F.sum("n"), F.sum("bytes")).first())
    share = max(HOT_LEAST, total // HOT_SHARE + 1)
    hot = [r["h"] for r in counts.where(F.col("n") >= share).select("h").collect()]  # fewer than HOT_SHARE
    discard(counts)
    keyed = blocks.withColumn("h", F.xxhash64("block"))
    buckets = _buckets(n_bytes)
    columns = ["doc_id", "sha", "n_blocks", "seq", "name"]
    if not hot:
        return _ranked(keyed, F.col("h"), ["block"], buckets).select(*columns)
    is_hot = F.col("h").isin(hot)
    cold = _ranked(keyed.where(~is_hot), F.col("h"), ["block"], buckets).select(*columns)
    few = keyed.where(is_hot).select("h", "block").distinct()
    named = few.select("h", "block", (-F.row_number().over(Window.orderBy("h", "block"))).cast("long").alias("name"))
    warm = keyed.where(is_hot).join(F.broadcast(named), ["h", "block"]).select(*columns)
    return cold.unionByName(warm)


def _hash_only(docs: DataFrame, text_col: str, block_bytes: int) -> DataFrame:
    raw = docs.select(_text(text_col).cast("binary").alias("raw"))
    last = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / block_bytes).cast("int")) - 1
    block = F.substring("raw", F.col("seq") * block_bytes + 1, F.lit(block_bytes))
    return raw.select("raw", F.explode(F.sequence(F.lit(0), last)).alias("seq")).select(F.xxhash64(block).alias("h"), F.octet_length(block).cast("long").alias("bytes"))


def document_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, sha, copies, level, name)``: one row per distinct (id, text).

    ``copies`` counts the rows that repeat both.  ``sha`` is the SHA-256 of the
    text and only tells rows of one id apart; equality comes from the names.
    """
    keys = ["doc_id", "sha", "n_blocks"]
    named = materialize(_name_blocks(docs, id_col, text_col, block_bytes).groupBy(*keys, "seq", "name").agg(F.count("*").alias("copies")), "block-names")
    done = [named.where("n_blocks = 1").select("doc_id", "sha", "copies", F.lit(0).alias("level"), "name")]
    rest = named.where("n_blocks > 1")
    most = rest.agg(F.max("n_blocks")).first()[0] or 1
    level = 0
    left = most
    rows = rest.select(*keys, "copies", "seq", "name", F.col("n_blocks").alias("left"))
    while left > 1:
        level, left = level + 1, (left + 1) // 2
        pairs = materialize(
            rows.groupBy(*keys, "copies", "left", F.floor(F.col("seq") / 2).cast("int").alias("seq")).agg(
                F.max(F.when(F.col("seq") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("seq") % 2 == 1, F.col("name"))), F.lit(-(1 << 62))).alias("b"),
            ),
            "pairs",
        )
        names = materialize(_ranked(pairs.select("a", "b").distinct(), F.xxhash64("a", "b"), ["a", "b"], _buckets(pairs.count() * _PAIR_BYTES)), "pair-names")
        joined = materialize(
            pairs.join(names, ["a", "b"]).select(*keys, "copies", "seq", "name", F.ceil(F.col("left") / 2).cast("int").alias("left")),
            "named",
        )
        discard(pairs)
        discard(names)
        done.append(joined.where("left = 1").select("doc_id", "sha", "copies", F.lit(level).alias("level"), "name"))
        rows = joined.where("left > 1")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id is kept.
    """
    names = materialize(document_names(docs, id_col, text_col, block_bytes), "doc-names")
    groups = materialize(names.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    return (
        names.join(groups, ["level", "name"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
            "copies",
        )
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the copies; all columns stay."""
    keep = exact_duplicates(docs, id_col, text_col, block_bytes).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "copies")
    keep = materialize(keep, "kept")
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), F.sha2(_text(text_col).cast("binary"), 256).alias("own_sha"))
    joined = packed.join(keep, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_sha") == F.col("sha")))
    once = joined.where("copies = 1").select("row.*")
    if keep.where("copies > 1").isEmpty():
        return once
    return once.unionByName(joined.where("copies > 1").dropDuplicates(["own_id", "own_sha"]).select("row.*"))
