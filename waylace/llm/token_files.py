"""Token ids as length-delimited binary records with an offset index.

A file is a run of frames in ascending ``doc_id`` order::

    length    8 bytes, unsigned little-endian: bytes of the payload
    check     4 bytes: masked CRC-32 of the length field
    payload   see below
    check     4 bytes: masked CRC-32 of the payload
    0x0A      end of the frame

    payload = flag (1 byte: 1 if the id is null), doc_id (8 bytes, signed),
              width (1 byte: 2 or 4), ids (unsigned little-endian, width bytes each)

The mask rotates the checksum right by 15 bits and adds 0xA282EAD8, so that a
checksum over data that holds checksums stays sound.  Rows are dealt by ranges
of (``doc_id``, hash of the text, row number) that hold equal bytes of text, so
that rows without an id and rows that repeat one spread like any others.  Each
range is one task and one file, written by Spark's own writer with its commit
protocol: any shared store will do, and a lost executor's task is simply run
again.  The ends of frames are Spark's line ends; nothing reads the files as
text.  The index is a separate table of shard, offset, length and counts for
each record, from which single records can be read in any order.

A shard holds ``SHARD_BYTES`` of text, more in a corpus of more than
``MOST_SMALL_SHARDS`` such shards (up to ``LARGE_SHARD_BYTES``), and at most one
document beyond that.  One key for each shard is sent to the tasks: 100 TB give
400,000 keys, 13 MB.

Defined results: null text counts as empty and has only the end id; null ids
come first; rows that repeat an id are neighbours, ordered by a hash of their
text; no rows give no files and no rows; further columns are ignored; a text of
any length is one record.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import sys
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waylace.llm.arrow import ROWS
from waylace.llm.pretokens import Memo, splitter
from waylace.plans.scratch import discard, materialize, remove_path, scratch_path

END_ID = 0
#: Pre-tokens that a worker process remembers.
MEMO_ENTRIES = 400_000
#: Text bytes for each file.
SHARD_BYTES = 24 << 20
#: So many shards keep that size; beyond, shards grow up to the next figure.
MOST_SMALL_SHARDS = 16_384
LARGE_SHARD_BYTES = 256 << 20
_HEAD = struct.Struct("<QI")
_META = struct.Struct("<BqB")
_CHECK = struct.Struct("<I")
_END = b"\n"


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """A record without its end byte, which the writer adds."""
    payload = _META.pack(doc_id is None, doc_id or 0, width) + ids
    length = struct.pack("<Q", len(payload))
    return length + _CHECK.pack(masked(length)) + payload + _CHECK.pack(masked(payload))


def records(data: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """``(offset, length, doc_id, ids)`` of each record; raises ValueError on damage."""
    view, at = memoryview(data), 0
    while at < len(view):
        doc_id, ids, size = record_at(view, at)
        yield at, size, doc_id, ids
        at += size


def record_at(view: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """The record at an offset and its size in the file."""
    if len(view) - at < _HEAD.size:
        raise ValueError(f"cut off at {at}")
    length, check = _HEAD.unpack_from(view, at)
    if masked(view[at : at + 8]) != check:
        raise ValueError(f"damaged length at {at}")
    begin, end = at + _HEAD.size, at + _HEAD.size + length
    if len(view) < end + _CHECK.size + len(_END):
        raise ValueError(f"cut off at {at}")
    payload = view[begin:end]
    if masked(payload) != _CHECK.unpack_from(view, end)[0] or view[end + _CHECK.size : end + _CHECK.size + 1] != _END:
        raise ValueError(f"damaged record at {at}")
    null, doc_id, width = _META.unpack_from(payload)
    ids = np.frombuffer(payload[_META.size :], dtype="<u2" if width == 2 else "<u4")
    return None if null else doc_id, ids, end + _CHECK.size + len(_END) - at


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[int, str]:
    """How byte-level definitions spell bytes: printable ones as themselves, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(0x100 + n) for n, b in enumerate(others)}


class BatchEncoder:
    """Encodes texts with the tokenizers library; one for each worker process.

    Where the definition splits texts by the byte-level pattern and has no other
    step, a pre-token's ids depend on nothing around it.  The library's model
    then encodes each distinct pre-token once, spelled in the byte-level
    alphabet, and texts are put together from a bounded memo.  Texts that hold an added token, and all texts under other
    definitions, go to the library whole.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        spec = json.loads(definition)
        split, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        plain = not any(spec.get(k) for k in ("truncation", "padding", "normalizer", "post_processor")) and not model.get("dropout")
        self.by_pretoken = sys.byteorder == "little" and plain and model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.split = splitter()
        self.code = "H" if self.width == 2 else "I"
        self.alphabet = byte_alphabet()
        self.memo = Memo(self._pretoken)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pretoken(self, token: str) -> bytes:
        spelled = token.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of ``kind``."""
        if not self.by_pretoken:
            return self._whole(texts)
        whole = [any(t in text for t in self.added) for text in texts]
        apart = iter(self._whole([t for t, w in zip(texts, whole, strict=True) if w]))
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        known = self.memo.__getitem__
        return [next(apart) if w else b"".join(map(known, self.split(t))) for t, w in zip(texts, whole, strict=True)]


_encoders: dict[str, BatchEncoder] = {}


def _encoder(digest: str, definition: str) -> BatchEncoder:
    """This process's encoder for a definition, known by the definition's digest."""
    if digest not in _encoders:
        _encoders.clear()
        _encoders[digest] = BatchEncoder(definition)
    return _encoders[digest]


class Bounds:
    """The first keys ``(has id, id, tie, salt)`` of all shards but the first, in order."""

    def __init__(self, keys: list[tuple[bool, int, int, int]]):
        self.columns = np.array(keys, dtype=np.int64).reshape(-1, 4)

    def shard(self, doc_id: int | None, tie: int, salt: int) -> int:
        """The number of bounds at or before a key."""
        return bisect_right(self, (doc_id is not None, doc_id or 0, tie, salt))

    def __len__(self) -> int:
        return len(self.columns)

    def __getitem__(self, k: int) -> tuple[int, ...]:
        return tuple(self.columns[k].tolist())


_RUNNING = pa.schema([("has_id", pa.bool_()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("salt", pa.int64()), ("part", pa.int32()), ("size", pa.int64()), ("before", pa.int64())])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes before each row within its partition."""
    carry = 0
    for batch in batches:
        upto = carry + np.cumsum(batch.column(5).to_numpy(zero_copy_only=False))
        if len(upto):
            carry = int(upto[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - batch.column(5).to_numpy(zero_copy_only=False))], schema=_RUNNING)


def shard_bounds(rows: DataFrame, shard_bytes: int) -> Bounds:
    """Where shards of ``shard_bytes`` begin in ``rows`` (``doc_id, tie, salt, size``)."""
    order = ["has_id", "doc_id", "tie", "salt"]
    keys = rows.select(F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "tie", "salt", "size")
    dealt = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).select(*order, "part", "size")
    placed = materialize(dealt.mapInArrow(_running, "has_id boolean, doc_id long, tie long, salt long, part int, size long, before long"), "token-keys")
    parts = placed.groupBy("part").agg(F.sum("size").alias("bytes"))  # one row for each partition
    bases = parts.select("part", F.coalesce(F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    total = parts.agg(F.sum("bytes")).first()[0] or 0
    each = max(shard_bytes, min(LARGE_SHARD_BYTES, total // MOST_SMALL_SHARDS))
    shard = F.floor((F.col("base") + F.col("before")) / F.lit(each))
    firsts = placed.join(bases, "part").groupBy(shard.alias("shard")).agg(F.min(F.struct(*order)).alias("first")).orderBy("shard").select("first.*").collect()  # one row for each shard
    discard(placed)
    return Bounds([tuple(r) for r in firsts[1:]])


_FRAMES = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("frame", pa.binary())])


def _framed(shared, digest: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition, bounds = shared.value
        encoder = _encoder(digest, definition)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, texts, ties, salts = (c.to_pylist() for c in part.columns)
                found = encoder.encode([t or "" for t in texts])
                frames = [frame(i, x + end, encoder.width) for i, x in zip(ids, found, strict=True)]
                shards = list(map(bounds.shard, ids, ties, salts))
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), part.column(0), part.column(2), pa.array(frames, pa.binary())], schema=_FRAMES)

    return run


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> int:
    """Write the files under ``path``; gives the number of shards."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("*", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("salt"))
    bounds = shard_bounds(rows.select("doc_id", "tie", "salt", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")), shard_bytes)
    with open(tokenizer_path or default_tokenizer_path(), encoding="utf-8") as f:
        definition = f.read()
    shared = spark.sparkContext.broadcast((definition, bounds))
    digest = hashlib.sha256(definition.encode()).hexdigest()
    framed = rows.mapInArrow(_framed(shared, digest, end_id), "shard int, doc_id long, tie long, frame binary")
    dealt = framed.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "tie")
    dealt.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)
    return len(bounds) + 1


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, content)``: a file's shard is the number that the writer put in its name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", "/part-(\\d+)-[^/]*$", 1).cast("int").alias("shard"), "content")


_INDEX = pa.schema([("shard", pa.int32()), ("ordinal", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64()), ("ids_crc32", pa.int64())])


#: Index rows that are Python objects at the same time.
_INDEXED = 4_096


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found, before = enumerate(records(content.as_buffer())), 0
            while piece := list(islice(found, _INDEXED)):
                rows = []
                for n, (offset, length, doc_id, ids) in piece:
                    rows.append((shard, n, offset, length, doc_id, len(ids), before, zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)


def index_token_files(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Read every file, check every record and write the index table beside them.

    Columns: ``shard, ordinal, offset, length, doc_id, n_tokens, before`` (ids of
    the shard before the record) and ``ids_crc32``.
    """
    fields = "shard int, ordinal int, offset long, length long, doc_id long, n_tokens long, before long, ids_crc32 long"
    _files(spark, path).mapInArrow(_scan, fields).write.parquet(index_path)
    return spark.read.schema(fields).parquet(index_path)


def starts(index: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: the index with each document's place among all ids."""
    window = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))  # one row for each file
    bases = totals.select("shard", F.coalesce(F.sum("ids").over(window), F.lit(0)).alias("base"))
    return index.join(bases, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_token_files(spark: SparkSession, path: str, picks: DataFrame | None = None) -> DataFrame:
    """``(doc_id, ids)`` of all records, or of those index rows (``shard, offset``) that ``picks`` holds."""
    if picks is None:

        def whole(batches):
            for batch in batches:
                for content in batch.column(1):
                    for _, _, doc_id, ids in records(content.as_buffer()):
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

        return _files(spark, path).mapInArrow(whole, "doc_id long, ids array<long>")

    def picked(batches):
        for batch in batches:
            for content, offsets in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                view = memoryview(content.as_buffer())
                for offset in offsets:
                    doc_id, ids, _ = record_at(view, offset)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    wanted = picks.groupBy("shard").agg(F.collect_list("offset").alias("offsets"))  # at most the records of a file
    return _files(spark, path).join(wanted, "shard").select("shard", "content", "offsets").mapInArrow(picked, "doc_id long, ids array<long>")


def token_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write files in the shared folder, read them back, delete them and give :func:`starts` of their index."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(docs, f"{path}/records", id_col, text_col, tokenizer_path, end_id)
    index = index_token_files(spark, f"{path}/records", f"{path}/index")
    remove_path(spark, f"{path}/records")
    return starts(index)
