"""Intermediate tables in the folder that every executor shares.

Iterative plans cut their lineage by writing a table and reading it back.  The
folder is the cluster's ``spark.checkpoint.dir``; only where that is unset and
the master is local (a test session) does the library pick one of its own.

Operators delete the tables that their result does not read.  What a lazy result
still reads stays until :func:`clear_scratch`, or the end of a ``with cleared()``
in which the result is written.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The shared folder as a URI; made locally when a local session names none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="waylace-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder, which :func:`clear_scratch` deletes."""
    path = f"{shared_root(spark)}/waylace/{tag}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    The reread frame has no lineage and no partitioning of its own, so a later
    join shuffles both sides and adaptive execution may split a hot key.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._waylace_path = path
    return out


def read_from(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, which reads ``table`` alone, such that :func:`discard` deletes that table."""
    df._waylace_path = getattr(table, "_waylace_path", None)
    return df


def discard(df: DataFrame | None) -> None:
    """Delete the table behind a frame that :func:`materialize` returned."""
    path = getattr(df, "_waylace_path", None)
    if path:
        remove_path(df.sparkSession, path)
        _written.discard(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that this process still keeps; frames that read them are then of no use."""
    for path in list(_written):
        remove_path(spark, path)
        _written.discard(path)


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that were written inside when the block ends."""
    before = set(_written)
    try:
        yield
    finally:
        for path in _written - before:
            remove_path(spark, path)
            _written.discard(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    with contextlib.suppress(Exception):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
