"""Structured Streaming over arriving polygons.

Each micro-batch names the tiles its polygons touch; a tile's network is made
again from all polygons known for it and replaces the tile's partition, so a
batch that runs twice leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waylace.operators.dissolve import ring_box

TILE = 512.0


def with_tiles(polygons: DataFrame, tile: float = TILE) -> DataFrame:
    """One row for each tile that a ring's box touches: ``tx, ty`` are added."""
    x1, y1, x2, y2 = ring_box(F.col("ring"))
    at = lambda c: F.floor(c / tile)
    return polygons.withColumn("tx", F.explode(F.sequence(at(x1), at(x2)))).withColumn("ty", F.explode(F.sequence(at(y1), at(y2))))


def run_by_tiles(polygons: DataFrame, store: str, output: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], **trigger) -> StreamingQuery:
    """Start a query that keeps ``output`` (partitioned by tile) current with a stream of polygons.

    ``process`` maps the polygons of the touched tiles to rows with ``tx`` and ``ty``.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        tiled = with_tiles(df).withColumn("batch", F.lit(batch_id))
        tiled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)
        known = spark.read.schema(tiled.schema).parquet(store)
        touched = known.where(F.col("batch") == batch_id).select("tx", "ty").distinct()
        process(known.join(touched, ["tx", "ty"], "left_semi").drop("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tx", "ty").parquet(output)

    return polygons.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
