"""Joins of near geometries through grid cells.

Every geometry is posted under the grid cells that its (expanded) bounding box
touches; geometries meet by equality of cell, and a pair is kept only in the
cell that holds the lower left corner of the common part of the two boxes, so
each pair comes once without a distinct.  A cell's size should be about that of
the geometries plus the search distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(df: DataFrame, box: tuple[Column, Column, Column, Column], cell: float, prefix: str) -> DataFrame:
    x1, y1, x2, y2 = box
    named = df.withColumns({f"{prefix}x1": x1, f"{prefix}y1": y1, f"{prefix}x2": x2, f"{prefix}y2": y2})
    grid = lambda c: F.floor(F.col(c) / cell)
    return named.withColumn(f"{prefix}cx", F.explode(F.sequence(grid(f"{prefix}x1"), grid(f"{prefix}x2")))).withColumn(f"{prefix}cy", F.explode(F.sequence(grid(f"{prefix}y1"), grid(f"{prefix}y2"))))


def near_pairs(left: DataFrame, right: DataFrame, left_box: tuple[Column, Column, Column, Column], right_box: tuple[Column, Column, Column, Column], reach: float, cell: float, how_also: Column | None = None, spread: bool = False, merged: bool = False) -> DataFrame:
    """Rows of ``left`` and ``right`` whose boxes come within ``reach`` of each other on both axes.

    Boxes are (x1, y1, x2, y2) columns of their own side; column names of the two
    sides must differ.  ``how_also`` is a further condition of the join; ``spread``
    keeps the cells in as many tasks as the session's shuffles have, for joins
    whose pairs cost more than their bytes tell.  ``merged``, and ``spread`` too,
    keep the cells from being broadcast: Spark takes a table's size from its file,
    in which the rows that sides and cells add do not show, so that it would send
    large tables through the driver.
    """
    x1, y1, x2, y2 = left_box
    a = _cells(left, (x1 - reach, y1 - reach, x2 + reach, y2 + reach), cell, "_l")
    b = _cells(right, right_box, cell, "_r")
    if spread:
        tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        a, b = a.repartition(tasks, "_lcx", "_lcy"), b.repartition(tasks, "_rcx", "_rcy")
    if spread or merged:
        a, b = a.hint("merge"), b.hint("merge")
    home_x = F.floor(F.greatest("_lx1", "_rx1") / cell)
    home_y = F.floor(F.greatest("_ly1", "_ry1") / cell)
    meet = (
        (F.col("_lcx") == F.col("_rcx"))
        & (F.col("_lcy") == F.col("_rcy"))
        & (F.col("_lx1") <= F.col("_rx2"))
        & (F.col("_rx1") <= F.col("_lx2"))
        & (F.col("_ly1") <= F.col("_ry2"))
        & (F.col("_ry1") <= F.col("_ly2"))
        & (F.col("_lcx") == home_x)
        & (F.col("_lcy") == home_y)
    )
    if how_also is not None:
        meet = meet & how_also
    return a.join(b, meet).drop(*[f"_{s}{c}" for s in "lr" for c in ("x1", "y1", "x2", "y2", "cx", "cy")])
