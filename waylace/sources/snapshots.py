"""Named snapshots of pipeline stages, and where results go."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame

STAGES = ("01_skeleton", "02_planarized", "03_cleaned", "04_final_raw")
log = logging.getLogger("waylace")


def result_path(base: str, source: str) -> str:
    """``<base>/Result/<stem of source>_centerline``."""
    return f"{base.rstrip('/')}/Result/{os.path.splitext(os.path.basename(source))[0]}_centerline"


def save_stage(df: DataFrame | None, stem: str, stage: str, enabled: bool = True) -> str | None:
    """Write a stage's geometry as Parquet; empty stages and failures only leave a message."""
    if not enabled or df is None:
        return None
    path = f"{stem}_{stage}"
    try:
        if df.isEmpty():
            log.warning("stage %s is empty", stage)
            return None
        df.select("geom").write.mode("overwrite").parquet(path)
    except Exception as error:  # a snapshot never stops the run
        log.warning("stage %s was not saved: %s", stage, error)
        return None
    return path
