"""Named queries over the test tables, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waylace.catalog import network, polygons, polylines, reports, surfaces

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (polygons, polylines, network, reports, surfaces)


def queries() -> dict[str, Query]:
    return {name: fn for module in _MODULES for name, (fn, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
