"""Feeding rows to Arrow kernels in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that are Python objects at the same time.
ROWS = 128


def row_kernel(make: Callable[[], Callable[..., tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that applies ``make()`` to each row's values.

    ``make`` runs once in each task, so models are set up there and not per row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [fn(*values) for values in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str | T.StructType) -> DataFrame:
    """``df`` row by row through the function that ``make()`` returns, as Arrow batches."""
    spark_schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return df.mapInArrow(row_kernel(make, to_arrow_schema(spark_schema)), spark_schema)


def append_kernel(make: Callable[[], Callable[..., tuple]], inputs: list[str], added: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Like :func:`row_kernel`, but keeps every incoming column and appends the new ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            at_names = [batch.schema.get_field_index(c) for c in inputs]
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [fn(*values) for values in zip(*(part.column(i).to_pylist() for i in at_names), strict=True)]
                new = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), added, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], schema=pa.schema([*part.schema, *added]))

    return run


def append_columns(df: DataFrame, make: Callable[[], Callable[..., tuple]], inputs: list[str], added: str) -> DataFrame:
    """``df`` with the columns of ``added`` computed from ``inputs``; names in ``added`` must be new."""
    extra = T._parse_datatype_string(added)
    schema = T.StructType([*df.schema.fields, *extra.fields])
    return df.mapInArrow(append_kernel(make, inputs, to_arrow_schema(extra)), schema)


def keep_rows(df: DataFrame, make: Callable[[], Callable[..., list[bool]]], inputs: list[str]) -> DataFrame:
    """The rows of ``df`` for which the function that ``make()`` returns is true; it takes lists of values of ``inputs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            at_names = [batch.schema.get_field_index(c) for c in inputs]
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield part.filter(pa.array(fn(*(part.column(i).to_pylist() for i in at_names)), pa.bool_()))

    return df.mapInArrow(run, df.schema)
