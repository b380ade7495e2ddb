"""Small helpers around ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and payload bytes after which a batch is handed back to Spark.
OUT_ROWS, OUT_BYTES = 4096, 8 << 20


def batches_of(rows: Iterable[tuple], schema: pa.Schema, weight: Callable[[tuple], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a stream of tuples into record batches bounded in rows and, through ``weight``, in bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weight(row) if weight else 0
        if len(held) >= OUT_ROWS or size >= OUT_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def map_rows(df: DataFrame, make: Callable[[Iterator[tuple]], Iterable[tuple]], schema: T.StructType, weight: Callable[[tuple], int] | None = None, slice_rows: int = 256) -> DataFrame:
    """Stream every partition of ``df`` as tuples through ``make`` and back, Arrow batch by Arrow batch.

    ``make`` gets an iterator over the whole partition, so it may hold state, and memory
    stays bounded by ``slice_rows`` input rows and one output batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, slice_rows):
                    part = batch.slice(at, slice_rows)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        yield from batches_of(make(rows()), arrow, weight)

    return df.mapInArrow(run, schema)
