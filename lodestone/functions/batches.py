"""Values of a column, one by one in Python, a small slice of an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a slice; a longer value is a slice of its own.
SLICE = 1 << 19


def parts(column: pa.Array) -> Iterator[pa.Array]:
    """The column in slices of SLICE bytes at most, or one row."""
    if len(column) <= 1 or column.nbytes <= SLICE:
        yield column
        return
    half = len(column) // 2
    yield from parts(column.slice(0, half))
    yield from parts(column.slice(half))


def each(value: Column, one: Callable[[Any], Any], spark_type: str, arrow_type: pa.DataType) -> Column:
    """`one` of every value. Python objects and results of one slice are held, whatever a batch holds, and workers give memory back."""

    @F.arrow_udf(spark_type)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for batch in batches:
                for part in parts(batch):
                    yield pa.array([one(v) for v in part.to_pylist()], arrow_type)
        finally:
            pa.default_memory_pool().release_unused()

    return run(value)
