"""A bitmap of ids, of fixed size, that tasks test rows against before they are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import lean, mix

BITS = 24


def _spot(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def marked(ids: DataFrame) -> Broadcast:
    """A bitmap (2 ** BITS bits, 2 MB) of the one long column of ids; it holds all of them, and may hold others."""
    name = ids.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << BITS, bool)
        for b in batches:
            own[_spot(b.column(name).to_numpy())] = True
        words = np.packbits(own, bitorder="little").view("<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["word", "bits"])

    found = ids.mapInArrow(lean(run), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(1 << (BITS - 6), "<i8")
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return ids.sparkSession.sparkContext.broadcast(words)


def test(marks: Broadcast, column: pa.Array) -> np.ndarray:
    """Whether each id may be marked; nulls are not."""
    at = _spot(column.fill_null(0).to_numpy(zero_copy_only=False))
    return ((marks.value[at >> 6] >> (at & 63)) & 1).astype(bool) & column.is_valid().to_numpy(zero_copy_only=False)


def keep(marks: Broadcast, name: str, wanted: bool = True):
    """For mapInArrow: the rows whose id may be marked (or, not wanted, surely is not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(test(marks, b.column(name)) == wanted))

    return run


def own_hash(shared: Broadcast, b: pa.RecordBatch, name: str, hashed: str) -> np.ndarray:
    """The hash column of rows whose id may be marked in `shared`, and 0 for all others."""
    return np.where(test(shared, b.column(name)), b.column(hashed).to_numpy(), 0)
