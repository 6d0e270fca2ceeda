"""The rows of largest count as arrays on the driver, found by a threshold: no global sort, no row objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import lean


def gathered(rows: DataFrame, columns: dict[str, str]) -> list[np.ndarray]:
    """`columns` (name: NumPy type) of all rows, whose number the caller has bounded, as arrays on the driver."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(c).to_numpy().astype(t).tobytes()], pa.binary()) for c, t in columns.items()], [*columns])

    packed = rows.select(*columns).mapInArrow(lean(pack), ", ".join(f"{c} binary" for c in columns)).collect()
    return [np.concatenate([np.zeros(0, t), *[np.frombuffer(r[c], t) for r in packed]]) for c, t in columns.items()]


def commonest(rows: DataFrame, columns: dict[str, str], most: int, least: int = 1) -> list[np.ndarray]:
    """`columns` (name: NumPy type) of the rows whose n is at least `least` and over a threshold that at most `most` rows pass.

    The threshold falls between classes of about a twelfth of n, so a class is taken whole or not at all;
    rows come in no order. `rows` are read twice, so they should be kept. Columns without nulls only.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    held, first = 0, None
    for r in rows.where(F.col("n") >= least).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("step")).collect():  # at most 512 rows
        held += r["m"]
        if held > most:
            break
        first = r["step"]
    if first is None:
        return [np.zeros(0, t) for t in columns.values()]

    return gathered(rows.where((F.col("n") >= least) & (step >= first)), columns)
